"""Scalar column expressions; every one stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring contract.
P_SPOOF, C_MISS, C_FA = 0.5, 1.0, 4.0
TEST_PRIOR = 0.30
ALERT = 0.8
#: Fixed values: (native rate, hop) pairs whose frame grids a clip's length is tested against.
GRIDS = [(22050, 256), (22050, 512), (22050, 300), (24000, 256), (24000, 300), (24000, 240), (16000, 200), (16000, 256), (16000, 320), (44100, 512), (48000, 480)]


def lit(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within two bounds; null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lit(low)), lit(high)))


def sigmoid(z: Column) -> Column:
    return lit(1) / (lit(1) + F.exp(-clip(z, -40, 40)))


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.ln(q / (lit(1) - q))


def prior_shift(p: float = TEST_PRIOR) -> Column:
    return F.ln(lit(p) / lit(1 - p))


def default_score(analyst: Column, as_coded: Column) -> Column:
    """The midpoint of two thresholds in log-odds, for clips that can't be decoded."""
    return sigmoid((logit(F.least(analyst, as_coded)) + logit(F.greatest(analyst, as_coded))) / lit(2))


def detector_verdict(p: Column, analyst: Column, as_coded: Column) -> Column:
    a, c = F.coalesce(analyst, lit(0.5)), F.coalesce(as_coded, lit(0.5))
    return F.when(p >= a, "synthetic").when(p >= c, "uncertain").otherwise("bona fide")


#: The least probability of each verdict, and its words.
VERDICTS = ((ALERT, "likely synthetic"), (0.5, "suspicious, below the alert threshold"), (0.2, "inconclusive, leaning real"), (None, "likely real"))


def forensic_verdict(p: Column) -> Column:
    return F.coalesce(*(F.lit(words) if least is None else F.when(p >= lit(least), words) for least, words in VERDICTS))


def robust_z(value: Column, median: Column, spread: Column) -> Column:
    return (value - median) / F.coalesce(F.nullif(spread, lit(0)), lit(1))


def finite(x: Column) -> Column:
    """``x`` where it is a finite number, else null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != lit(float("inf"))), x)


def length_grids(n: Column, rate: Column, grids: list[tuple[int, int]] = GRIDS) -> Column:
    """Labels of the frame grids that ``n`` samples at ``rate`` sit on; ``~`` marks a match after resampling.

    A clip must span eight hops. Null or non-positive lengths and rates give no labels.
    """
    hits = []
    for native, hop in grids:
        grid = lit(hop) * rate / lit(native)
        offset = n - F.rint(n / grid) * grid
        own = F.when((n % hop) == 0, F.lit(f"{native}/{hop}"))
        other = F.when(F.abs(offset) <= lit(1.2), F.lit(f"{native}/{hop}~"))
        hits.append(F.when((n > 0) & (rate > 0) & (n >= lit(8 * hop) * rate / lit(native)), F.when(rate == native, own).otherwise(other)))
    return F.array_compact(F.array(*hits))


def own_grids(grids: Column, shared: Column) -> Column:
    """Grids of a clip that its batch doesn't share; the approximate ones go, too, if any is shared."""
    own = F.array_except(grids, shared)
    return F.when(F.arrays_overlap(grids, shared), F.filter(own, lambda g: ~g.endswith("~"))).otherwise(own)


def peak_normalize(x: Column, peak: float = 0.95) -> Column:
    top = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.when(top < lit(1e-9), x).otherwise(F.transform(x, lambda v: v * (lit(peak) / top)))


def three_digits(x: Column) -> Column:
    """A finite number by three significant digits without closing zeros, with an exponent below 1e-4 and from 1000 on; halves go to the even digit, as far as doubles can tell."""
    size = F.abs(x)
    power = F.floor(F.log10(size)).cast("int")
    digits = F.rint(F.when(power > 2, size / F.pow(lit(10), power - 2)).otherwise(size * F.pow(lit(10), lit(2) - power)))
    power, digits = F.when(digits >= 1000, power + 1).otherwise(power), F.when(digits >= 1000, lit(100)).otherwise(digits)
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.coalesce(*(F.when(power == p, bare(F.format_string(f"%.{2 - p}f", digits / lit(10.0 ** (2 - p))))) for p in range(-4, 3)))
    scientific = F.concat(bare(F.format_string("%.2f", digits / 100)), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.coalesce(plain, scientific)))


def report_id(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, 80), F.lit("."), F.sha2(path, 256))


def band_limited(bandwidth: Column, cutoff_drop_db: Column, rate: Column) -> Column:
    return (bandwidth < lit(0.97) * rate / lit(2)) & (cutoff_drop_db > lit(25))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), lit(0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def check_prior(prior: float) -> float:
    """The prior as a number; ValueError unless it lies strictly between 0 and 1."""
    try:
        value = float(prior)
    except (TypeError, ValueError):
        value = float("nan")
    if not 0 < value < 1:
        raise ValueError(f"the prior must lie strictly between 0 and 1: {prior!r}")
    return value


def clip_seed(uid: Column, seed: int) -> Column:
    """Two numbers that seed a clip's random generator: the CRC-32 of its id, and ``seed``."""
    return F.array(F.crc32(uid.cast("string").cast("binary")), F.lit(seed).cast("long"))


def spaced_windows(n: Column, width: int = 64_600, most: int = 3, longest: int = 120 * 16_000) -> Column:
    """First samples of up to ``most`` windows, evenly spaced over ``n`` samples; a shorter clip has the one from 0, which
    is to be tiled, and one beyond ``longest`` none (null)."""
    count = F.least(F.lit(most), F.ceil(n / F.lit(width))).cast("int")
    step = (n - F.lit(width)).cast("double") / F.greatest(count - 1, F.lit(1))
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(i * step))
    return F.when(n > F.lit(longest), F.lit(None)).when(n < F.lit(width), F.array(F.lit(0).cast("long"))).otherwise(starts)
