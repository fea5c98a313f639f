"""Quality rules: word statistics of whole texts and hashed n-gram classifiers.

Two logistic regressions over hashed n-grams (words, pairs of words, and the 3 and 5
successive characters from each place) are trained on labelled rows, one for low quality
and one for toxicity. The training rows are a hash sample of at most ``TRAINING_ROWS``; a
fifth of them is held back to calibrate the probabilities (Platt). A feature has a weight
if its share among the two classes differs by more than chance would make of so many
features, so what counts as rare follows from the rows. All documents are then scored in
Arrow batches against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text_kernels as K
from tessera.llm.tables import bounded_batches
from tessera.llm.text_kernels import tidy

#: Bound on the labelled rows that the classifiers are fitted on.
TRAINING_ROWS = 4000
BITS = 20
EPOCHS = 15
BATCH = 32
RATE = 0.5
PENALTY = 1e-4
#: Part of the deviations that the largest of so many features would reach by chance; see ``_scales``.
CHANCE = 0.8
CHARACTERS = (3, 5)
#: Bytes of text whose features are held at once.
SLICE = 1 << 18
#: Documents with a calibrated probability above these go.
MOST_LOW_QUALITY = 0.5
MOST_TOXIC = 0.3
NOT_WORD = np.ones(256, bool)
NOT_WORD[128:] = False
NOT_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"]] = False
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Runs, dict[str, np.ndarray]]:
    """The words of a slice and the statistics of each document."""
    w = K.words(data, offsets)
    h = K.run_hashes(data, w.start, w.end)
    letters = ~K.SPACE[data] & ((data & 0xC0) != 0x80)
    out = {"n_words": w.count, "word_chars": K.counts(letters, offsets), "n_symbols": K.counts(SYMBOLS[data], offsets)}

    ln = K.lines(data, offsets)
    filled = np.searchsorted(w.start, ln.start) < np.searchsorted(w.start, ln.end)
    doc = ln.doc()[filled]
    _, first, d = K.distinct_in_doc(doc, K.run_hashes(data, ln.start[filled], ln.end[filled]))
    out["n_dup_lines"] = np.bincount(d[~first], minlength=len(w.count))

    g, at = K.gram_hashes(h, w, 3)
    gdoc = w.doc()[at]
    order, first, _ = K.distinct_in_doc(gdoc, g)
    last = np.ones(len(order), bool)
    last[:-1] = first[1:]
    again = at[order[~(first & last)]]
    covered = np.zeros(len(h) + 3, bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = K.sum_by_doc(covered[: len(h)], w).astype(np.int64)
    return w, out


def character_runs(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of ``sizes``: (first byte, end, document) of each so many successive code points of a document."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.append(lead[1:], len(data))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(lead, offsets)))
    for n in sizes:
        inside = np.flatnonzero(doc[: max(len(lead) - n + 1, 0)] == doc[n - 1 :])
        yield lead[inside], end[inside + n - 1], doc[inside]


_BYTES = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)


def short_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte runs of at most 24 bytes, from 8-byte words."""
    words = np.ndarray((len(low) + 17,), "<u8", np.concatenate([low, np.zeros(24, np.uint8)]), strides=(1,))
    size = end - start
    h = K.mix((words[start] & _BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * K.U(0xD1342543DE82EF95))
    for at in (8, 16):
        more = np.flatnonzero(size > at)
        if len(more):
            h[more] = K.mix(h[more] * K.U(0x9E3779B97F4A7C15) + (words[start[more] + at] & _BYTES[np.minimum(size[more] - at, 8)]))
    return h


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), with repetitions: each lower-cased word of letters and digits, each pair of them, and
    each run of ``CHARACTERS`` lower-cased characters; all white space counts as a blank."""
    low = np.where(K.SPACE[data], np.uint8(32), K.LOWER[data])
    inner = K.words(low, offsets, NOT_WORD)
    h = K.run_hashes(low, inner.start, inner.end)
    pairs, at = K.gram_hashes(h, inner, 2)
    doc = inner.doc()
    parts = [(doc, h), (doc[at], pairs)]
    parts += [(own, short_hashes(low, start, end)) for start, end, own in character_runs(data, offsets, CHARACTERS)]
    kind = [K.U(i * 0xD6E8FEB86659FD93 % 2**64) for i in range(len(parts))]
    return np.concatenate([d for d, _ in parts]), np.concatenate([((x + k) >> K.U(64 - BITS)).astype(np.int64) for k, (_, x) in zip(kind, parts, strict=True)])


class Classifier(NamedTuple):
    """One logistic regression: weights of the features that a document has, and the slope and shift that calibrate its margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        some = np.flatnonzero(self.weights[feature])
        key = np.unique((doc[some] << BITS) | feature[some])
        margin = np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], n) + self.bias
        return _sigmoid(self.slope * margin + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit sigmoid(slope * margin + shift) to labels, by Newton steps on smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    prior = np.array([1.0, 0.0])

    def loss(t: np.ndarray) -> float:
        z = x @ t
        return float((np.logaddexp(0, z) - target * z).sum() + 0.5e-3 * ((t - prior) ** 2).sum())

    theta = prior
    for _ in range(50):
        p = _sigmoid(x @ theta)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * (theta - prior))
        size = 1.0  # halved until the loss falls: on classes that are far apart a whole step may go past the optimum
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(theta[0]), 1e-3), float(theta[1])


def _scales(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """1 for the features whose documents' classes differ by more than chance: the root of the likelihood ratio
    of a feature exceeds CHANCE times the largest expected of so many independent ones."""
    inside, outside = np.zeros((2, 1 << BITS))
    for i in range(0, len(docs), 500):
        for count, label in ((inside, 1), (outside, 0)):
            own = [d for d, v in zip(docs[i : i + 500], y[i : i + 500], strict=True) if v == label]
            if own:
                count += np.bincount(np.concatenate(own), minlength=1 << BITS)
    share = y.mean()
    both = inside + outside
    ratio = lambda seen, expected: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)
    deviations = np.sqrt(np.maximum(2 * (ratio(inside, both * share) + ratio(outside, both * (1 - share))), 0))
    return (deviations > CHANCE * np.sqrt(2 * np.log(max(np.count_nonzero(both), 2)))).astype(float)


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Classifier:
    """Logistic regression by AdaGrad over documents' distinct features; every fifth row only calibrates."""
    held = np.arange(len(docs)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        return Classifier(np.zeros(1 << BITS, np.float32), 0.0, 0.0, -20.0 if not y.any() else 20.0)
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~held)
    used = np.flatnonzero(_scales([docs[j] for j in train], y[train]))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    own = [p[p >= 0] for p in (place[d] for d in docs)]
    weights, seen, bias, bias_seen = np.zeros(len(used)), np.full(len(used), 1e-6), 0.0, 1e-6
    share, step_of = y[train].mean(), 0.1  # a feature's value; the margin of a document is a sum over hundreds of them
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        rng.shuffle(train)
        for i in range(0, len(train), BATCH):
            part = train[i : i + BATCH]
            feature = np.concatenate([own[j] for j in part])
            row = np.repeat(np.arange(len(part)), [len(own[j]) for j in part])
            error = (_sigmoid(step_of * np.bincount(row, weights[feature], len(part)) + bias) - y[part]) * cost[part]
            step = step_of * np.bincount(feature, error[row], len(used)) / len(part)
            step[feature] += PENALTY * weights[feature]
            seen += step * step
            weights -= RATE * step / np.sqrt(seen)
            slope = float(error.mean())
            bias_seen += slope * slope
            bias -= RATE * slope / bias_seen**0.5
    margin = np.array([step_of * weights[d].sum() for d in own]) + bias
    some = held if len(set(y[held].tolist())) == 2 else ~held
    flat = np.zeros(1 << BITS, np.float32)
    flat[used] = step_of * weights
    return Classifier(flat, bias, *_platt(margin[some], y[some]))


class QualityModel(NamedTuple):
    low_quality: Classifier
    toxic: Classifier


def _label_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most about ``rows`` labelled documents, chosen by the hash of their id."""
    tags = labels.groupBy(id_col).agg(F.max((F.col("quality") == 0).cast("int")).alias("low"), F.max((F.col("toxic") == 1).cast("int")).alias("tox"))
    tags = tags.filter(f"`{id_col}` is not null")
    n = tags.count()
    scale = 1_000_000
    keep = min(scale, int(scale * rows / max(n, 1)))
    chosen = tags.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(scale)) < keep).orderBy(F.xxhash64(F.col(id_col), F.lit(17))).limit(rows)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit both classifiers on at most ``rows`` labelled documents (``quality`` 0 is low, ``toxic`` 1 is toxic).

    Of several labels of a document the worse one counts; documents without an id or a label, and labels
    without a document, take no part; rows that share an id all do. Without rows of both classes a
    classifier gives its only class to all.
    """
    bounded_batches(docs.sparkSession)
    sample = _label_sample(docs, labels, id_col, text_col, rows)
    model = _fitted(sample.mapInArrow(tidy(_feature_batches(id_col)), "id string, low int, tox int, features binary").toArrow())
    K.return_memory()  # the driver lives on; without this it keeps some 70 MB after each training
    return model


def _fitted(featured: pa.Table) -> QualityModel:
    featured = featured.sort_by([("id", "ascending"), ("features", "ascending")])
    parts = [np.frombuffer(x.as_buffer(), np.int32) for x in featured["features"]]  # views, not copies
    low, tox = (featured[c].to_numpy().astype(float) for c in ("low", "tox"))
    low, tox = np.nan_to_num(low), np.nan_to_num(tox)
    if not parts:
        nothing = np.zeros(0)
        return QualityModel(fit([], nothing), fit([], nothing))
    return QualityModel(fit(parts, low), fit(parts, tox))


def _feature_batches(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, data, offsets in K.slices(batch.column("text"), SLICE):
                doc, feature = features(data, offsets)
                key = np.unique((doc << BITS) | feature)
                cut = np.searchsorted(key >> BITS, np.arange(len(offsets)))
                distinct = (key & ((1 << BITS) - 1)).astype(np.int32)
                packed += [distinct[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).cast(pa.string()), batch.column("low").cast(pa.int32()), batch.column("tox").cast(pa.int32()), pa.array(packed, pa.binary())], ["id", "low", "tox", "features"]
            )

    return run


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", prefix: str = "", with_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with its statistics, ``base_failed``, ``p_low_quality``, ``p_toxic`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows.
    ``kept``: not base_failed and both probabilities within the fixed thresholds. Null and empty
    texts have no words and fail; very long texts count as a whole; repeated rows each get the same
    result, null ids are of no account, and an empty table gives an empty one. Columns of ``docs``
    with the new names raise ValueError; give a ``prefix`` then. Without ``with_text`` the text
    stays behind, which saves its way back.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_low_quality", "p_toxic", "kept"]
    names = [prefix + n for n in added]
    columns = [c for c in docs.columns if with_text or c != text_col]
    if clash := [n for n in names if n in columns]:
        raise ValueError(f"columns exist already: {clash}")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(n, kind) for n, kind in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low_quality, toxic = (Classifier(*m) for m in shared.value)
        for batch in batches:
            for i, data, offsets in K.slices(batch.column(text_col), SLICE):
                n = len(offsets) - 1
                _, out = text_stats(data, offsets)
                doc, feature = features(data, offsets)
                failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                p, q = low_quality.probability(doc, feature, n), toxic.probability(doc, feature, n)
                kept = ~failed & (p <= MOST_LOW_QUALITY) & (q <= MOST_TOXIC)
                part = batch.slice(i, n)
                values = [pa.array(out[c].astype(np.int64)) for c in added[:5]] + [pa.array(failed), pa.array(p), pa.array(q), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + values, [*columns, *names])

    return docs.mapInArrow(tidy(run), schema)
