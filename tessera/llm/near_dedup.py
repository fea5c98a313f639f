"""Near-duplicate documents by min-max hashing.

Under each of ``PERMUTATIONS`` permutations of the shingle hashes both the
minimum and the maximum are kept: two values, each equal for two sets with a
probability of their Jaccard similarity, for one evaluation. Bands of ``ROWS``
values bring candidates together (a pair at 0.8 shares one of 32 bands but for
5 cases in 10^8); one bit of each value makes a sketch that turns away pairs
far below the threshold; whole shingle sets confirm every link.

Documents with equal sets are one class and only its least id goes on. In each
bucket all members are first compared with one of them, drawn by a hash. When
the confirmed links are joined to components, buckets with several components
are left; there, members outside the largest one are compared with one of its
members, for some rounds: first with the one that has most links so far, which in a
group of edited copies is the original, then with a drawn one. Last, pairs that share a
bucket and are still in different components are compared, each in the first bucket
that it shares only, unless a finer sketch of 4096 bits turns
them away; so no link between components is lost and
groups of thousands of copies cost a few comparisons a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text_kernels as K
from tessera.llm.components import components
from tessera.llm.tables import Keyed, discard, packed, saved, unpack_text, with_keys
from tessera.llm.text_kernels import tidy

PERMUTATIONS = 64
ROWS = 4
SLICE = 1 << 19
#: A sketch has one bit of each of the 2 * PERMUTATIONS values, in 64-bit words.
WORDS = 2 * PERMUTATIONS // 64
#: A pair at the threshold passes a sketch that differs in so many standard deviations more bits than expected.
DEVIATIONS = 6.0
#: Documents that are still apart get a finer sketch, one bit of each of 2 * FINE values, and these deviations.
FINE = 2048
FINE_DEVIATIONS = 5.0
#: Rounds of comparisons with one member of each bucket, before the pairs that are still apart.
ROUNDS = 2
U = np.uint64
_SEEDS = np.random.default_rng(77).integers(0, 2**63, (2, PERMUTATIONS), dtype=np.int64).astype(U)
_FACTORS, _SHIFTS = _SEEDS[0] * U(2) + U(1), _SEEDS[1]
_FINE_SEEDS = np.random.default_rng(78).integers(0, 2**63, (2, FINE), dtype=np.int64).astype(U)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document's shingles, back to back, and their number for each document.

    A document with 1 to k - 1 words has one shingle, its whole sequence.
    """
    w = K.words(data, offsets)
    h = K.run_hashes(data, w.start, w.end, lower=True)
    grams, at = K.gram_hashes(h, w, k)
    borders = np.searchsorted(at, np.append(w.first, len(h)))
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    sets = [np.sort(grams[a:b]) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    for d in short.tolist():
        sets[d] = K.gram_hashes(h[w.first[d] : w.first[d] + w.count[d]], K.Runs(w.start[:0], w.end[:0], w.count[d : d + 1], np.zeros(1, np.int64)), int(w.count[d]))[0]
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    start = np.cumsum(size) - size
    first[start[size > 0]] = True
    sums = np.concatenate([[0], np.cumsum(first)])
    return flat[first], sums[start + size] - sums[start]


def signatures(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: digests (n, 2), bit sketches (n, WORDS) and band keys (n, bands)."""
    start = np.cumsum(size) - size
    values = np.empty((len(size), 2 * PERMUTATIONS), U)
    for p in range(PERMUTATIONS):
        x = flat * _FACTORS[p] + _SHIFTS[p]
        values[:, 2 * p] = np.minimum.reduceat(x, start)
        values[:, 2 * p + 1] = np.maximum.reduceat(x, start)
    mixed = K.mix(values + np.arange(2 * PERMUTATIONS, dtype=U))
    bits = (mixed >> U(63)).reshape(len(size), WORDS, 64)
    sketch = (bits << np.arange(64, dtype=U)).sum(2, dtype=U)
    bands = np.zeros((len(size), 2 * PERMUTATIONS // ROWS), U)
    for r in range(ROWS):
        bands = bands * U(0x9E3779B97F4A7C15) + mixed[:, r::ROWS]
    digest = np.stack([np.add.reduceat(K.mix(flat), start), np.add.reduceat(K.mix(flat ^ U(0x5555555555555555)), start)], 1)
    return digest, sketch, K.mix(bands)


def fine_bits(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit words (n, 2 * FINE / 64) with one bit of the minimum and the maximum under each of FINE permutations."""
    start = np.cumsum(size) - size
    bits = np.empty((len(size), 2 * FINE), np.uint8)
    for p in range(FINE):
        x = flat * (_FINE_SEEDS[0, p] * U(2) + U(1)) + _FINE_SEEDS[1, p]
        bits[:, 2 * p] = K.mix(np.minimum.reduceat(x, start)) >> U(63)
        bits[:, 2 * p + 1] = K.mix(np.maximum.reduceat(x, start)) >> U(63)
    return np.packbits(bits, axis=1).view(np.int64)


_FINE = [f"f{j + 1}" for j in range(2 * FINE // 64)]
_SKETCH = [f"s{j + 1}" for j in range(WORDS)]
_META = f"id long, n long, d1 long, d2 long, {', '.join(f'{s} long' for s in _SKETCH)}, bands array<long>"


def _meta(k: int):
    names = ["id", "n", "d1", "d2", *_SKETCH, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in K.slices(batch.column("text"), SLICE):
                n = len(offsets) - 1
                flat, size = shingle_sets(data, offsets, k)
                full = np.flatnonzero(size)
                digest, sketch = np.zeros((n, 2), U), np.zeros((n, WORDS), U)
                lists = np.zeros(n + 1, np.int32)
                keys = np.zeros(0, U)
                if len(full):
                    digest[full], sketch[full], bands = signatures(flat, size[full])
                    keys = bands.reshape(-1)
                    lists[full + 1] = bands.shape[1]
                columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (*digest.T, *sketch.T)]
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum(lists, dtype=np.int32)), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, n), pa.array(size), *columns, listed], names)

    return run


def _fine(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = pa.array([unpack_text(x) for x in part.column("packed").to_pylist()], pa.large_binary())
                words = np.concatenate([fine_bits(*shingle_sets(data, offsets, k)) for _, data, offsets in K.slices(texts, SLICE)])
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in words.T)], ["id", *_FINE])

    return run


def _confirm(k: int, percent: int):
    """Of (a, b, text_a, text_b), the pairs whose sets are similar enough."""

    def sets_of(texts: list[bytes]) -> list[np.ndarray]:
        out = []
        for _, data, offsets in K.slices(pa.array(texts, pa.large_binary()), SLICE):
            flat, size = shingle_sets(data, offsets, k)
            ends = np.cumsum(size)
            out += [flat[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                texts = dict(zip(a, part.column("text_a").to_pylist(), strict=True)) | dict(zip(b, part.column("text_b").to_pylist(), strict=True))
                sets = dict(zip(texts, sets_of([unpack_text(t) for t in texts.values()]), strict=True))
                ok = []
                for x, y in zip(a, b, strict=True):
                    both = np.sort(np.concatenate([sets[x], sets[y]]))
                    common = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * common >= percent * (len(both) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _close(x: str, y: str, percent: int):
    """Sizes that allow the similarity, and sketches that differ in few enough bits."""
    differ, values = (1 - percent / 100) / 2, 2 * PERMUTATIONS
    most = int(values * differ + DEVIATIONS * (values * differ * (1 - differ)) ** 0.5)
    sizes = (100 * F.least(f"{x}.n", f"{y}.n")) >= (percent * F.greatest(f"{x}.n", f"{y}.n"))
    bits = sum(F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SKETCH)
    return sizes & (bits <= most)


def _closer(x: str, y: str, percent: int):
    """Fine sketches that differ in few enough bits; the first quarter alone, at DEVIATIONS, turns most pairs away."""
    differ = (1 - percent / 100) / 2

    def within(columns: list[str], deviations: float):
        n = 64 * len(columns)
        bits = F.expr(" + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in columns))
        return bits <= int(n * differ + deviations * (n * differ * (1 - differ)) ** 0.5)

    return within(_FINE[: len(_FINE) // 4], DEVIATIONS) & within(_FINE, FINE_DEVIATIONS)


def _as_links(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("component").alias("a"), F.col("id").alias("b"))


def near_duplicates(docs: DataFrame | Keyed, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles long, component_id, kept boolean), one row for each row of ``docs``.

    A document's set has its distinct shingles of ``k`` lower-cased words; a text with fewer words
    is one shingle; null texts and texts without words are empty and linked with nothing. Two
    documents are linked if 100 * intersection >= ``percent`` * union; ``component_id`` is the
    least id that a document reaches, and that document is ``kept``. Each row is a document: of rows
    that share an id one comes first, and that alone can be kept; a null id counts as the least; ids
    may be strings. Very long texts count as a whole; an empty table gives an empty one. Other columns
    of ``docs`` are left aside.
    """
    if not 50 <= percent <= 100 or k < 1:
        raise ValueError("percent must be between 50 and 100, k at least 1")
    keyed = with_keys(docs, id_col)
    one = keyed.texts(text_col)
    meta = saved(one.mapInArrow(tidy(_meta(k)), _META), "near-meta")
    classes = meta.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    named = saved(meta.select("id", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "near-classes")
    reps = saved(meta.filter("n > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", *_SKETCH, "bands"), "near-reps")
    discard(meta)
    texts = packed(one)

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("text_a")), "a")
        with_both = with_a.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("text_b")), "b")
        return with_both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_confirm(k, percent)), "a long, b long")

    def pairs_of(joined: DataFrame) -> DataFrame:
        return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def mixed(members: DataFrame, stars: DataFrame) -> DataFrame:
        """Members of the buckets with several components, and each bucket's largest component as ``main``."""
        placed = members.join(stars, "id", "left").withColumn("component", F.coalesce("component", "id"))
        sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        kinds = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
        return saved(placed.join(kinds.select("bucket", F.col("most.component").alias("main")), "bucket"), "near-open")

    def led(members: DataFrame, number: int) -> DataFrame:
        """Each bucket's leader is drawn by a hash, so that a document meets other leaders in other buckets."""
        draw = F.struct(F.xxhash64("bucket", "id", F.lit(number)).alias("draw"), "id", "n", "s1", "s2")
        leaders = members.groupBy("bucket").agg(F.min(draw).alias("lead")).select("bucket", "lead.*")
        return members.alias("x").join(leaders.alias("y"), "bucket").filter((F.col("x.id") != F.col("y.id")) & _close("x", "y", percent))

    def led_by_main(members: DataFrame, links: DataFrame, number: int) -> DataFrame:
        """Members outside a bucket's largest component and one member of it: in odd rounds the one with most links."""
        kept = members.filter("component = main")
        if number % 2:
            ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
            kept = kept.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left")
        first = F.coalesce(F.col("degree"), F.lit(0)) if number % 2 else F.lit(0)
        draw = F.struct(first.alias("first"), F.xxhash64("bucket", "id", F.lit(number)).alias("draw"), "id", "n", "s1", "s2")
        leaders = kept.groupBy("bucket").agg(F.max(draw).alias("lead")).select("bucket", "lead.*")
        return members.filter("component != main").alias("x").join(leaders.alias("y"), "bucket").filter(_close("x", "y", percent))

    members = reps.select(F.posexplode("bands").alias("at", "bucket"), "id", "n", "s1", "s2")
    compared = saved(pairs_of(led(members, 0)), "near-pairs")
    links = saved(confirmed(compared), "near-links")
    stars = components(links, "near-stars")
    members = mixed(members, stars)
    for number in range(1, ROUNDS):
        new = saved(pairs_of(led_by_main(members, links, number)).join(compared, ["a", "b"], "left_anti"), "near-pairs")
        compared = compared.unionByName(new)
        found = saved(confirmed(new), "near-links")
        links = links.unionByName(found)
        stars = components(_as_links(stars).unionByName(found), "near-stars")
        before, members = members, mixed(members.drop("component", "main"), stars)
        discard(before)
    # In each bucket, members outside its largest component meet all members of other components. A pair
    # counts in the first bucket that it shares only, so it comes once, however many it shares.
    apart_ids = members.select("id").distinct()
    fine = saved(texts.join(apart_ids, "id", "left_semi").mapInArrow(tidy(_fine(k)), f"id long, {', '.join(f'{c} long' for c in _FINE)}"), "near-fine")
    wide = members.join(fine, "id").join(reps.select("id", "bands"), "id")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
    earlier = F.expr("arrays_overlap(slice(x.bands, 1, x.at), slice(y.bands, 1, y.at))")
    second = wide.filter("component != main").alias("x").join(wide.alias("y"), "bucket").filter(apart & _close("x", "y", percent) & _closer("x", "y", percent) & ~earlier)
    more = saved(confirmed(saved(pairs_of(second).join(compared, ["a", "b"], "left_anti"), "near-rest")), "near-more")

    found = components(_as_links(stars).unionByName(more), "near-components")
    out = named.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return keyed.named(out.withColumn("kept", F.col("id") == F.col("component_id")), "id", "component_id")
