"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are lower-cased runs of ASCII letters, digits and anything beyond ASCII.
Their frequencies over all documents, in hashed bins, say how often an n-gram
of a test item would occur in a document by chance; those below
``MOST_BY_CHANCE``, and each item's rarest few, are its seeds. A bit map of
fixed size lets only passages around possible seeds leave the scan of the
documents; an equi-join with the seeds names their items; and a local
alignment of words scores each passage against each named item, so that edited
and paraphrased copies count by what is left of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text_kernels as K
from tessera.llm.quality import NOT_WORD
from tessera.llm.tables import pack_text, saved, unused, unpack_text, with_keys
from tessera.llm.text_kernels import tidy

N = 3
MOST_BY_CHANCE = 1e-4
LEAST_SEEDS = 4
BIN_BITS = 16
MAP_BITS = 24
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.5
#: Longer test items are aligned in pieces of nearly equal length, of so many words at most, each scored for itself.
LONGEST = 256
U = np.uint64


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, K.Runs]:
    low = K.LOWER[data]
    runs = K.words(low, offsets, NOT_WORD)
    return K.run_hashes(low, runs.start, runs.end), runs


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task: its word counts by bin."""
    count = np.zeros(1 << BIN_BITS, np.int64)
    docs = 0
    for batch in batches:
        docs += batch.num_rows
        for _, data, offsets in K.slices(batch.column("text"), 1 << 19):
            h, _ = word_hashes(data, offsets)
            count += np.bincount((h >> U(64 - BIN_BITS)).astype(np.int64), minlength=1 << BIN_BITS)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([docs]), pa.array([pack_text(count.tobytes())], pa.binary())], ["part", "docs", "pack"])


def _sum_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, docs = np.zeros(1 << BIN_BITS, np.int64), 0
    for batch in batches:
        docs += sum(batch.column("docs").to_pylist())
        for x in batch.column("pack").to_pylist():
            count += np.frombuffer(unpack_text(x), np.int64)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([docs]), pa.array([pack_text(count.tobytes())], pa.binary())], ["part", "docs", "pack"])


def _items(count: np.ndarray, docs: int):
    """Pieces of test items (item, piece, words) with their seeds."""
    total = max(int(count.sum()), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.column("id").to_pylist()
            for i, data, offsets in K.slices(batch.column("text")):
                h, w = word_hashes(data, offsets)
                share = np.log(np.maximum(count[(h >> U(64 - BIN_BITS)).astype(np.int64)], 0.5) / total)
                for d in range(len(w.count)):
                    first, total_words = int(w.first[d]), int(w.count[d])
                    pieces = -(-total_words // LONGEST)
                    for piece in range(pieces):
                        own = slice(first + piece * total_words // pieces, first + (piece + 1) * total_words // pieces)
                        n = own.stop - own.start
                        if n < N:
                            continue
                        seeds = K.gram_hashes(h[own], K.Runs(w.start[:0], w.end[:0], np.array([n]), np.array([0])), N)[0]
                        chance = sum(share[own][j : n - N + 1 + j] for j in range(N)) + np.log(total / max(docs, 1))
                        order = np.argsort(chance, kind="stable")
                        least = max(LEAST_SEEDS, int((chance < np.log(MOST_BY_CHANCE)).sum()))
                        rows.append((ids[i + d], piece, h[own].tobytes(), np.unique(seeds[order[:least]]).view(np.int64).tolist()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["item", "piece", "item_words", "seeds"])

    return run


def _slots(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> U(64 - MAP_BITS)).astype(np.int64)


def _bit_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        bits[_slots(batch.column("seed").to_numpy(zero_copy_only=False).view(U))] = True
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([pack_text(np.packbits(bits).tobytes())], pa.binary())], ["part", "pack"])


def _or_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for batch in batches:
        for x in batch.column("pack").to_pylist():
            bits |= np.frombuffer(unpack_text(x), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([pack_text(bits.tobytes())], pa.binary())], ["part", "pack"])


def _passages(shared, margin: int):
    """(id, start, words, seeds): runs of possible seeds no more than ``margin`` words apart, with as many words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(unpack_text(shared.value), np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, data, offsets in K.slices(batch.column("text"), 1 << 19):
                h, w = word_hashes(data, offsets)
                grams, at = K.gram_hashes(h, w, N)
                hit = np.flatnonzero(bits[_slots(grams)])
                place, doc = at[hit], w.doc()[at[hit]]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > margin)]) if len(hit) else np.zeros(0, bool)
                cut = np.flatnonzero(new)
                rows = []
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hit)], strict=False):
                    d = int(doc[a])
                    lo, hi = max(int(w.first[d]), int(place[a]) - margin), min(int(w.first[d] + w.count[d]), int(place[b - 1]) + N + margin)
                    rows.append((ids[i + d], lo - int(w.first[d]), h[lo:hi].tobytes(), np.unique(grams[hit[a:b]]).view(np.int64).tolist()))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "words", "seeds"])

    return run


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(score, first, end) of each pair's best local alignment; first and end are places in the passage.

    Smith-Waterman with linear gaps, row by row over all pairs at once; the gaps along a row are a
    running maximum.
    """
    n, m, size = max(map(len, items)), max(map(len, passages)), len(items)
    a, b = np.zeros((size, n), np.int64), np.ones((size, m), np.int64)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], a[i, len(x) :] = x.view(np.int64), 0
        b[i, : len(y)], b[i, len(y) :] = y.view(np.int64), 1
    before, first_before = np.zeros((size, m + 1), np.int32), np.tile(np.arange(m + 1, dtype=np.int32), (size, 1))
    best, first, end = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * GAP
    rows, cells = np.arange(size), np.arange(m + 1, dtype=np.int32)
    for r in range(n):
        here = np.zeros_like(before)
        origin = np.tile(cells, (size, 1))
        diagonal = before[:, :-1] + np.where(a[:, r : r + 1] == b, MATCH, MISMATCH).astype(np.int32)
        down = before[:, 1:] + GAP
        take = diagonal >= down
        value = np.where(take, diagonal, down)
        up = value > 0
        here[:, 1:] = np.where(up, value, 0)
        origin[:, 1:] = np.where(up, np.where(take, first_before[:, :-1], first_before[:, 1:]), origin[:, 1:])
        level = here - slope
        top = np.maximum.accumulate(level, 1)
        source = np.maximum.accumulate(np.where(level == top, cells, 0), 1)
        before = top + slope
        first_before = np.take_along_axis(origin, source, 1)
        at = before.argmax(1)
        value = before[rows, at]
        better = value > best
        best, first, end = np.where(better, value, best), np.where(better, first_before[rows, at], first), np.where(better, at, end)
    return list(zip(best.tolist(), first.tolist(), end.tolist(), strict=True))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.frombuffer(x, U) for x in batch.column("words").to_pylist()]
        items = [np.frombuffer(x, U) for x in batch.column("item_words").to_pylist()]
        order = sorted(range(len(words)), key=lambda i: (len(words[i]), len(items[i])))
        got: list = [None] * len(words)
        at = 0
        while at < len(order):
            step = max(1, min(256, 500_000 // max(len(words[order[min(at + 255, len(order) - 1)]]), 1)))
            part = order[at : at + step]
            for i, x in zip(part, align([items[i] for i in part], [words[i] for i in part]), strict=True):
                got[i] = (x[0] / (MATCH * len(items[i])), x[1], x[2])
            at += step
        columns = [batch.column(c) for c in ("id", "item", "start")]
        values = [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *values], ["id", "item", "start", "score", "first", "end"])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """(id, item, score, first_word, end_word) for each document and test item that it holds a copy of.

    ``score`` is the best local alignment's share of a perfect one, at least ``least_score``; the
    words are the copy's place in the document. Null and empty texts hold nothing, and items of
    fewer than three words, which chance would find anywhere, are never found; very long texts count as a whole. Each row is a document or an item of its
    own, whether it shares its id, has none, or a string; empty tables give an empty one. Other
    columns of the tables are left aside.
    """
    spark = docs.sparkSession
    keyed, tests = with_keys(docs, id_col), with_keys(items, item_col)
    best = _contaminated(spark, keyed.texts(text_col), tests.texts(item_text_col), least_score)
    return tests.named(keyed.named(best, "id").withColumnRenamed(id_col, "id_of_document"), "item").select(F.col("id_of_document").alias(id_col), F.col("item").alias(item_col), "score", "first_word", "end_word")


def _contaminated(spark: SparkSession, one: DataFrame, tests: DataFrame, least_score: float) -> DataFrame:
    """(id, item, score, first_word, end_word) by keys."""
    # Bins have a fixed size; they are summed in two steps, so that no task gets one row of every other.
    binned = one.mapInArrow(tidy(_bins), "part long, docs long, pack binary").repartition(16).mapInArrow(tidy(_sum_bins), "part long, docs long, pack binary")
    count, n_docs = np.zeros(1 << BIN_BITS, np.int64), 0
    for row in binned.collect():  # at most 16 rows
        count += np.frombuffer(unpack_text(bytes(row["pack"])), np.int64)
        n_docs += row["docs"]
    pieces = saved(tests.mapInArrow(tidy(_items(count, n_docs)), "item long, piece int, item_words binary, seeds array<long>"), "test-items")
    seeds = pieces.select("item", "piece", F.explode("seeds").alias("seed"))
    longest = pieces.agg(F.max(F.length("item_words"))).first()[0]
    margin = (longest or 0) // 8
    maps = seeds.select("seed").mapInArrow(tidy(_bit_map), "part long, pack binary").repartition(1).mapInArrow(tidy(_or_maps), "part long, pack binary")
    bits = maps.first()["pack"] if longest else pack_text(bytes((1 << MAP_BITS) // 8))
    passages = saved(one.mapInArrow(tidy(_passages(spark.sparkContext.broadcast(bytes(bits)), margin)), "id long, start long, words binary, seeds array<long>"), "passages")

    named = passages.select("id", "start", F.explode("seeds").alias("seed")).join(seeds, "seed").select("id", "start", "item", "piece").distinct()
    pairs = named.join(passages.select("id", "start", "words"), ["id", "start"]).join(pieces.select("item", "piece", "item_words"), ["item", "piece"])
    scored = pairs.select("id", "item", "start", "words", "item_words").mapInArrow(tidy(_scored), "id long, item long, start long, score double, first long, end long")
    best = scored.filter(F.col("score") >= least_score).groupBy("id", "item").agg(F.max(F.struct("score", (F.col("start") + F.col("first")).alias("first_word"), (F.col("start") + F.col("end")).alias("end_word"))).alias("best"))
    return best.select("id", "item", "best.*")


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no copy of a test item; see ``contaminated``."""
    keyed, tests = with_keys(docs, id_col), with_keys(items, item_col)
    name = unused("found", keyed.rows)
    found = _contaminated(docs.sparkSession, keyed.texts(text_col), tests.texts(item_text_col), LEAST_SCORE).select(F.col("id").alias(name)).distinct()
    return keyed.rows.join(found, F.col(keyed.key) == F.col(name), "left_anti").select(docs.columns)
