"""Packing of documents into fixed-length token sequences by length patterns.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. Patterns of two or three lengths that fill a sequence exactly are
enumerated, and non-negative least squares fits how often each is used to the
histogram. The fit is rounded down and clipped to what is there; best fit, largest lengths first, packs the residual counts. The plan
says for each length which ranks go to which sequences and offsets, so its
size depends on the capacity alone; pieces look it up by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import Keyed, saved, with_keys
from tessera.llm.text_kernels import return_memory, tidy
from tessera.llm.token_ids import encoder, vocabulary_path

CAPACITY = 2048
FIT_STEPS = 100
#: Numbering goes in chunks of so many rows at least, and at most so many chunks, whatever the skew of lengths.
CHUNK_ROWS, MOST_CHUNKS = 2000, 4096


def length_patterns(counts: np.ndarray) -> np.ndarray:
    """Rows (a, b, c) of lengths that occur, a >= b >= c, with a sum of the capacity; c may be 0."""
    capacity = len(counts) - 1
    have = np.flatnonzero(counts[:capacity])
    have = have[have > 0]
    there = counts > 0
    a = have[2 * have >= capacity]
    pairs = np.stack([a, capacity - a, np.zeros_like(a)], 1)[there[capacity - a] & (a < capacity)]
    x, y = np.meshgrid(have, have, indexing="ij")
    ok = (x >= y) & (x + y < capacity) & (capacity - x - y <= y)
    x, y = x[ok], y[ok]
    triples = np.stack([x, y, capacity - x - y], 1)[there[capacity - x - y]]
    return np.concatenate([pairs, triples])


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative repeats x with patterns' x = counts as nearly as least squares gets, by multiplicative updates."""
    if not len(patterns):
        return np.zeros(0)
    n = len(counts)
    target = counts.astype(float)
    target[0] = 0
    flat = patterns.reshape(-1)
    used = (patterns > 0).astype(float)
    back = lambda v: (v[patterns] * used).sum(1)
    x = np.full(len(patterns), target.sum() / max(used.sum(), 1))
    up = back(target)
    for _ in range(steps):
        made = np.bincount(flat, (x[:, None] * used).reshape(-1), n)
        made[0] = 0
        x *= up / np.maximum(back(made), 1e-9)
    return x


class Plan:
    """Placements by length: pieces of ``length`` with ranks from ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: the number of pieces of each length, from 0 to the capacity."""
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        self.next_rank = np.zeros(len(counts), np.int64)
        self.sequences = 0
        self.entries: list[tuple[int, int, int, int]] = []
        self._place([self.capacity], int(self.left[self.capacity]))
        patterns = length_patterns(self.left)
        fitted = fit_repeats(patterns, self.left)
        repeats = np.floor(fitted).astype(np.int64)  # what is fitted to less than one use goes to the residual
        order = np.argsort(-repeats, kind="stable")
        for i in order[: np.count_nonzero(repeats)].tolist():
            lengths = [x for x in patterns[i].tolist() if x]
            most = min(int(self.left[x]) // lengths.count(x) for x in lengths)
            self._place(lengths, min(int(repeats[i]), most))
        self._best_fit()

    def _take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.entries.append((length, int(self.next_rank[length]), sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def _place(self, lengths: list[int], n: int) -> None:
        if n <= 0:
            return
        offset = 0
        for length in lengths:
            self._take(length, n, self.sequences, offset)
            offset += length
        self.sequences += n

    def _best_fit(self) -> None:
        """Runs of sequences (first, number) by their free space; each run is split when only a part gets a piece."""
        free: dict[int, list[tuple[int, int]]] = {}
        spaces = np.zeros(self.capacity + 1, np.int64)

        def add(space: int, first: int, n: int) -> None:
            if space:
                free.setdefault(space, []).append((first, n))
                spaces[space] += n

        for length in np.flatnonzero(self.left)[::-1].tolist():
            while (n := int(self.left[length])) > 0:
                fits = np.flatnonzero(spaces[length:])
                if not len(fits):
                    opened = -(-n // (self.capacity // length))
                    add(self.capacity, self.sequences, opened)
                    self.sequences += opened
                    continue
                space = length + int(fits[0])
                first, there = free[space].pop()
                spaces[space] -= there
                used = min(n, there)
                self._take(length, used, first, self.capacity - space)
                add(space - length, first, used)
                if used < there:
                    add(space, first + used, there - used)

    def table(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), sorted."""
        return np.array(sorted(self.entries), np.int64).reshape(-1, 4)


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_many = encoder(path).encode_many
        end = int(end_id).to_bytes(4, "little")
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for i, ids in zip(part.column("id").to_pylist(), encode_many(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        size = n % capacity or capacity if not start else capacity
                        rows.append((i, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                        start, piece = start + size, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 48) | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            columns = [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])], names)

    return run


def pack_documents(docs: DataFrame | Keyed, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id, piece int, start, length, ids_crc32, sequence_id, offset long) of each piece.

    A document is the ids of its whole text, then ``end_id``; null and empty texts are ``end_id``
    alone. Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids; the
    first piece takes what is over. Sequences are filled without gaps from offset 0. ``ids_crc32``
    is over the piece's little-endian 32-bit ids; the strings of special tokens count as these
    tokens, as the tokenizer itself has it. Each row is a document of its own, whether it shares its
    id, has none, or a string. Very long texts are packed as a whole; an empty table gives an empty
    one. Other columns of ``docs`` are left aside. ``vocabulary`` is a tokenizer file.
    """
    keyed = with_keys(docs, id_col)
    spark = keyed.rows.sparkSession
    one = keyed.texts(text_col)
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    pieces = saved(one.mapInArrow(tidy(_pieces(vocabulary or vocabulary_path(), end_id, capacity)), schema), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    shared = spark.sparkContext.broadcast(Plan(counts).table())
    return_memory()  # of the driver
    chunks = min(MOST_CHUNKS, 1 + int(counts.sum()) // CHUNK_ROWS)
    dealt = pieces.withColumn("chunk", F.pmod(F.xxhash64("id", "piece"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "chunk").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("id", "piece")) - 1
    ranked = dealt.withColumn("local", local).join(bases, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(tidy(_placed(shared)), schema + ", sequence_id long, offset long")
    return keyed.named(placed, "id")
