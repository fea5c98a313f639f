"""Labelled clips in blocks of numbers, so that a pass over them is arithmetic on arrays.

A row holds up to BLOCK clips of one fold: their labels, and for each expert the places of its clips, their features and
confidences as doubles. Clips are sorted by id and packed by the tasks as batches arrive; a task holds one unfinished block for each fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.scalar import finite
from tessera.sources.store import kept

#: Clips of a block.
BLOCK = 16_384
_LISTS = ("at", "x", "confidence", "rule_at", "rule_score", "rule_confidence")


class Block(NamedTuple):
    """Clips of one fold: ``experts`` has for each expert the places of its clips, features (feature, clip) and confidences, ``rules``
    places, scores and confidences of findings whose score is given; NaN where there is none."""

    fold: int
    clips: pa.Array | None
    y: np.ndarray
    experts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    rules: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


class _Open:
    """A block that is being filled."""

    def __init__(self, fold: int) -> None:
        self.fold, self.n = fold, 0
        self.clips: list[pa.Array] = []
        self.y: list[np.ndarray] = []
        self.cells: dict[tuple[bool, str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        out: dict[str, object] = {"fold": self.fold, "y": np.concatenate(self.y).astype(np.int8).tobytes()}
        for rule, first in ((False, ""), (True, "rule_")):
            names = sorted(e for r, e in self.cells if r == rule)
            own = [[np.concatenate(v, -1) for v in zip(*self.cells[rule, e], strict=True)] for e in names]
            out |= {f"{first}experts": names, f"{first}at": [a.astype(np.int32).tobytes() for a, _, _ in own], f"{first}score" if rule else "x": [np.ascontiguousarray(v).tobytes() for _, v, _ in own], f"{first}confidence": [c.tobytes() for _, _, c in own]}
        clips = pa.ListArray.from_arrays(pa.array([0, self.n], pa.int32()), pa.concat_arrays(self.clips))
        return pa.RecordBatch.from_arrays([clips if f.name == "clips" else pa.array([out[f.name]], f.type) for f in schema], schema=schema)


def _places(open_: dict[int, _Open], table: pa.Table, fixed: Sequence[str], labelled: bool) -> None:
    """Adds all rows of whole clips to the blocks of their folds; without labels, fold 0 has every clip with a score or with features."""
    clip, expert, x = (table.column(c).combine_chunks() for c in ("clip", "expert", "x"))
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    starts = np.append(0, np.flatnonzero(pc.not_equal(clip[1:], clip[:-1]).to_numpy(zero_copy_only=False)) + 1)
    g = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(clip))))
    coded = expert.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    fits = x.is_valid().to_numpy(zero_copy_only=False)
    label, found = code < 0, (code >= 0) & ~fits
    y, fold, confidence = np.zeros(len(starts)), np.full(len(starts), -1.0), np.full((len(starts), len(names) + 1), np.nan)
    y[g[label]], fold[g[label]] = a[label], b[label]
    if not labelled:
        fold[g[fits | (found & np.isin(code, [k for k, e in enumerate(names) if e in fixed]))]] = 0
    confidence[g[found], code[found]] = a[found]
    ends, values = x.offsets.to_numpy() - x.offsets[0].as_py(), x.flatten().to_numpy(zero_copy_only=False).astype(float)
    cells = []
    for k, e in enumerate(names):
        own = np.flatnonzero(fits & (code == k))
        if len(own):
            width = ends[own[0] + 1] - ends[own[0]]
            cells.append((False, e, g[own], values[ends[own] + np.arange(width)[:, None]], confidence[g[own], k]))
        own = np.flatnonzero(found & (code == k)) if e in fixed else own[:0]
        if len(own):
            cells.append((True, e, g[own], b[own], a[own]))
    for f in np.unique(fold[fold >= 0]):
        mine = fold == f
        block = open_.setdefault(int(f), _Open(int(f)))
        place = np.cumsum(mine) - 1 + block.n
        for rule, e, at, v, c in cells:
            some = mine[at]
            if some.any():
                block.cells.setdefault((rule, e), []).append((place[at[some]], v[..., some], c[some]))
        block.clips.append(clip.take(pa.array(starts[mine])))
        block.y.append(y[mine])
        block.n += int(mine.sum())


def blocks(rows: DataFrame, found: DataFrame, folds: DataFrame | None, fixed: Sequence[str] = ()) -> DataFrame:
    """Blocks of all clips of folds (clip, y, fold), from rows (clip, expert, x) and findings (clip, expert, confidence); those of experts in
    ``fixed`` keep the score that they have. Without folds, of all clips that rows or these findings have."""
    labelled = folds is not None
    of = (folds if labelled else rows).schema["clip"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    score = finite(F.when(F.col("expert").isin(*fixed), F.col("score"))) if fixed and "score" in found.columns else none("double")
    kinds = t.StructType([t.StructField(n, k) for n, k in (
        ("fold", t.LongType()), ("clips", t.ArrayType(of)), ("y", t.BinaryType()), *((n, t.ArrayType(t.StringType())) for n in ("experts", "rule_experts")), *((n, t.ArrayType(t.BinaryType())) for n in _LISTS)
    )])
    schema = pa.schema([(f.name, pa.list_(to_arrow_type(of)) if f.name == "clips" else to_arrow_type(f.dataType)) for f in kinds])

    size = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, _Open] = {}
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            new = new if rest is None else pa.concat_tables([rest, new])
            clip = new.column("clip").combine_chunks()
            whole = pc.index(pc.equal(clip, clip[-1]), True).as_py()  # the last clip may go on in the next batch
            rest = new.slice(whole)
            if whole:
                _places(open_, new.slice(0, whole).combine_chunks(), fixed, labelled)
            for f in [f for f, o in open_.items() if o.n >= size]:
                yield open_.pop(f).row(schema)
        if rest is not None:
            _places(open_, rest.combine_chunks(), fixed, labelled)
        for o in open_.values():
            yield o.row(schema)

    empty = none("array<double>").alias("x")
    whole = rows.select(F.col("clip").cast(of), "expert", "x", none("double").alias("a"), none("double").alias("b"))
    whole = whole.unionByName(found.filter("expert is not null").select(F.col("clip").cast(of), "expert", empty, F.col("confidence").cast("double").alias("a"), score.alias("b")))
    if labelled:
        whole = whole.unionByName(folds.select("clip", none("string").alias("expert"), empty, F.col("y").cast("double").alias("a"), F.col("fold").cast("double").alias("b")))
    return kept(whole.filter("clip is not null").repartition("clip").sortWithinPartitions("clip").mapInArrow(run, kinds))


def _numbers(v: pa.Scalar, kind: type = float) -> np.ndarray:
    return np.frombuffer(v.as_buffer(), kind).copy()  # what lies in a batch may not be aligned


def read(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of batches of some of their columns."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}

            def cells(first: str, value: str) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
                out = {}
                for k, e in enumerate(row[f"{first}experts"].as_py() if f"{first}experts" in row else []):  # noqa: B023
                    at, v, c = (row[n].values[k] if n in row else None for n in (f"{first}at", value, f"{first}confidence"))  # noqa: B023
                    at, v = _numbers(at, np.int32), _numbers(v)
                    out[e] = (at, v if first else v.reshape(len(v) // max(len(at), 1), len(at)), np.full(len(at), np.nan) if c is None else _numbers(c))
                return out

            yield Block(row["fold"].as_py(), row["clips"].values if "clips" in row else None, np.frombuffer(row["y"].as_buffer(), np.int8).astype(float), cells("", "x"), cells("rule_", "rule_score"))


def unpacked(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (clip, expert, x) and the findings (clip, expert, score, confidence) that blocks hold."""
    of = packed.schema["clips"].dataType.elementType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read(batches):
            for e, (at, x, _) in block.experts.items():
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(x)), pa.array(np.ascontiguousarray(x.T).reshape(-1), from_pandas=True))
                yield pa.RecordBatch.from_arrays([block.clips.take(pa.array(at)), pa.array([e] * len(at), pa.string()), values], ["clip", "expert", "x"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read(batches):
            for e, at, score, confidence in (*((e, at, np.full(len(at), np.nan), c) for e, (at, _, c) in block.experts.items()), *((e, *own) for e, own in block.rules.items())):
                yield pa.RecordBatch.from_arrays([block.clips.take(pa.array(at)), pa.array([e] * len(at), pa.string()), *(pa.array(v, from_pandas=True) for v in (score, confidence))], ["clip", "expert", "score", "confidence"])

    kinds = lambda *more: t.StructType([t.StructField("clip", of), t.StructField("expert", t.StringType()), *(t.StructField(n, k) for n, k in more)])
    return packed.mapInArrow(rows, kinds(("x", t.ArrayType(t.DoubleType())))), packed.mapInArrow(found, kinds(("score", t.DoubleType()), ("confidence", t.DoubleType())))


def summed(found: DataFrame, of_block: Callable[[Block], Iterable[tuple[str, np.ndarray]]]) -> dict[str, np.ndarray]:
    """The sums of the named vectors that ``of_block`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in read(batches):
            for m, v in of_block(block):
                total[m] = total.get(m, 0.0) + v
        for m, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(v)), pa.array(np.arange(len(v)), pa.int64()), pa.array(v)], ["model", "place", "value"])

    out: dict[str, list[float]] = {}
    for r in found.mapInArrow(run, "model string, place long, value double").groupBy("model", "place").agg(F.sum("value").alias("v")).orderBy("model", "place").collect():
        out.setdefault(r["model"], []).append(r["v"])
    return {m: np.array(v) for m, v in out.items()}
