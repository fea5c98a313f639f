"""Areas and detection metrics of many groups of scores that tasks make from blocks of clips.

Scores are never rows. A first pass counts classes and takes every STEP-th of a block's sorted scores, from which the driver cuts
each group into ranges; a second one sends each range's distinct scores, as bytes, to one task, which sorts them and gives its counts, its share of the rank
sum and its points of least cost. The equal error rate lies in one range of each group, which a third pass reads again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.scalar import C_FA, C_MISS, P_SPOOF, check_prior
from tessera.operators.blocks import Block
from tessera.operators.blocks import read as read_blocks

#: Sorted scores between two that may be borders, about so many distinct scores of a range, and bytes that a task gathers before it sends them.
STEP, RANGE, SENT = 512, 500_000, 16 << 20
#: For each group the scores and classes of the clips of a block, or of a batch of plain columns; a score that is NaN doesn't count.
Scores = Callable[[Block | pa.RecordBatch], Iterable[tuple[str, np.ndarray, np.ndarray]]]
Borders = dict[str, np.ndarray]


def rounded(v: float | None, places: int) -> float | None:
    """Halves go up, as in SQL."""
    return None if v is None or not math.isfinite(v) else float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def _reader(source: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterable[Block | pa.RecordBatch]]:
    return read_blocks if "experts" in source.columns else lambda batches: batches


def _tied(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scores, place = np.unique(p[~np.isnan(p)], return_inverse=True)
    n1 = np.bincount(place, y[~np.isnan(p)], len(scores)).astype(np.int64)
    return scores, n1, np.bincount(place, minlength=len(scores)) - n1


def _borders(source: DataFrame, scores: Scores) -> tuple[Borders, dict[str, tuple[int, int]]]:
    """The borders of each group's ranges, and its numbers of synthetic and real clips."""
    step, read = STEP, _reader(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for block in read(batches):
            for group, p, y in scores(block):
                ps, n1, n0 = _tied(p, y)
                own = seen.setdefault(group, [0, 0, 0, []])
                own[0], own[1], own[2] = own[0] + int(n1.sum()), own[1] + int(n0.sum()), own[2] + len(ps)
                own[3].append(ps[step // 2 :: step])
        names = list(seen)
        some = [np.concatenate(seen[g][3]).tobytes() for g in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[g][k] for g in names], pa.int64()) for k in range(3)), pa.array(some, pa.binary())], ["group", "n1", "n0", "n", "some"])

    sizes: dict[str, tuple[int, int]] = {}
    many: dict[str, int] = {}
    some: dict[str, list[np.ndarray]] = {}
    for r in source.mapInArrow(run, "group string, n1 long, n0 long, n long, some binary").collect():
        a, b = sizes.get(r["group"], (0, 0))
        sizes[r["group"]] = (a + r["n1"], b + r["n0"])
        many[r["group"]] = many.get(r["group"], 0) + r["n"]
        some.setdefault(r["group"], []).append(np.frombuffer(r["some"]))
    borders = {}
    for g, parts in some.items():
        every, n = np.sort(np.concatenate(parts)), many[g] // RANGE
        borders[g] = np.unique(every[(np.arange(1, n + 1) * len(every)) // (n + 1)]) if n and len(every) else np.zeros(0)
    return borders, sizes


def _ranges(source: DataFrame, scores: Scores, borders: Borders, of_range: Callable[[str, int, np.ndarray, np.ndarray, np.ndarray], dict[str, float]], kinds: str, only: dict[str, int] | None = None) -> list[dict[str, object]]:
    """What ``of_range(group, range, p, n1, n0)`` says of each range's distinct scores in ascending order; a score on a border is of the range above. ``only``: one range of each group."""
    names, read = sorted(borders), _reader(source)
    first = dict(zip(names, np.cumsum([0, *(len(borders[g]) + 1 for g in names)]).tolist(), strict=False))
    count = sum(len(b) + 1 for b in borders.values()) if only is None else len(only)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            packed = [b"".join(np.concatenate(v).astype(kind).tobytes() for v, kind in zip(zip(*own, strict=True), (float, np.int32, np.int32), strict=True)) for own in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["place", "found"])

        for block in read(batches):
            for group, p, y in scores(block):
                if only is not None and group not in only:
                    continue
                ps, n1, n0 = _tied(p, y)
                ends = [0, *np.searchsorted(ps, borders[group]).tolist(), len(ps)]
                for k in range(len(ends) - 1) if only is None else (only[group],):
                    a, b = ends[k], ends[k + 1]
                    if a < b:
                        held.setdefault(first[group] + k, []).append((ps[a:b], n1[a:b], n0[a:b]))
                        size += 16 * (b - a)
            if size > SENT:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = -1, []

        def done() -> pa.RecordBatch:
            group = max((g for g in names if first[g] <= now), key=first.__getitem__)
            p, n1, n0 = (np.concatenate(v) for v in zip(*own, strict=True))
            scores, place = np.unique(p, return_inverse=True)
            n1, n0 = (np.bincount(place, n, len(scores)).astype(np.int64) for n in (n1, n0))
            row = {"group": group, "range": now - first[group], **of_range(group, now - first[group], scores, n1, n0)}
            return pa.RecordBatch.from_pylist([row], pa.schema([(k, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for k, t in (c.split() for c in whole.split(", "))]))

        for batch in batches:
            for place, found in zip(batch.column("place").to_pylist(), batch.column("found"), strict=True):
                if place != now and own:
                    yield done()
                    own = []
                now, bytes_ = place, found.as_py()
                n = len(bytes_) // 16
                own.append((np.frombuffer(bytes_, float, n), np.frombuffer(bytes_, np.int32, n, 8 * n), np.frombuffer(bytes_, np.int32, n, 12 * n)))
        if own:
            yield done()

    whole = f"group string, range long, {kinds}"
    sent = source.mapInArrow(send, "place long, found binary").repartition(max(1, min(count, 2000)), "place").sortWithinPartitions("place")
    return [r.asDict() for r in sent.mapInArrow(gather, whole).orderBy("group", "range").collect()]


def _sums(n1: np.ndarray, n0: np.ndarray) -> dict[str, int]:
    """Counts of a range and twice its rank sum, as whole numbers."""
    return {"n1": int(n1.sum()), "n0": int(n0.sum()), "wins": int((n1 * (2 * (np.cumsum(n0) - n0) + n0)).sum())}


def _area(rows: list[dict[str, object]], n1: int, n0: int) -> float | None:
    wins = below = 0
    for r in rows:
        wins, below = wins + r["wins"] + 2 * r["n1"] * below, below + r["n0"]
    return wins / (2 * n1 * n0) if n1 and n0 else None


def areas(source: DataFrame, scores: Scores) -> dict[str, tuple[float | None, int, int]]:
    """The area under each group's curve, None for one class, and its numbers of synthetic and real clips; a tie counts half."""
    borders, sizes = _borders(source, scores)
    rows = _ranges(source, scores, borders, lambda g, k, p, n1, n0: _sums(n1, n0), "n1 long, n0 long, wins long")
    return {g: (_area([r for r in rows if r["group"] == g], *size), *size) for g, size in sizes.items()}


def summaries(source: DataFrame, scores: Scores, prior: float = P_SPOOF) -> dict[str, dict[str, float | None]]:
    """``metrics.grouped_summary`` of each group."""
    prior = check_prior(prior)
    costs = {"min_dcf_nsa": (C_MISS * prior, C_FA * (1 - prior)), "min_dcf_code": (C_FA * prior, C_MISS * (1 - prior))}
    borders, sizes = _borders(source, scores)

    def of_range(group: str, _: int, p: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> dict[str, float]:
        t1, t0 = (max(n, 1) for n in sizes[group])
        c1, c0 = np.cumsum(n1), np.cumsum(n0)
        at = {k: int(np.argmin(a * c1 / t1 - b * c0 / t0)) for k, (a, b) in costs.items()}
        return _sums(n1, n0) | {f"{k}_{n}": int(c[i]) for k, i in at.items() for n, c in (("1", c1), ("0", c0))}

    rows = _ranges(source, scores, borders, of_range, "n1 long, n0 long, wins long, " + ", ".join(f"{k}_{n} long" for k in costs for n in "10"))
    out: dict[str, dict[str, float | None]] = {}
    crossing, before = {}, {}
    for g, (t1, t0) in sizes.items():
        own = [r for r in rows if r["group"] == g]
        out[g] = {"auc": _area(own, t1, t0), "eer": None, **dict.fromkeys(costs), "metric_p_spoof": prior}
        if not (t1 and t0):
            continue
        best, c1, c0 = {k: b / min(a, b) for k, (a, b) in costs.items()}, 0, 0  # the point before all scores
        for r in own:
            for k, (a, b) in costs.items():
                best[k] = min(best[k], (a * ((c1 + r[f"{k}_1"]) / t1) + b * (1 - (c0 + r[f"{k}_0"]) / t0)) / min(a, b))
            if g not in crossing and (c1 + r["n1"]) / t1 >= 1 - (c0 + r["n0"]) / t0:
                crossing[g], before[g] = r["range"], (c1, c0)
            c1, c0 = c1 + r["n1"], c0 + r["n0"]
        out[g] |= {k: min(v, 1.0) for k, v in best.items()}

    def nearest(group: str, _: int, p: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> dict[str, float]:
        (b1, b0), (t1, t0) = before[group], sizes[group]
        miss, flag = np.append(b1, b1 + np.cumsum(n1)) / t1, 1 - np.append(b0, b0 + np.cumsum(n0)) / t0  # with the point before the range
        i = int(np.argmin(np.abs(miss - flag)))
        return {"eer": float((miss[i] + flag[i]) / 2)}

    if crossing:
        for r in _ranges(source, scores, borders, nearest, "eer double", crossing):
            out[r["group"]]["eer"] = r["eer"]
    return {g: {k: v if k == "metric_p_spoof" else rounded(v, 4) for k, v in own.items()} for g, own in out.items()}
