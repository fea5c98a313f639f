"""Exact k-means of whole-number vectors with Yinyang bounds.

The centroids are put into groups once. Each vector keeps an upper bound of the distance to its centroid and, for
each group, one lower bound of the distances to the group's other centroids. After each move of the
centroids the bounds are widened by how far these went; a vector whose upper bound lies
below all its lower bounds keeps its centroid unread, the others read only the centroids of the groups that
may hold a nearer one. Bounds are floating, with a margin; distances that decide are whole numbers, so the result is
that of reading all centroids.

Vectors, assignments and bounds are a table that each round writes anew; it never shuffles. Sums of the vectors that
changed their centroid are added up in the tasks and then by centroid: k rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import bounded_batches, discard, saved
from tessera.llm.text_kernels import tidy

#: Components of at most this size keep squared distances of a thousand of them within 64 bits.
MOST = 1 << 25
#: Rows of a batch whose distances are held at once.
SLICE = 8192
#: What rounding may add to a floating distance, relative.
MARGIN = 1e-9

STATE = "v array<int>, cluster int, before int, upper double, lower array<double>"


def grid_vector(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x, as whole numbers."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def whole_vector(embedding: Column, size: int, scale: int = 64) -> Column:
    """Whether a vector has ``size`` components, none null or not finite, and none beyond ``MOST`` on the grid."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= F.lit(MOST / scale)))
    return embedding.isNotNull() & (F.size(embedding) == size) & fine


def centroid_groups(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few plain rounds over the centroids themselves, from evenly spaced ones."""
    k = len(centroids)
    groups = max(1, min(groups, k))
    c = centroids.astype(np.float64)
    heart = c[np.linspace(0, k - 1, groups).astype(int)]
    own = np.zeros(k, np.int64)
    for _ in range(5):
        own = ((c[:, None, :] - heart[None]) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (own == g).any():
                heart[g] = c[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


def _squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = v - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Rounds:
    """One round for a slice of vectors: ``centroids`` now, and how far each has gone since the bounds were made."""

    def __init__(self, centroids: np.ndarray, gone: np.ndarray, group: np.ndarray) -> None:
        self.centroids, self.group, self.n = centroids, group, int(group.max()) + 1
        self.members = [np.flatnonzero(group == g) for g in range(self.n)]
        self.gone = gone
        self.most = np.array([gone[m].max() for m in self.members])

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) from all centroids."""
        d = _squares(v, self.centroids)
        cluster = d.argmin(1)  # the smaller number of equal ones
        return cluster, *self._bounds(d, cluster)

    def _bounds(self, d: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.sqrt(d.astype(np.float64))
        rows = np.arange(len(d))
        upper = far[rows, cluster].copy()
        far[rows, cluster] = np.inf
        return upper * (1 + MARGIN), np.stack([far[:, m].min(1) for m in self.members], 1) * (1 - MARGIN)

    def step(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        upper, lower = (upper + self.gone[cluster]) * (1 + MARGIN), lower - self.most * (1 + MARGIN)
        lower = lower * np.where(lower > 0, 1 - MARGIN, 1 + MARGIN)
        cluster = cluster.copy()
        rows = np.flatnonzero(upper >= lower.min(1))  # equal distances must be read too
        d = v[rows] - self.centroids[cluster[rows]]
        now = np.einsum("ij,ij->i", d, d)
        upper[rows] = np.sqrt(now.astype(np.float64)) * (1 + MARGIN)
        still = upper[rows] >= lower[rows].min(1)
        rows, now = rows[still], now[still]
        if not len(rows):
            return cluster, upper, lower
        was, held = cluster[rows], upper[rows]
        reads = lower[rows] <= held[:, None]
        best, number = now.copy(), was.copy()
        seen: list[tuple[int, np.ndarray, np.ndarray]] = []
        for g in range(self.n):
            at = np.flatnonzero(reads[:, g])
            if not len(at):
                continue
            near = _squares(v[rows[at]], self.centroids[self.members[g]])
            seen.append((g, at, near))
            j = near.argmin(1)
            least, name = near[np.arange(len(at)), j], self.members[g][j]
            better = (least < best[at]) | ((least == best[at]) & (name < number[at]))
            best[at[better]], number[at[better]] = least[better], name[better]
        for g, at, near in seen:
            far = np.sqrt(near.astype(np.float64))
            far[self.members[g][None, :] == number[at][:, None]] = np.inf
            lower[rows[at], g] = far.min(1) * (1 - MARGIN)
        left = number != was  # the centroid left behind counts again in its group, if that wasn't read
        side = self.group[was]
        unread = left & ~reads[np.arange(len(rows)), side]
        old = np.sqrt(now[unread].astype(np.float64)) * (1 - MARGIN)
        lower[rows[unread], side[unread]] = np.minimum(lower[rows[unread], side[unread]], old)
        cluster[rows], upper[rows] = number, np.sqrt(best.astype(np.float64)) * (1 + MARGIN)
        return cluster, upper, lower


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _assigned(state: DataFrame, ids: list[str], rounds: Rounds, start: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                v = _matrix(part.column("v"), np.int64)
                if start:
                    before = np.full(len(v), -1, np.int32)
                    cluster, upper, lower = rounds.first(v)
                else:
                    before = part.column("cluster").to_numpy()
                    cluster, upper, lower = rounds.step(v, before.astype(np.int64), part.column("upper").to_numpy(), _matrix(part.column("lower"), np.float64))
                made = [part.column("v"), pa.array(cluster.astype(np.int32)), pa.array(before), pa.array(upper), _lists(lower, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ids] + made, [*ids, "v", "cluster", "before", "upper", "lower"])

    kinds = "".join(f"`{c}` {state.schema[c].dataType.simpleString()}, " for c in ids)
    return state.mapInArrow(tidy(run), kinds + STATE)


def _changes(k: int):
    """(cluster, n, sums) of what the vectors that moved add to, or take from, each centroid's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), np.int64)
            now, before = batch.column("cluster").to_numpy(), batch.column("before").to_numpy()
            number, count, sums = [], [], []
            for c in range(k):
                to, off = now == c, before == c
                if to.any() or off.any():
                    number.append(c)
                    count.append(int(to.sum()) - int(off.sum()))
                    sums.append(v[to].sum(0) - v[off].sum(0))
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(count, pa.int64()), _lists(np.stack(sums), pa.int64())], ["cluster", "n", "sums"])

    return run


def yinyang_clusters(vectors: DataFrame, id_col: str, vector_col: str, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", groups: int = 4) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector with ``size`` finite components.

    Vectors become whole numbers, floor(scale * x). Centroids start as the ``k`` vectors with the least SHA-256 of
    "seed:id", ties by their components; there are fewer if fewer vectors are there. In each of ``rounds`` all vectors go to the
    nearest centroid, the one with the smaller number of equally near ones, and centroids become their vectors'
    componentwise floor(sum / count); one without vectors stays. Then vectors are assigned once more.
    ``distance`` is squared; the inertias are its sums over the cluster and over all; the digest is that of the final
    centroid's decimal components, joined by commas.

    Null vectors, and those of another size, with a null, an infinite component or NaN, are left out; so are components beyond
    ``MOST`` on the grid, whose distances a long can't hold. A null id counts as an empty one; rows
    that share an id or are equal are vectors of their own. Without vectors there is no row.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).filter(whole_vector(F.col("x"), size, scale))
    state = saved(kept.select("id", grid_vector(F.col("x"), scale).alias("v")), "vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = state.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()
    centroids = np.array([r.v for r in drawn], np.int64).reshape(len(drawn), size)
    if not len(centroids):
        discard(state)
        return spark.createDataFrame([], f"`{id_col}` {kept.schema['id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    group = centroid_groups(centroids, groups)
    k = len(centroids)
    totals, counts = [[0] * size for _ in range(k)], [0] * k
    gone = np.zeros(k)
    for i in range(rounds + 1):
        before, state = state, saved(_assigned(state, ["id"], Rounds(centroids, gone, group), i == 0), "assigned")
        discard(before)
        if i == rounds:
            break
        moved = state.filter("cluster != before").select("v", "cluster", "before").mapInArrow(tidy(_changes(k)), "cluster int, n long, sums array<long>")
        # decimals: a sum over all vectors may pass 64 bits
        added = moved.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size))).collect()
        for r in added:
            counts[r.cluster] += r.n
            totals[r.cluster] = [t + int(r[f"s{j}"]) for j, t in enumerate(totals[r.cluster])]
        new = np.array([[t // counts[c] for t in totals[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64)
        gone = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + MARGIN)
        centroids = new

    measured = saved(_distances(state, centroids), "distances")
    discard(state)
    sums = {r.cluster: r.own for r in measured.groupBy("cluster").agg(F.sum("distance").alias("own")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, sums[c], sum(sums.values()), digests[c]) for c in sums]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = measured.join(F.broadcast(clusters), "cluster")  # k rows
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance): exact squared distances to the assigned centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, cluster = _matrix(batch.column("v"), np.int64), batch.column("cluster").to_numpy()
            d = v - centroids[cluster]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], ["id", "cluster", "distance"])

    return state.select("id", "v", "cluster").mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, cluster int, distance long")
