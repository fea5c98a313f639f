import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import clustering, queries
from tests.compare import compare, connection


def plain(rows, k, rounds, size=64):
    """All vectors against all centroids."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)) for i, v in kept]
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    sums = {j: sum(d for _, d, o in out if o == j) for j in range(len(c))}
    return sorted(((i, j, d, sums[j], sum(sums.values()), names[j]) for i, d, j in out), key=repr)


def clusters(df, **more):
    out = clustering.yinyang_clusters(df, "vec_id", "embedding", **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


KINDS = "vec_id long, embedding array<float>, cluster string, v int"


def test_odd_vectors_ties_and_copies(spark):
    rng = random.Random(4)
    some = lambda spread: [float(np.float32(rng.gauss(0, spread))) for _ in range(64)]
    rows = [(i, some(0.2)) for i in range(150)] + [(i, [rng.choice([0.0, 1 / 64, -1 / 64]) for _ in range(64)]) for i in range(200, 300)]
    rows += [(400 + i, rows[7][1]) for i in range(120)] + [(7, rows[3][1]), (None, some(0.3)), (None, rows[3][1]), (500, some(50))]
    odd = [(600, None), (601, []), (602, [0.1] * 63), (603, [0.1] * 65), (604, [0.1] * 63 + [None]), (605, [float("nan")] + [0.0] * 63), (606, [float("inf")] + [0.0] * 63), (607, [-math.inf] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], KINDS)
    assert clusters(df.repartition(3)) == plain(rows, 16, 3)
    assert clusters(df.repartition(5), rounds=7, groups=5) == plain(rows, 16, 7)
    assert clusters(df.filter("vec_id < 9"), k=40) == plain([r for r in rows if r[0] is not None and r[0] < 9], 40, 3)  # fewer vectors than centroids
    assert clusters(df.filter("vec_id >= 600")) == [] and clusters(df.limit(0)) == []


def test_bounds_hold_and_spare_work():
    """Rounds with bounds give what reading every centroid gives, on clusters that move little and much."""
    rng = np.random.default_rng(6)
    heart = rng.integers(-200, 200, (30, 8))
    v = (heart[rng.integers(0, 30, 4000)] + rng.integers(-20, 20, (4000, 8))).astype(np.int64)
    c = v[:30].copy()
    group = clustering.centroid_groups(c, 6)
    cluster, upper, lower = clustering.Rounds(c, np.zeros(30), group).first(v)
    for _ in range(12):
        new = np.array([v[cluster == j].sum(0) // max((cluster == j).sum(), 1) if (cluster == j).any() else c[j] for j in range(30)])
        gone = np.sqrt(((new - c) ** 2).sum(1)) * (1 + clustering.MARGIN)
        c = new
        cluster, upper, lower = clustering.Rounds(c, gone, group).step(v, cluster, upper, lower)
        d = clustering._squares(v, c)
        assert (cluster == d.argmin(1)).all()
        rows = np.arange(len(v))
        assert (upper >= np.sqrt(d[rows, cluster])).all()
        far = np.sqrt(d.astype(float))
        far[rows, cluster] = np.inf
        assert all((lower[:, g] <= far[:, group == g].min(1)).all() for g in range(group.max() + 1))
    assert (upper < lower.min(1)).mean() > 0.5


def test_query_matches_sql(spark):
    assert compare(spark, queries.op12_centroid_clustering, queries._clusters_sql(), connection()) == ""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("inertia", F.lit(1))
    assert len(clusters(df)) == 500
