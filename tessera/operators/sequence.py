"""Window operators over a clip's frames: levels, speech, runs, jumps, windows, embedding consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import cosine, lit


def frame_levels(samples: DataFrame, clip: str, i: str, x: str, frame: int, hop: int) -> DataFrame:
    """(clip, frame, db): mean power of each whole frame of ``frame`` samples every ``hop``.

    Each sample goes to the frames that hold it (a bounded number), then one grouped aggregation
    with partial sums; no sort by clip.
    """
    most = (frame - 1) // hop
    first = F.floor(F.col(i) / lit(hop))
    frames = F.explode(F.sequence(F.greatest(first - most, lit(0).cast("long")), first))
    dealt = samples.select(F.col(clip).alias("clip"), F.col(i).alias("_i"), (F.col(x) * F.col(x)).alias("_power"), frames.alias("frame")).filter((F.col("_i") >= F.col("frame") * hop) & (F.col("_i") < F.col("frame") * hop + frame))
    sums = dealt.groupBy("clip", "frame").agg(F.sum("_power").alias("_power"), F.count("*").alias("_n")).filter(F.col("_n") == frame)
    return sums.select("clip", "frame", (lit(10) * F.log10(F.col("_power") / lit(frame) + lit(1e-12))).alias("db"))


def speech_mask(levels: DataFrame, clip: str = "clip", i: str = "frame", db: str = "db") -> DataFrame:
    """``levels`` with ``speech``: above the clip's threshold in more than two of five frames; edge frames count the missing ones as quiet."""
    threshold = levels.groupBy(clip).agg(F.greatest(F.percentile(db, lit(0.95)) - lit(25), F.percentile(db, lit(0.10)) + lit(8)).alias("_threshold"))
    loud = levels.join(threshold, clip).withColumn("_loud", (F.col(db) > F.col("_threshold")).cast("int"))
    near = Window.partitionBy(clip).orderBy(i).rowsBetween(-2, 2)
    return loud.withColumn("speech", F.sum("_loud").over(near) > 2).drop("_threshold", "_loud")


def runs(df: DataFrame, clip: str, i: str, mask: str) -> DataFrame:
    """(clip, first, end): half-open intervals of successive rows with a true mask, by gaps and islands."""
    rank = F.row_number().over(Window.partitionBy(clip).orderBy(i))
    rows = df.filter(F.col(mask)).select(F.col(clip).alias("clip"), F.col(i).alias("i"), (F.col(i) - rank).alias("_island")) if clip == "clip" else df.filter(F.col(mask)).withColumn("_island", F.col(i) - rank).select(F.col(clip).alias("clip"), F.col(i).alias("i"), "_island")
    return rows.groupBy("clip", "_island").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("end")).drop("_island")


def level_jumps(df: DataFrame, clip: str, i: str, db: str, mask: str) -> DataFrame:
    """(clip, level_jump_db): the largest step between successive frames that both are speech."""
    order = Window.partitionBy(clip).orderBy(i)
    step = F.abs(F.col(db) - F.lag(db).over(order))
    both = F.col(mask) & F.lag(mask).over(order)
    return df.select(F.col(clip).alias("clip"), F.when(both, step).alias("_step")).groupBy("clip").agg(F.max("_step").alias("level_jump_db"))


def spread_pick(df: DataFrame, clip: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each clip, evenly spread over its order, ends included; rounding halves to even."""
    w = Window.partitionBy(clip)
    ranked = df.withColumn("_rank", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / lit(most - 1), 0).cast("int"))
    return ranked.filter((F.col("_n") <= most) | F.array_contains(picks, F.col("_rank"))).drop("_rank", "_n")


def mean_vector(column: Column, size: int) -> list[Column]:
    return [F.avg(column[j].cast("double")) for j in range(size)]


def speaker_consistency(df: DataFrame, clip: str, order: str, vector: str, size: int) -> DataFrame:
    """(clip, n, sim_mean, sim_min, adjacent_min, sim_std, drift) of unit vectors in order; fewer than three give nulls."""
    lists = df.groupBy(clip).agg(*(c.alias(f"_m{j}") for j, c in enumerate(mean_vector(F.col(vector), size))), F.count("*").alias("n"), F.min_by(vector, order).alias("_first"))
    centroid = lists.select(clip, "n", "_first", F.array(*(F.col(f"_m{j}") for j in range(size))).alias("_centroid"))
    before = F.lag(vector).over(Window.partitionBy(clip).orderBy(order))
    rows = df.withColumn("_before", before).join(centroid, clip)
    sims = rows.select(clip, "n", F.col(order).cast("double").alias("_t"), cosine(F.col(vector), F.col("_centroid")).alias("_c"), F.when(F.col("_before").isNotNull(), cosine(F.col(vector), F.col("_before"))).alias("_a"), cosine(F.col(vector), F.col("_first")).alias("_f"))
    stats = {"sim_mean": F.avg("_c"), "sim_min": F.min("_c"), "adjacent_min": F.min("_a"), "sim_std": F.stddev_pop("_c"), "drift": -F.regr_slope("_f", "_t")}
    return sims.groupBy(F.col(clip).alias("clip"), "n").agg(*(v.alias(k) for k, v in stats.items())).select("clip", "n", *(F.when(F.col("n") >= 3, F.col(k)).alias(k) for k in stats))
