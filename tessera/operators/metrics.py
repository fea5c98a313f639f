"""Detection metrics: DET points, minimum detection cost, equal error rate, AUC, operating points.

All work starts from one row for each distinct score with its counts, a
grouped aggregation, so ties and hot scores cost nothing and running sums go
over distinct scores only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import C_FA, C_MISS, P_SPOOF, check_prior, default_score, lit
from tessera.operators.running import running_sums
from tessera.sources.store import kept

#: Points of one score are written out in runs of so many, so that a hot score is no unbounded array.
RUN = 10_000


def _ties(scored: DataFrame, y: str, p: str) -> DataFrame:
    """(p, n1, n0, b1, b0, t1, t0): targets and others at each distinct score, below it, and in all."""
    summed = running_sums(score_counts(scored, y, p), "p", [], {"c1": "n1", "c0": "n0"})
    total = summed.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    return summed.join(F.broadcast(total), how="cross").select("p", "n1", "n0", (F.col("c1") - F.col("n1")).alias("b1"), (F.col("c0") - F.col("n0")).alias("b0"), "t1", "t0")


def _points(ties: DataFrame, place: str) -> DataFrame:
    """The points after ``place`` rows of a score, of which the targets come first."""
    ones = F.least(F.col(place), F.col("n1"))
    targets, others = F.col("b1") + ones, F.col("b0") + F.col(place) - ones
    return ties.select(F.col("p").alias("threshold"), (targets / F.col("t1")).alias("frr"), ((F.col("t0") - others) / F.col("t0")).alias("far"), (targets + others).alias("rank"))


def _first_point(ties: DataFrame) -> DataFrame:
    return ties.agg(F.min("p").alias("least")).filter("least is not null").select((F.col("least") - lit(0.001)).alias("threshold"), lit(0).alias("frr"), lit(1).alias("far"), F.lit(0).cast("long").alias("rank"))


def det_curve(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, frr, far, rank) for each score in ascending order, targets first among ties, and the point before all.

    Running sums go over distinct scores; the points of a tie follow from its counts.
    """
    ties = _ties(scored, y, p)
    size = F.col("n1") + F.col("n0")
    runs = ties.withColumn("_run", F.explode(F.sequence(F.lit(1).cast("long"), size, F.lit(RUN).cast("long"))))
    rows = runs.withColumn("_place", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN - 1, size))))
    return _first_point(ties).unionByName(_points(rows, "_place"))


def det_corners(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """See ``_corners``."""
    return _corners(_ties(scored, y, p))


def _corners(ties: DataFrame) -> DataFrame:
    """The points of ``det_curve`` at which a cost can be least or both rates nearest: in a tie's run of targets, and of
    others, the ends and the two points around the place where the rates cross; at most eight for each distinct score."""
    far = (F.col("t0") - F.col("b0")) / F.col("t0")
    frr = (F.col("b1") + F.col("n1")) / F.col("t1")
    cross1, cross0 = far * F.col("t1") - F.col("b1"), F.col("t0") - F.col("b0") - frr * F.col("t0")
    within = lambda x, n: F.greatest(F.least(x, F.col(n)), F.lit(1)).cast("long")
    ones = F.array(F.lit(1).cast("long"), F.col("n1"), *(within(f(cross1), "n1") for f in (F.floor, F.ceil)))
    zeros = F.array(F.lit(1).cast("long"), F.col("n0"), *(within(f(cross0), "n0") for f in (F.floor, F.ceil)))
    none = F.array().cast("array<bigint>")
    places = F.array_union(F.when(F.col("n1") > 0, ones).otherwise(none), F.transform(F.when(F.col("n0") > 0, zeros).otherwise(none), lambda j: j + F.col("n1")))
    return _first_point(ties).unionByName(_points(ties.withColumn("_place", F.explode(places)), "_place"))


def score_counts(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, n1, n0): targets and others at each distinct score."""
    return scored.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("n1"), F.sum((F.lit(1) - F.col(y)).cast("long")).alias("n0"))


def tie_rates(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, miss, flag): shares of targets at or below and of others above each distinct score; null stands for minus infinity."""
    return _tie_rates(running_sums(score_counts(scored, y, p), "p", [], {"c1": "n1", "c0": "n0"}))


def _tie_rates(summed: DataFrame) -> DataFrame:
    total = summed.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    points = summed.join(F.broadcast(total), how="cross").select(F.col("p").alias("threshold"), (F.col("c1") / F.col("t1")).alias("miss"), (lit(1) - F.col("c0") / F.col("t0")).alias("flag"))
    first = total.select(F.lit(None).cast("double").alias("threshold"), lit(0).alias("miss"), lit(1).alias("flag"))
    return first.unionByName(points)


def cost(miss: Column, flag: Column, prior: float, four_on_flags: bool = True) -> Column:
    """Normalised detection cost under the two readings: four times the cost on flagged real clips, or on missed fakes."""
    prior = check_prior(prior)
    a, b = (C_MISS * prior, C_FA * (1 - prior)) if four_on_flags else (C_FA * prior, C_MISS * (1 - prior))
    return (lit(a) * miss + lit(b) * flag) / lit(min(a, b))


def eer_of(rates: DataFrame, frr: str, far: str, order: Column) -> Column:
    """The mean of both rates where they are nearest, the first of several in ``order``."""
    return F.min_by((F.col(frr) + F.col(far)) / lit(2), F.struct(F.abs(F.col(frr) - F.col(far)), order))


def auc(counts: DataFrame) -> DataFrame:
    """(auc, n_spoof, n_bonafide) of score counts by the rank sum; half of each tie counts."""
    return _auc(running_sums(counts, "p", [], {"c0": "n0"}))


def _auc(summed: DataFrame) -> DataFrame:
    wins = F.sum(F.col("n1") * (F.col("c0") - F.col("n0")) + F.col("n1") * F.col("n0") / lit(2))
    return summed.agg((wins / (F.sum("n1") * F.sum("n0"))).alias("auc"), F.sum("n1").alias("n_spoof"), F.sum("n0").alias("n_bonafide"))


def detection_metrics(scored: DataFrame, prior: float = P_SPOOF, y: str = "y", p: str = "p") -> DataFrame:
    """One row: min_dcf (analyst reading), min_dcf_as_coded, eer, auc, class counts, prior and costs."""
    ties = kept(_ties(scored, y, p))  # both the points and the area start from it
    points = _corners(ties)
    metrics = points.agg(
        F.min(cost(F.col("frr"), F.col("far"), prior, True)).alias("min_dcf"),
        F.min(cost(F.col("frr"), F.col("far"), prior, False)).alias("min_dcf_as_coded"),
        eer_of(points, "frr", "far", F.col("rank")).alias("eer"),
    )
    area = _auc(ties.withColumn("c0", F.col("b0") + F.col("n0")))
    return metrics.join(area, how="cross").select("*", lit(prior).alias("p_spoof"), lit(C_MISS).alias("c_miss"), lit(C_FA).alias("c_fa"))


def summary(scored: DataFrame, prior: float = P_SPOOF, y: str = "y", p: str = "p") -> DataFrame:
    """One row, rounded to four places: auc, eer over collapsed ties, and both cost readings, at most 1."""
    summed = kept(running_sums(score_counts(scored, y, p), "p", [], {"c1": "n1", "c0": "n0"}))
    rates = _tie_rates(summed)
    best = rates.agg(
        eer_of(rates, "miss", "flag", F.col("threshold")).alias("eer"),
        F.least(F.min(cost(F.col("miss"), F.col("flag"), prior, True)), lit(1)).alias("min_dcf_nsa"),
        F.least(F.min(cost(F.col("miss"), F.col("flag"), prior, False)), lit(1)).alias("min_dcf_code"),
    )
    four = lambda c: F.round(c, 4).alias(c)
    return best.join(_auc(summed), how="cross").select(four("auc"), four("eer"), four("min_dcf_nsa"), four("min_dcf_code"), lit(prior).alias("metric_p_spoof"))


def grouped_summary(scored: DataFrame, group: str, prior: float = P_SPOOF, y: str = "y", p: str = "p") -> DataFrame:
    """``summary`` of each group: (group, auc, eer, min_dcf_nsa, min_dcf_code, metric_p_spoof); of one class, all but the prior is null."""
    counts = scored.groupBy(group, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("n1"), F.sum((F.lit(1) - F.col(y)).cast("long")).alias("n0"))
    summed = running_sums(counts, "p", [], {"c1": "n1", "c0": "n0"}, groups=[group])
    total = summed.groupBy(group).agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    nothing = F.lit(0).cast("long")
    first = total.select(group, F.lit(None).cast("double").alias("p"), *(nothing.alias(c) for c in ("n1", "n0", "c1", "c0")), "t1", "t0")
    rows = summed.join(total, group).select(first.columns).unionByName(first)
    rows = rows.withColumns({"miss": F.col("c1") / F.nullif("t1", nothing), "flag": lit(1) - F.col("c0") / F.nullif("t0", nothing)})
    four = lambda c, name: F.round(c, 4).alias(name)
    wins = F.sum(F.col("n1") * (F.col("c0") - F.col("n0")) + F.col("n1") * F.col("n0") / lit(2))
    return rows.groupBy(group).agg(
        four(wins / F.nullif(F.sum("n1") * F.sum("n0"), nothing), "auc"),
        four(F.when(F.max(F.least("t1", "t0")) > 0, eer_of(rows, "miss", "flag", F.col("p"))), "eer"),
        four(F.least(F.min(cost(F.col("miss"), F.col("flag"), prior, True)), lit(1)), "min_dcf_nsa"),
        four(F.least(F.min(cost(F.col("miss"), F.col("flag"), prior, False)), lit(1)), "min_dcf_code"),
    ).withColumn("metric_p_spoof", lit(prior))


def operating_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(analyst, as_coded, default_score): the lowest thresholds of least cost; clips at or above are flagged."""
    counts = score_counts(scored, y, p)
    ends = counts.sparkSession.sql("select explode(array(0d, 1.000000001d)) as p, 0L as n1, 0L as n0")
    counts = counts.unionByName(ends).groupBy("p").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    summed = running_sums(counts, "p", [], {"c1": "n1", "c0": "n0"})
    total = summed.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    rates = summed.join(F.broadcast(total), how="cross").select(
        "p", ((F.col("c1") - F.col("n1")) / F.col("t1")).alias("miss"), ((F.col("t0") - F.col("c0") + F.col("n0")) / F.col("t0")).alias("flag")
    )
    least = lambda a, b: F.min_by("p", F.struct(F.round(lit(a) * F.col("miss") + lit(b) * F.col("flag"), 12), F.col("p")))
    best = rates.agg(least(C_MISS, C_FA).alias("analyst"), least(C_FA, C_MISS).alias("as_coded"))
    return best.withColumn("default_score", default_score(F.col("analyst"), F.col("as_coded")))


def grouped_auc(df: DataFrame, group: str, y: str = "y", p: str = "p") -> DataFrame:
    """(group, auc, n1, n0) by rank sums inside each group; groups of a single class have a null AUC."""
    counts = df.groupBy(group, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("n1"), F.sum((F.lit(1) - F.col(y)).cast("long")).alias("n0"))
    summed = running_sums(counts, "p", [], {"c0": "n0"}, groups=[group])
    wins = summed.withColumn("wins", F.col("n1") * (F.col("c0") - F.col("n0")) + F.col("n1") * F.col("n0") / lit(2))
    sums = wins.groupBy(group).agg(F.sum("wins").alias("wins"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    return sums.select(group, (F.col("wins") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"), "n1", "n0")
