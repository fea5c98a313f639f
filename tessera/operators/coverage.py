"""Strict contracts of score tables: names, probabilities, labels, coverage, reproduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import lit


def bad_name(name: Column) -> Column:
    """Null, empty, with outer white space, or with a tab, line break or null character."""
    return name.isNull() | (name == "") | name.rlike("(?U)^\\s|\\s$|[\\t\\r\\n\\x00]")


def invalid_names(df: DataFrame, name: str) -> DataFrame:
    """(name, n, problem) of each name that breaks the rules or occurs more than once."""
    counted = df.groupBy(name).agg(F.count("*").alias("n"))
    return counted.select(name, "n", F.when(bad_name(F.col(name)), "invalid").when(F.col("n") > 1, "duplicate").alias("problem")).filter("problem is not null")


def invalid_probabilities(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score isn't a finite number in [0, 1]; nothing is clipped."""
    s = F.col(score)
    return df.filter(s.isNull() | F.isnan(s) | ~s.between(lit(0), lit(1)))


def coverage(actual: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """(name, problem) for each missing and each extra name: two anti joins on one key."""
    a, e = actual.select(name).distinct(), expected.select(name).distinct()
    missing = e.join(a, name, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(a.join(e, name, "left_anti").withColumn("problem", F.lit("extra")))


def require_coverage(actual: DataFrame, expected: DataFrame, name: str) -> None:
    """ValueError with counts and the first five names if the two sets of names differ."""
    found = coverage(actual, expected, name)
    counts = {r["problem"]: r["n"] for r in found.groupBy("problem").agg(F.count("*").alias("n")).collect()}
    if counts:
        first = [r[name] for r in found.orderBy("problem", name).limit(5).collect()]
        raise ValueError(f"coverage: {counts.get('missing', 0)} missing, {counts.get('extra', 0)} extra, first {first}")


def require_valid_scores(scores: DataFrame, name: str, score: str) -> None:
    """ValueError with the first five offending names."""
    names = [r[name] for r in invalid_names(scores, name).orderBy(name).limit(5).collect()]
    values = [r[name] for r in invalid_probabilities(scores, score).orderBy(name).limit(5).collect()]
    if names or values or not scores.take(1):
        raise ValueError(f"invalid names {names}, invalid scores of {values}" if names or values else "no rows")


def reproduction(reference: DataFrame, again: DataFrame, name: str, score: str, tolerance: float) -> DataFrame:
    """One row: rows, max and mean absolute difference, differing rows, rows beyond the tolerance."""
    d = F.abs(F.col(f"x.{score}") - F.col(f"y.{score}"))
    joined = reference.alias("x").join(again.alias("y"), name).select(d.alias("d"))
    return joined.agg(
        F.count("*").alias("n_rows"),
        F.max("d").alias("max_difference"),
        F.avg("d").alias("mean_difference"),
        F.count_if(F.col("d") != 0).alias("different"),
        F.count_if(F.col("d") > lit(tolerance)).alias("beyond_tolerance"),
    )
