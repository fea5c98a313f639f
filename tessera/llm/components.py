"""Connected components of a links table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import discard, saved


def _toward_least(edges: DataFrame, greater_only: bool) -> DataFrame:
    """Links each neighbour of a node (with ``greater_only`` those above it, else those below it and the node itself) to
    the least id around the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if greater_only else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = both.join(least, "a")
    if greater_only:
        out = joined.filter("b > a").select("b", F.col("least").alias("a"))
    else:
        out = joined.select("b", F.col("least").alias("a")).unionByName(least.select(F.col("a").alias("b"), F.col("least").alias("a")))
    return out.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each id is linked to one lesser id at most, and none of those to a lesser one."""
    lesser = edges.groupBy("b").agg(F.count("*").alias("n"))
    centres = edges.select(F.col("a").alias("b")).distinct().withColumn("centre", F.lit(1))
    return lesser.join(centres, "b", "left").filter("n > 1 or centre is not null").count() == 0


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b): the least id that it reaches.

    Each round is two grouped joins over a table of at most one row for each link, written to the
    shared folder. It ends when every id is linked to its component's least id only.
    """
    edges = saved(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        before, edges = edges, saved(_toward_least(_toward_least(edges, True), False).distinct(), name)
        discard(before)
    else:
        raise RuntimeError("the components didn't settle")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
