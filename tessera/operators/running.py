"""Running sums over a total order, without one task that sorts everything.

Rows are written once and counted. A few fit into one window; more are dealt into ranges of the leading order column whose
borders are quantiles, known to the driver as a short list; a window sums inside each range, and the sums of all
ranges before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import kept

#: A range holds about so many rows; more than MOST_RANGES borders would cost each row more than they spare.
RANGE_ROWS, MOST_RANGES = 100_000, 512


def _range_of(x: Column, borders: Sequence[float], first: int = 0) -> Column:
    """``first`` and the number of sorted borders below ``x``, by halving."""
    if not borders:
        return F.lit(first)
    middle = len(borders) // 2
    return F.when(x > F.lit(borders[middle]), _range_of(x, borders[middle + 1 :], first + middle + 1)).otherwise(_range_of(x, borders[:middle], first))


def running_sums(df: DataFrame, lead: str, order: Sequence[Column], values: dict[str, str], ranges: int | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with a column for each of ``values`` (new name -> summed column): its sum over all rows of the group up to and with this one.

    The order is by the numeric column ``lead``, then ``order``, and must be total. ``ranges`` follows the number of rows.
    """
    df = kept(df)
    ranges = ranges or min(MOST_RANGES, 1 + df.count() // RANGE_ROWS)
    if ranges == 1:
        # RANGE_ROWS rows at most, so a window without groups may put them into one task
        upto = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy(lead, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *(F.sum(v).over(upto).alias(k) for k, v in values.items()))
    borders = sorted(set(df.stat.approxQuantile(lead, [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    dealt = df.withColumn("_range", _range_of(F.col(lead), borders))
    keys = [*groups, "_range"]
    totals = dealt.groupBy(keys).agg(*(F.sum(v).alias(f"_all_{k}") for k, v in values.items()))
    # At most ``ranges`` rows of each group meet in this window.
    before = (Window.partitionBy(*groups).orderBy("_range") if groups else Window.orderBy("_range")).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*keys, *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in values))
    inside = Window.partitionBy(*keys).orderBy(lead, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.select("*", *(F.sum(v).over(inside).alias(f"_part_{k}") for k, v in values.items()))
    joined = summed.join(bases if groups else F.broadcast(bases), keys)
    return joined.select(*df.columns, *((F.col(f"_base_{k}") + F.col(f"_part_{k}")).alias(k) for k in values))


def percentiles(df: DataFrame, value: str, points: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n, one column for each of ``points``): exact percentiles with linear interpolation, from the counts of
    distinct values, so that no task holds all values of a group. Nulls don't count; NaN counts as the largest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    summed = running_sums(counts, "_v", [], {"_upto": "_n"}, groups=groups)
    totals = summed.groupBy(*groups).agg(F.sum("_n").alias("n"))
    rows = summed.join(totals, list(groups)) if groups else summed.join(F.broadcast(totals), how="cross")
    at = {k: F.lit(p) * (F.col("n") - 1) for k, p in points.items()}
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)
    ends = [c for k, h in at.items() for c in (F.max(F.when(holds(F.floor(h)), F.col("_v"))).alias(f"_low_{k}"), F.max(F.when(holds(F.ceil(h)), F.col("_v"))).alias(f"_high_{k}"))]
    found = rows.groupBy(*groups, "n").agg(*ends)
    between = lambda k, h: F.col(f"_low_{k}") + (h - F.floor(h)) * (F.col(f"_high_{k}") - F.col(f"_low_{k}"))
    return found.select(*groups, "n", *(between(k, h).alias(k) for k, h in at.items()))
