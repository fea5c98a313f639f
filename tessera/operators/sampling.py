"""Manifests to sets: deterministic caps, class, group and corpus weights, shards, unions, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import lit

#: A corpus' share of its class; any other corpus has OTHER_SHARE.
SOURCE_SHARE = {"la19": 1.0, "vctk": 1.0, "diffssd": 0.35, "lj": 0.1}
OTHER_SHARE = 0.2


def draw_order(uid: Column, seed: int) -> Column:
    """A reproducible random order of rows: the digest of id and seed."""
    return F.md5(F.concat_ws(":", uid.cast("string"), F.lit(str(seed))).cast("binary"))


def capped_sample(manifest: DataFrame, bona: int | None, per_system: int | None, seed: int = 0) -> DataFrame:
    """At most ``bona`` real clips and ``per_system`` synthetic ones of each system; unlabelled clips stay.

    The first clips by the draw order stay. Their order is uniform, so only rows below a share of it that
    is a little larger than the cap's go into a group's window; a group in which too few are below
    it, which ten standard deviations leave to next to none, goes in whole.
    """
    cap = F.when(F.col("label") == 0, F.lit(bona)).when(F.col("label") == 1, F.lit(per_system))
    group = F.when(F.col("label") == 0, "real").when(F.col("label") == 1, F.concat(F.lit("fake:"), F.col("system")))
    order = draw_order(F.col("uid"), seed)
    rows = manifest.withColumns({"_group": group, "_cap": cap, "_draw": order, "_at": F.conv(F.substring(order, 1, 13), 16, 10).cast("double") / lit(16.0**13)})
    free, capped = rows.filter("_cap is null"), rows.filter("_cap is not null")
    sizes = capped.groupBy("_group").agg(F.count("*").alias("_n"), F.max("_cap").alias("_most"))
    share = F.least(lit(1), (F.col("_most") + lit(10) * F.sqrt("_most") + lit(20)) / F.col("_n"))
    near = capped.join(sizes.select("_group", share.alias("_share")), "_group")
    short = near.filter("_at < _share").groupBy("_group").agg(F.count("*").alias("_near")).join(sizes, "_group", "right").filter(F.coalesce("_near", F.lit(0)) < F.least("_most", "_n")).select("_group", F.lit(True).alias("_whole"))
    some = near.join(short, "_group", "left").filter(F.coalesce("_whole", F.lit(False)) | (F.col("_at") < F.col("_share")))
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_draw", "uid"))
    kept = some.withColumn("_rank", rank).filter("_rank <= _cap")
    return free.select(manifest.columns).unionByName(kept.select(manifest.columns))


def balanced_weights(df: DataFrame, y: str, group: str) -> DataFrame:
    """``df`` with ``weight``: both classes weigh the same, groups the same inside a class, the mean is 1.

    Two small aggregations joined back; rows are never dealt out by class.
    """
    sizes = df.groupBy(y, group).agg(F.count("*").alias("_size"))
    classes = sizes.groupBy(y).agg(F.count("*").alias("_groups"), F.sum("_size").alias("_rows"))
    total = classes.agg(F.sum("_rows").alias("_n"), F.count("*").alias("_classes"))
    table = sizes.join(classes.select(y, "_groups"), y).join(total, how="cross")
    weight = F.col("_n") / (F.col("_classes") * F.col("_groups") * F.col("_size"))
    return df.join(table.select(y, group, weight.alias("weight")), [y, group])


def corpus_weights(df: DataFrame, y: str = "y", system: str = "system", source: str = "source") -> DataFrame:
    """Balanced weights (fake clips grouped by system, real ones by source), then scaled to each corpus' share of its class."""
    grouped = df.withColumn("_group", F.when(F.col(y) == 1, F.col(system)).otherwise(F.col(source)))
    weighed = balanced_weights(grouped, y, "_group")
    share = F.coalesce(*(F.when(F.col(source) == k, lit(v)) for k, v in SOURCE_SHARE.items()), lit(OTHER_SHARE))
    masses = weighed.groupBy(y, source).agg(F.sum("weight").alias("_mass")).withColumn("_share", share)
    classes = masses.groupBy(y).agg(F.sum("_mass").alias("_class_mass"), F.sum("_share").alias("_shares"))
    factor = masses.join(classes, y).select(y, source, (F.col("_share") / F.col("_shares") * F.col("_class_mass") / F.col("_mass")).alias("_factor"))
    scaled = weighed.join(factor, [y, source]).withColumn("weight", F.col("weight") * F.col("_factor"))
    mean = scaled.agg((F.count("*") / F.sum("weight")).alias("_scale"))
    return scaled.join(F.broadcast(mean), how="cross").select(*df.columns, (F.col("weight") * F.col("_scale")).alias("weight"))


def composition(df: DataFrame, source: str = "source", y: str = "y") -> DataFrame:
    key = F.concat_ws("/", F.col(source), F.when(F.col(y) == 1, "spoof").otherwise("bonafide"))
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def shard(df: DataFrame, order: str, number: int, shards: int) -> DataFrame:
    """Every ``shards``-th row in the order of a dense integer key."""
    return df.filter(F.pmod(F.col(order), F.lit(shards)) == number)


def keep_first(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key; one aggregation with partial results, no sort of all rows."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(order)).alias("_row")).select(key, "_row.*")


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(order)).alias("_row")).select(key, "_row.*")


def length_batches(clips: DataFrame, length: str, most: int, ranges: int | None = None) -> DataFrame:
    """``clips`` with ``batch``: in the order of length, at most ``most`` clips whose lengths lie within 5 % of the batch's shortest.

    Lengths are dealt into ranges, sorted inside each; a batch never crosses the border of a range.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    names = clips.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, shortest = None, 0, 0.0
        for batch in batches:
            out = []
            for own, value in zip(batch.column("_range").to_pylist(), batch.column(length).to_pylist(), strict=True):
                if number is None or size == most or value > shortest * 1.05:
                    number, size, shortest = (own << 33) + (0 if number is None else (number & ((1 << 33) - 1)) + 1), 0, value
                size += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64())], [*names, "batch"])

    dealt = clips.repartitionByRange(ranges, length) if ranges else clips.repartitionByRange(length)
    ordered = dealt.sortWithinPartitions(length).withColumn("_range", F.spark_partition_id())
    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema) + ", batch long")
