"""Caches in Parquet and JSON: learned features, findings that grow by versions, calibrations."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.calibration import Calibration, Model
from tessera.sources.store import Folder, kept, staged

FEATURES = ("uid", "ssl", "spec", "label", "system", "speaker", "source", "partition")
CALIBRATION = "kind string, without string, expert string, mean array<double>, scale array<double>, coef array<double>, median array<double>, spread array<double>, value double"


def write_features(features: DataFrame, path: str, model: str, name: str, shard: tuple[int, int] | None = None) -> int:
    """Features (the columns FEATURES) of the set ``name`` under ``model``, or of its shard (number, of how many), in the
    place of an earlier version; the number of rows. Until all is written, the earlier version stays."""
    suffix = "" if shard is None or shard[1] == 1 else f".{shard[0]}of{shard[1]}"
    return staged(features.select(*FEATURES), f"{path}/model={model}/set={name}{suffix}")


def feature_folders(spark: SparkSession, path: str, model: str, name: str) -> list[str]:
    """The folders that hold a set: the whole one if it is there, else all its shards, whose numbers must be complete.

    FileNotFoundError without either; of several complete partitions, the one with the fewest shards.
    """
    base = f"{path}/model={model}"
    there = Folder(spark, base).names()
    if f"set={name}" in there:
        return [f"{base}/set={name}"]
    shards: dict[int, set[int]] = {}
    for found in (re.fullmatch(rf"set={re.escape(name)}\.(\d+)of(\d+)", n) for n in there):
        if found:
            shards.setdefault(int(found[2]), set()).add(int(found[1]))
    whole = sorted(n for n, own in shards.items() if own == set(range(n)))
    if not whole:
        lacking = {n: sorted(set(range(n)) - own) for n, own in shards.items()}
        raise FileNotFoundError(f"{base}/set={name}" + (f": shards lacking {lacking}" if lacking else ""))
    return [f"{base}/set={name}.{i}of{whole[0]}" for i in range(whole[0])]


def read_features(spark: SparkSession, path: str, model: str, names: list[str]) -> DataFrame:
    """The features of several sets, with ``set``; FileNotFoundError for a set of which a part isn't there."""
    parts = [p for n in names for p in feature_folders(spark, path, model, n)]
    found = spark.read.option("basePath", f"{path}/model={model}").parquet(*parts)
    return found.withColumn("set", F.regexp_replace(F.col("set").cast("string"), r"\.\d+of\d+$", ""))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a cache of findings, in the order of their writing."""
    return sorted(int(n.removeprefix("version=")) for n in Folder(spark, path).names() if n.startswith("version="))


def cached_findings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last entry of each path in a cache; an empty table if there is none."""
    if not versions(spark, path):
        return spark.createDataFrame([], schema)
    kinds = spark.createDataFrame([], schema).schema
    names = kinds.fieldNames()
    rows = spark.read.schema(T.StructType([*kinds, T.StructField("entry", T.LongType()), T.StructField("version", T.LongType())])).parquet(path)
    last = rows.groupBy("path").agg(F.max_by(F.struct(*names), F.struct("version", "entry")).alias("last"))
    return last.select("last.*")


def _next_version(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """``rows`` as one more version, which appears whole or not at all; the number of rows."""
    number = max(versions(spark, path), default=-1) + 1
    return staged(rows.withColumn("entry", F.monotonically_increasing_id()), f"{path}/version={number}")


def add_findings(items: DataFrame, path: str, analyse: Callable[[DataFrame], DataFrame], schema: str) -> int:
    """Findings of the items (path, ...) that the cache lacks, by ``analyse``, appended to it; how many there were.

    Only items without an entry are analysed; a repeated item is analysed once. A cache has one writer at a time.
    """
    spark = items.sparkSession
    todo = items.dropDuplicates(["path"])
    if versions(spark, path):
        todo = todo.join(spark.read.schema("path string").parquet(path), "path", "left_anti")
    if todo.isEmpty():
        return 0
    names = spark.createDataFrame([], schema).columns
    return _next_version(spark, path, analyse(todo).select(*names))


def _replaced(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """``rows`` as the only version of a cache, whose old versions stay until all is written."""
    beside = Folder(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    n = staged(rows.withColumn("entry", F.monotonically_increasing_id()), f"{beside.path}/version={max(versions(spark, path), default=0)}")
    old = Folder(spark, f"{beside.path}.old")
    Folder(spark, path).rename(old.path)
    try:
        beside.rename(path)
    except Exception:
        old.rename(path)
        raise
    old.delete()
    return n


def compact_findings(spark: SparkSession, path: str, schema: str) -> int:
    """The cache as one version with the last entry of each path; the number of paths."""
    return _replaced(spark, path, cached_findings(spark, path, schema))


def refresh_cache(spark: SparkSession, path: str, schema: str, expert: str, again: Callable[[DataFrame], DataFrame]) -> int:
    """The finding of one expert made anew by ``again`` (rows -> path, finding), where the trace says that it ran or
    failed; the whole cache is written beside and put in place. The number of rows made anew."""
    rows = cached_findings(spark, path, schema)
    fresh = kept(again(rows.filter(F.col("findings").isNotNull() & _called(expert))).select("path", "finding"))
    _replaced(spark, path, refresh_findings(rows, expert, fresh))
    return fresh.count()


def _called(expert: str) -> Column:
    return F.exists("trace", lambda s: (s["expert"] == expert) & s["action"].isin("run", "error"))


def refresh_findings(cached: DataFrame, expert: str, again: DataFrame) -> DataFrame:
    """``cached`` analyses (path, findings map, trace, ...) with the finding of ``expert`` replaced by that of ``again``
    (path, finding) where the trace says that it ran or failed; others stay."""
    joined = cached.join(again.select("path", F.col("finding").alias("_new")), "path", "left")
    rest = F.map_filter("findings", lambda k, v: k != expert)
    fresh = F.map_concat(rest, F.map_from_arrays(F.array(F.lit(expert)), F.array("_new")))
    return joined.withColumn("findings", F.when(_called(expert) & F.col("_new").isNotNull(), fresh).otherwise(F.col("findings"))).select(cached.columns)


def write_calibration(spark: SparkSession, calibration: Calibration, path: str) -> None:
    """A calibration as rows of JSON, some for each expert, staged and renamed (see ``store``)."""
    lists = lambda m: [None if v is None else v.tolist() for v in (m.mean, m.scale, m.coef, m.median, m.spread)]
    none = [None] * 5
    rows = [("model", *m.split("|"), *lists(x), float(x.intercept)) for m, x in calibration.models.items()]
    rows += [("weight", o, e, *none, float(w)) for o, own in calibration.weights.items() for e, w in own.items()]
    rows += [("bias", o, None, *none, float(b)) for o, b in calibration.bias.items()]
    rows += [("auc", o, e, *none, float(a)) for o, own in calibration.aucs.items() for e, a in own.items() if a == a]
    staged(spark.createDataFrame(rows, CALIBRATION).coalesce(1), path, "json")


def read_calibration(spark: SparkSession, path: str) -> Calibration:
    out = Calibration({}, {}, {}, {})
    for r in spark.read.schema(CALIBRATION).json(path).collect():  # some rows for each expert
        if r["kind"] == "model":
            mean, scale, coef, median, spread = (None if r[c] is None else np.array(r[c]) for c in ("mean", "scale", "coef", "median", "spread"))
            out.models[f"{r['without']}|{r['expert']}"] = Model(mean, scale, coef, r["value"], median, spread)
        elif r["kind"] == "weight":
            out.weights.setdefault(r["without"], {})[r["expert"]] = r["value"]
        elif r["kind"] == "auc":
            out.aucs.setdefault(r["without"], {})[r["expert"]] = r["value"]
        else:
            out.bias[r["without"]] = r["value"]
    return out
