"""Routing of clips as their tabulated findings arrive in a folder, and a cache of findings that grows with it.

The route is one projection, so the stream needs no state; files are read once
by the checkpoint's log, and a restarted job goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators import routing
from tessera.sources import caches


def route_folder(spark: SparkSession, schema: StructType, source: str, target: str, checkpoint: str, weights: dict[str, float], bias: float, prior: float = 0.30, expert_auc: dict[str, float] | None = None) -> StreamingQuery:
    """Routes all rows that are in ``source`` now and ends; rows without a clip are dropped."""
    clips = spark.readStream.schema(schema).parquet(source).filter("clip is not null")
    routed = routing.route(clips, weights, bias, prior, expert_auc)
    return routed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyse_folder(spark: SparkSession, source: str, cache: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], schema: str) -> StreamingQuery:
    """Adds the findings of all files below ``source`` to a cache (see ``sources.caches``) and ends.

    ``analyse`` turns files (path, content) into rows of ``schema``. Each batch analyses the paths that the cache lacks and appears
    whole or not at all; a batch that is repeated after a stop finds its rows there and adds none.
    """
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("recursiveFileLookup", "true").load(source)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    add = lambda batch, _: caches.add_findings(batch, cache, analyse, schema)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
