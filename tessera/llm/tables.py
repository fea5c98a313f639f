"""Small helpers that the operators share: shared-folder tables, unique ids, packing of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text_kernels import tidy

#: Arrow batches of texts hold so many bytes at most, where the session keeps Spark's own bound of 64 MB.
BATCH_BYTES, SPARK_BATCH_BYTES = "8m", "67108864b"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, CAPITALS, SMALL)


def constant_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table, as literals of the plan."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("row")).select("row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only for a session that runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of tables from ``saved`` that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if folder.rsplit("/", 2)[-2] == "tessera":
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or ``name`` with underscores before it, so that none of the frames has such a column."""
    there = {c.lower() for df in frames for c in df.columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


class Keyed(NamedTuple):
    """Rows with a 64-bit key of their own in the column ``key``; where ids serve as keys, ``ids_are_keys``."""

    rows: DataFrame
    key: str
    id_col: str
    ids_are_keys: bool

    def by_key(self) -> Keyed:
        """The same rows, named by their keys."""
        return Keyed(self.rows, self.key, self.key, True)

    def texts(self, text_col: str, *others: str) -> DataFrame:
        """(id long, text, others); null texts are empty."""
        bounded_batches(self.rows.sparkSession)
        return self.rows.select(F.col(self.key).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *others)

    def named(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the ids as they came in, in the place of the keys in ``columns``."""
        names, out = df.columns, df
        for c in columns if not self.ids_are_keys else ():
            ids = self.rows.select(F.col(self.key).alias("_key"), F.col(self.id_col).alias("_id"))
            out = out.join(ids, out[c] == F.col("_key")).drop("_key", c).withColumnRenamed("_id", c)
        kind = self.rows.schema[self.id_col].dataType
        return out.select(*(F.col(c).cast(kind).alias(self.id_col if c == "id" else c) if c in columns else F.col(c) for c in names))


def with_keys(docs: DataFrame | Keyed, id_col: str) -> Keyed:
    """A key for each row, in the order of the ids, nulls first; rows that have keys already keep them.

    Whole numbers that are there and distinct are keys themselves. Otherwise (strings, nulls, repeated ids)
    the rows are sorted by id and numbered, and written, so that each row is a document of its own.
    """
    if isinstance(docs, Keyed):
        return docs
    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and not docs.groupBy(id_col).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col(id_col).isNull()).limit(1).count():
        return Keyed(docs, id_col, id_col, True)
    key = unused("row_key", docs)
    # what can't be hashed as it is (maps, at any depth) is hashed as JSON
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    rows = docs.orderBy(F.col(id_col).asc_nulls_first(), F.xxhash64(*parts)).withColumn(key, F.monotonically_increasing_id())
    return Keyed(saved(rows, "keyed"), key, id_col, False)


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_text(raw: bytes) -> bytes:
    """A text for a shuffle: 8 bytes of length, then zstd."""
    return len(raw).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack_text(packed: bytes) -> bytes:
    n = int.from_bytes(packed[:8], "little")
    return _ZSTD.decompress(packed[8:], decompressed_size=n, asbytes=True) if n else b""


def packs_by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed columns) for records sorted by bucket."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=False):
        yield int(bucket[a]), pack_text(b"".join([int(b - a).to_bytes(8, "little"), *(c[a:b].tobytes() for c in columns)]))


def unpack_columns(packs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for packed in packs:
        raw = unpack_text(packed)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for column, kind in zip(columns, kinds, strict=True):
            column.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True)]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            packed = [pack_text(x.as_buffer().to_pybytes()) for x in part.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], ["id", "packed"])


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the memory of Python workers low; a session's own bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) == SPARK_BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def packed(texts: DataFrame) -> DataFrame:
    """(id long, packed binary) of (id, text)."""
    return texts.select("id", "text").mapInArrow(tidy(_pack), "id long, packed binary")
