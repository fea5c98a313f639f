"""Tables between the passes of an operator, and writes that leave an earlier table readable until they are done."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to ``spark.checkpoint.dir``, without its lineage; Spark's cleaner deletes it after use.

    A session that runs on this machine alone and names no folder gets one of its own.
    """
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


class Folder:
    """A path of whatever store the session's Hadoop configuration knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark._jvm.org.apache.hadoop.fs, path.rstrip("/")
        self._at = self._jvm.Path(self.path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def names(self) -> list[str]:
        """The names of what lies in the folder, sorted; none if there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at)) if self.exists() else []

    def rename(self, to: str) -> None:
        target = self._jvm.Path(to)
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._at, target):
            raise OSError(f"cannot rename {self.path} to {to}")

    def delete(self) -> None:
        self._fs.delete(self._at, True)


def staged(df: DataFrame, path: str, kind: str = "parquet", check: Callable[[DataFrame], None] | None = None, by: Sequence[str] = (), **options: object) -> int:
    """Writes ``df`` beside ``path``, reads it back for ``check``, and then puts it in the place of what was there; the number of rows.
    ``by``: columns that make folders.

    If writing or checking fails, nothing at ``path`` has changed; if the last rename fails, the earlier table returns.
    """
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    new, old = Folder(spark, f"{beside}.new"), Folder(spark, path)
    try:
        df.write.format(kind).options(**options).partitionBy(*by).save(new.path)
        again = spark.read.format(kind).options(**options).schema(df.schema).load(new.path)
        if check:
            check(again)
        n = again.count()
        if old.exists():
            old.rename(f"{beside}.old")
            try:
                new.rename(path)
            except Exception:
                Folder(spark, f"{beside}.old").rename(path)
                raise
            Folder(spark, f"{beside}.old").delete()
        else:
            new.rename(path)
    finally:
        new.delete()
    return n
