"""Manifests of labelled corpora with the place of each clip, and late reading of the audio at these places.

A clip lies in a file of its own (``row`` -1), or in a row of a Parquet file: then file and row come from the
reader's metadata columns, so a manifest reads no audio.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.audio import decoded
from tessera.sources.readers import audio_files, manifest_columns

COLUMNS = ("uid", "source", "partition", "speaker", "system", "label", "path", "row")


def parquet_manifest(spark: SparkSession, path: str, source: str, partition: str, uid: Column, speaker: Column, label: Column, system: Column) -> DataFrame:
    """One row for each row of the Parquet files at ``path`` (a file, folder or pattern): the columns COLUMNS, the rest from the given ones.

    Real clips (label 0) are of the system "bonafide".
    """
    found = spark.read.parquet(path)
    given = {"uid": uid, "source": F.lit(source), "partition": F.lit(partition), "speaker": speaker, "system": F.when(label == 0, "bonafide").otherwise(system), "label": label.cast("int"), "path": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    return found.select(*(given[c].alias(c) for c in COLUMNS))


def numbered_through(manifest: DataFrame) -> DataFrame:
    """A whole ``parquet_manifest`` whose rows are numbered through all of its files, by their names, in place of from 0 in each; the
    counts come from the files' footers. Late reading needs the rows as they were."""
    name = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # paths are encoded; their order is that of the plain ones
    before = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.groupBy("path").agg(F.count("*").alias("_n")).select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return manifest.join(files, "path").withColumn("row", F.col("row") + F.col("_before")).select(*manifest.columns)


def attack_manifest(spark: SparkSession, path: str, partition: str, source: str = "la19") -> DataFrame:
    """A corpus of attacks: speaker_id, audio_file_name, system_id and key, which is 0 for real clips."""
    return parquet_manifest(spark, path, source, partition, F.col("audio_file_name"), F.col("speaker_id"), F.col("key"), F.col("system_id"))


def stem(name: Column) -> Column:
    """The last part of a path without its last ending; a leading dot is no ending."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def real_manifest(spark: SparkSession, pattern: str, source: str = "vctk") -> DataFrame:
    """Shards of real speech: speaker_id and file, whose name without ending is the clip's id."""
    return parquet_manifest(spark, pattern, source, source, stem(F.col("file")), F.col("speaker_id"), F.lit(0), F.lit("bonafide"))


def folder_manifest(spark: SparkSession, root: str, source: str, label: int | None) -> DataFrame:
    """Every audio file below a folder; without a label, -1, and ids are bare names."""
    files = audio_files(spark, root)
    rel = F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1 << 30)
    given = manifest_columns(rel, F.lit(source), F.lit(label).cast("int"), F.col("path")) | {"row": F.lit(-1).cast("long")}
    return files.select(*(given[c].alias(c) for c in COLUMNS))


#: The corpora by name, and where they lie below the root of the data.
CORPORA: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "la19:train": lambda spark, root: attack_manifest(spark, f"{root}/ext/la19_train.parquet", "train"),
    "la19:dev": lambda spark, root: attack_manifest(spark, f"{root}/ext/la19_validation.parquet", "dev"),
    "la19:eval": lambda spark, root: attack_manifest(spark, f"{root}/ext/la19_test.parquet", "eval"),
    "diffssd": lambda spark, root: folder_manifest(spark, f"{root}/diffssd/DiffSSD/generated_speech", "diffssd", 1),
    "lj": lambda spark, root: folder_manifest(spark, f"{root}/lj/resampled", "lj", 0),
    "test": lambda spark, root: folder_manifest(spark, f"{root}/test/HackGTHearsayTesting", "test", None),
    "vctk": lambda spark, root: real_manifest(spark, f"{root}/ext/vctk_*.parquet"),
}


def load_corpus(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The manifest of a corpus in CORPORA; KeyError for any other name."""
    return CORPORA[name](spark, root.rstrip("/"))


def cells_at(spark: SparkSession, manifest: DataFrame, cell: Column) -> DataFrame:
    """(columns of the manifest, content): what ``cell`` is in the Parquet row that each of the manifest's rows points at.

    Only the files that the manifest names are opened, and of these only the columns of ``cell``. Rows meet by file and
    row; a small manifest goes to the readers, so that a few clips cost no shuffle of audio.
    """
    files = [r["path"] for r in manifest.select("path").distinct().collect()]  # names of files, not of clips
    if not files:
        return manifest.withColumn("content", F.lit(None).cast("binary"))
    cells = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), cell.alias("content"))
    return manifest.join(cells, ["path", "row"]).select(*manifest.columns, "content")


def read_clips(spark: SparkSession, manifest: DataFrame, cell: str = "audio.bytes") -> DataFrame:
    """(uid, samples array<float>, rate, error) of each row of a manifest, wherever its audio lies; either samples or an error is null."""
    inside = cells_at(spark, manifest.filter("row >= 0"), F.col(cell)).select("uid", "content")
    alone = manifest.filter("row < 0")
    files = [r["path"] for r in alone.select(F.regexp_extract("path", "^(.*)/", 1).alias("path")).distinct().collect()]  # folders
    if files:
        found = spark.read.format("binaryFile").load(files).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        inside = inside.unionByName(alone.select("uid", F.regexp_replace("path", "^file:/*", "/").alias("path")).join(found, "path").select("uid", "content"))
    return decoded(inside.withColumnRenamed("uid", "path")).withColumnRenamed("path", "uid")
