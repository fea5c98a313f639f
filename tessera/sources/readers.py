"""Readers of manifests, score tables, findings and audio files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.store import staged

#: File endings that count as audio.
AUDIO = ("wav", "flac", "mp3", "m4a", "ogg", "opus", "aac", "webm")


def audio_files(spark: SparkSession, root: str, endings: tuple[str, ...] = AUDIO, strict: bool = False, content: bool = False) -> DataFrame:
    """(path, name, length, modified[, content]) of all audio files below ``root``.

    Strict: no part of the path below ``root`` is hidden, names are unique and there is at least
    one file, else ValueError. Otherwise only hidden names are left out.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", "^file:/*", "/")
    rel = F.expr(f"substring({'path'}, locate('{base}/', path) + {len(base) + 1})") if "'" not in base else F.col("path")
    name = F.element_at(F.split("path", "/"), -1)
    kept = found.filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*endings) & name.contains("."))
    kept = kept.filter(~rel.rlike(r"(^|/)\.") if strict else ~name.startswith("."))
    out = kept.select(path.alias("path"), name.alias("name"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    if strict:
        twice = [r["name"] for r in out.groupBy("name").count().filter("count > 1").orderBy("name").limit(5).collect()]
        if twice or not out.select("name").take(1):
            raise ValueError(f"duplicate names {twice}" if twice else f"no audio files below {root}")
    return out


def manifest_columns(rel: Column, source: Column, label: Column, path: Column) -> dict[str, Column]:
    """Manifest columns of a file by its path below the corpus' root: the generator is the first folder, the speaker a parent folder ``speaker_*``."""
    parts = F.split(rel, "/")
    n = F.size(parts)
    system = F.when(n > 1, parts[0]).otherwise(source)
    parent = F.when(n > 1, F.element_at(parts, -2)).otherwise("")
    return {
        "uid": F.when(label.isNull(), F.element_at(parts, -1)).otherwise(F.concat_ws("/", source, rel)),
        "source": source,
        "partition": source,
        "speaker": F.when(parent.startswith("speaker_"), parent).otherwise(system),
        "system": F.when(label == 0, "bonafide").otherwise(system),
        "label": F.coalesce(label, F.lit(-1)),
        "path": path,
    }


def read_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A strict tab-separated table, every cell a literal string; ValueError for anything malformed.

    A text pass checks what the CSV reader lets through: an empty file, blank lines, repeated or
    missing header names and rows of another width. Quotes have no meaning.
    """
    lines = spark.read.option("wholetext", "false").text(path)
    head = lines.limit(1).collect()
    if not head:
        raise ValueError("the file is empty")
    names = head[0]["value"].removeprefix("﻿").rstrip("\r").split("\t")
    if len(set(names)) != len(names) or not set(required) <= set(names):
        raise ValueError(f"the header needs unique columns with {required}: {names}")
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    width = lines.agg(F.count("*").alias("n"), F.count_if((F.size(cells) != len(names)) | (F.col("value") == "")).alias("bad")).first()
    if width["bad"] or width["n"] < 2:
        raise ValueError(f"{width['bad']} malformed rows of {width['n'] - 1}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    table = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", enforceSchema=True, mode="FAILFAST", nullValue="\u0000", emptyValue="")
    return table.select(*(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))


def _with_names(table: DataFrame, path: str) -> DataFrame:
    """``table`` if its file names follow the rules and none comes twice, else ValueError with the first five."""
    from tessera.operators.coverage import invalid_names

    found = [f"{r['filename']!r} ({r['problem']})" for r in invalid_names(table, "filename").orderBy("filename").limit(5).collect()]
    if found:
        raise ValueError(f"{path}: {', '.join(found)}")
    return table


def template_filenames(spark: SparkSession, path: str) -> DataFrame:
    """(filename) of a template; its other cells are placeholders."""
    return _with_names(read_tsv(spark, path, ["filename"]).select("filename"), path)


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """(uid, speaker, attack, label) of a protocol: lines of speaker, id, a dash, attack and label, between blanks."""
    return protocol_fields(spark.read.text(path), "value")


def protocol_fields(lines: DataFrame, line: str) -> DataFrame:
    cell = F.split(F.trim(F.col(line)), " +")
    label = F.when(F.get(cell, F.lit(4)) == "spoof", 1).when(F.get(cell, F.lit(4)) == "bonafide", 0)
    return lines.select(F.get(cell, F.lit(1)).alias("uid"), F.get(cell, F.lit(0)).alias("speaker"), F.get(cell, F.lit(3)).alias("attack"), label.alias("label"))


def join_protocol(clips: DataFrame, protocol: DataFrame, uid: str = "uid") -> DataFrame:
    """``clips`` with attack and label; ValueError with the first five ids that the protocol lacks."""
    missing = [r[uid] for r in clips.select(uid).join(protocol.select(uid), uid, "left_anti").orderBy(uid).limit(5).collect()]
    if missing:
        raise ValueError(f"not in the protocol: {missing}")
    return clips.join(protocol.select(uid, "attack", "label"), uid)


def dataset_variant(name: str, known: list[str]) -> tuple[str, bool, bool]:
    """(base, through a channel, trimmed) of a set's name; KeyError for a base that isn't ``known``."""
    base = name.removesuffix("_channel")
    channel = base != name
    trimmed = channel and base.endswith("_trim")
    base = base.removesuffix("_trim") if trimmed else base
    if base not in known:
        raise KeyError(name)
    return base, channel, trimmed


def parse_score(raw: Column) -> Column:
    """A double where the text is a plain number, else null."""
    return F.when(raw.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), raw.cast("double"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(filename, score); ValueError for names or scores that break the rules."""
    from tessera.operators.coverage import require_valid_scores

    scores = read_tsv(spark, path, ["filename", "cm-score"]).select("filename", parse_score(F.col("`cm-score`")).alias("score"))
    require_valid_scores(scores, "filename", "score")
    return scores


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """(filename, y): 1 for spoof, 0 for bonafide; any other label is a ValueError."""
    key = _with_names(read_tsv(spark, path, ["filename", "cm-label"]), path).select("filename", F.when(F.col("`cm-label`") == "spoof", 1).when(F.col("`cm-label`") == "bonafide", 0).alias("y"))
    bad = [r["filename"] for r in key.filter("y is null").orderBy("filename").limit(5).collect()]
    if bad:
        raise ValueError(f"labels must be spoof or bonafide: {bad}")
    return key


def write_submission(scores: DataFrame, path: str) -> int:
    """``scores`` (filename, score), checked first, as a tab-separated table with six decimals, sorted by name; the number of rows.

    It is written beside an earlier table, which stays until all is there.
    """
    from tessera.operators.coverage import require_valid_scores

    require_valid_scores(scores, "filename", "score")
    out = scores.select("filename", F.format_string("%.6f", F.col("score")).alias("cm-score"))
    return staged(out.orderBy("filename"), path, "csv", sep="\t", header=True, quote="")


FINDING = "path string, at timestamp, duration double, findings map<string, struct<expert:string,score:double,confidence:double,summary:string,features:map<string,double>,elapsed_ms:double>>, trace array<struct<expert:string,action:string,reason:string>>, error string"


def read_findings(spark: SparkSession, path: str, least_duration: float = 0.0) -> DataFrame:
    """Cached analyses, one for each path: the last by ``at``, rows without it first. Failed and short ones are left out."""
    from tessera.operators.sampling import keep_last

    rows = keep_last(spark.read.schema(FINDING).json(path), "path", F.struct(F.coalesce("at", F.lit("1970-01-01").cast("timestamp")), F.col("findings").isNotNull()))
    return rows.filter(F.col("findings").isNotNull() & (F.col("duration") >= least_duration))


def labelled_findings(findings: DataFrame, items: DataFrame, least_duration: float = 0.0) -> DataFrame:
    """Cached analyses of a labelled list (path, y, group), each with its label and group; listed files without findings, or shorter
    than ``least_duration`` seconds, are left out, and so are analyses that the list doesn't name. A path listed twice comes twice."""
    some = findings.filter(F.col("findings").isNotNull() & (F.coalesce("duration", F.lit(0.0)) >= least_duration))
    return items.select("path", "y", "group").join(some, "path")


def template_scores(scores: DataFrame, template: DataFrame) -> DataFrame:
    """Scores (filename, score) of exactly the names in a template (filename), sorted; ValueError if either has names that the other lacks."""
    from tessera.operators.coverage import require_coverage

    require_coverage(scores, template, "filename")
    return template.select("filename").join(scores.select("filename", "score"), "filename").orderBy("filename")


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Channel profiles as CSV below ``path``/clips and their percentiles as JSON below ``path``/summary."""
    from tessera.sources.audio import profile_summary

    profiles.write.mode("overwrite").csv(f"{path}/clips", header=True)
    profile_summary(profiles).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
