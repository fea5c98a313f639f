"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``, whatever other columns those have. Each row is a document
of its own: rows that share an id, or have none, are told apart by a key, and equal rows are copies
of each other. Null and empty texts have no words and go at the first stage. Very long texts
count as a whole. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, near_dedup, packing, quality, suffix_dedup
from tessera.llm.tables import saved, table, unused, with_keys


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and both classifiers accept, fitted on the labelled rows of ``docs``."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    prefix = "q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return quality.score_quality(docs, model, prefix=prefix).filter(f"`{prefix}kept`").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id; of equal ids, the first."""
    keyed = with_keys(docs, "doc_id")
    name = unused("kept_key", keyed.rows)
    kept = near_dedup.near_duplicates(keyed.by_key()).filter("kept").select(F.col(keyed.key).alias(name))
    return keyed.rows.join(kept, F.col(keyed.key) == F.col(name), "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document or place holds already; texts that lose all their bytes go."""
    keyed = with_keys(docs, "doc_id")
    name, text = unused("cut_key", keyed.rows), unused("cut_text", keyed.rows)
    cut = suffix_dedup.remove_repeats(keyed.by_key(), as_text=True).filter("kept != '' or n_bytes = 0")
    joined = keyed.rows.join(cut.select(F.col(keyed.key).alias(name), F.col("kept").alias(text)), F.col(keyed.key) == F.col(name))
    return joined.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark copies", benchmark_copies),
    ("packing", packed_sequences),
]

#: Trained classifiers, min-max hashes and alignments are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
