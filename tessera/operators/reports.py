"""One document for each clip: probability, terms, reasons, trace and findings, and their files.

Documents are built by columns, from one grouped aggregation of a clip's findings; files are written by
the tasks, each clip's under its report id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import ALERT, finite, lit, report_id
from tessera.sources.store import staged

#: Decimals of the probability and of the terms, and the number of experts among the reasons.
PROBABILITY_PLACES, TERM_PLACES, REASONS = 4, 3, 3
FINDING = "expert string, score double, confidence double, summary string, features map<string,double>, evidence map<string,string>, contributions map<string,double>, elapsed_ms double"


def _numbers(c: Column) -> Column:
    """A map of numbers in which those that are not finite are null."""
    return F.transform_values(c, lambda k, v: finite(v))


def reason(term: Column, expert: Column, summary: Column) -> Column:
    side = F.when(term > 0, "synthetic").otherwise("real")
    return F.concat(expert, F.format_string(" (%+.2f log-odds toward %s): ", term, side), F.coalesce(summary, F.lit("")))


def report_documents(routed: DataFrame, findings: DataFrame, terms: DataFrame) -> DataFrame:
    """(report_id, path, json) of clips (path, probability, verdict, trace), their findings (path, and the columns FINDING), one for
    each expert, and terms (path, expert, term).

    Numbers that are not finite are null, never left out; long series stay behind; the probability has four decimals, a term
    three. Reasons are the three largest terms, ties by the expert's name. A clip without findings has a document too.
    """
    finding = F.struct(
        "expert", finite(F.col("score")).alias("score"), finite(F.col("confidence")).alias("confidence"), "summary", _numbers(F.col("features")).alias("features"),
        F.map_filter("evidence", lambda k, v: k != "series").alias("evidence"), _numbers(F.col("contributions")).alias("contributions"), finite(F.col("elapsed_ms")).alias("elapsed_ms"),
    )
    # An expert has one finding, so a clip's lists are short. Both tables are grouped by path alone and meet by it, so what comes in parts by path stays there.
    found = findings.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("expert").alias("key"), finding.alias("value")))).alias("findings"))
    own = terms.groupBy("path", "expert").agg(F.sum("term").alias("term")).filter("term is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("expert", "term"))).alias("_own"))
    rows = found.join(own, "path", "left").withColumn("_own", F.filter(F.coalesce("_own", F.array()), lambda t: F.map_contains_key("findings", t["expert"])))
    ranked = F.transform("_own", lambda t: F.struct((-F.abs(t["term"])).alias("rank"), t["expert"].alias("name"), reason(t["term"], t["expert"], F.element_at("findings", t["expert"])["summary"]).alias("text")))
    rows = rows.select(
        "path", "findings", F.map_from_entries(F.transform("_own", lambda t: F.struct(t["expert"].alias("key"), F.round(t["term"], TERM_PLACES).alias("value")))).alias("terms"),
        F.transform(F.slice(F.array_sort(ranked), 1, REASONS), lambda r: r["text"]).alias("why"),
    )
    names = F.array_sort(F.map_keys("findings"))
    rows = rows.withColumn("findings", F.map_from_arrays(names, F.transform(names, lambda n: F.element_at("findings", n))))
    joined = routed.select("path", "probability", "verdict", "trace").join(rows, "path", "left")
    document = F.struct(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.round(finite(F.col("probability")), PROBABILITY_PLACES).alias("synthetic_probability"), "verdict", lit(ALERT).alias("decision_threshold"),
        F.coalesce("terms", F.create_map().cast("map<string,double>")).alias("expert_logodds"), F.coalesce("why", F.array().cast("array<string>")).alias("why"), "trace", F.col("findings"),
    )
    return joined.select(report_id(F.col("path")).alias("report_id"), "path", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def write_reports(documents: DataFrame, path: str) -> int:
    """One text file for each document below ``path``/report_id=...; the number of documents. An earlier set of reports stays until all are there."""
    rows = documents.dropDuplicates(["report_id"]).select("report_id", F.col("json").alias("value"))
    return staged(rows.repartition("report_id"), path, "text", by=["report_id"])


def summary_rows(routed: DataFrame) -> DataFrame:
    """(filename, cm-score with six decimals, experts_run, source_path, report_id) of clips (path, probability, trace), by path.

    Experts that ran stand in running order, joined by commas; those that failed or were skipped don't.
    """
    ran = F.transform(F.filter("trace", lambda s: s["action"] == "run"), lambda s: s["expert"])
    name = F.element_at(F.split("path", "/"), -1)
    score = F.format_string("%.6f", F.col("probability"))
    return routed.select(name.alias("filename"), score.alias("cm-score"), F.array_join(ran, ",").alias("experts_run"), F.col("path").alias("source_path"), report_id(F.col("path")).alias("report_id")).orderBy("source_path")


def write_summary(routed: DataFrame, path: str) -> int:
    """``summary_rows`` as a tab-separated table; the number of rows. Files of one name in several folders have rows of their own."""
    return staged(summary_rows(routed), path, "csv", sep="\t", header=True, quote="", emptyValue="")
