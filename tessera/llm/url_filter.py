"""URL filters by hashed host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into all suffixes of its host, each
with the path prefixes whose lengths occur among the rules. Expressions meet
the rules in an equi-join on the first four bytes of their SHA-256 digests;
full digests are then compared, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import constant_rows, lower_ascii

PREFIX_HEX = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null or a text without ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, url.substr(cut + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, rule, verdict) for each distinct host and path of ``urls`` that a rule fits.

    ``rules`` are (verdict, host, path). A rule fits its host and all its subdomains if the URL's
    path starts with the rule's. Of several, the longest rule wins, then the one with the longer
    host, then block before allow.
    """
    spark = urls.sparkSession
    lengths = sorted({len(path) for _, _, path in rules})
    listed = constant_rows(spark, ["rule", "verdict", "size", "host_size", "strict"], [(h + p, v, len(h) + len(p), len(h), int(v == "block")) for v, h, p in rules])
    digest = F.sha2(F.col("rule"), 256)
    listed = listed.select("*", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_HEX).alias("short"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    expressions = (
        urls.select("host", "path").distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("expression", F.explode(F.transform(prefixes, lambda p: F.concat(F.col("suffix"), p))))
        .withColumn("digest", F.sha2(F.col("expression"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    fits = expressions.join(listed, "short").filter("digest = rule_digest")
    best = F.max(F.struct("size", "host_size", "strict", "rule", "verdict"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, url_col: str, rules: Sequence[tuple[str, str, str]], default: str = "allow", prefix: str = "") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` (null without one) and ``verdict``, each name behind ``prefix``.

    Null and malformed URLs have an empty host and path and get ``default``. Very long URLs count as a whole; a host is
    expanded into as many suffixes as it has labels. Repeated rows each get their own verdict; an empty table gives an empty one.
    Columns of ``pages`` with the new names raise ValueError; give a ``prefix`` then.
    """
    host, path, rule, verdict = (f"{prefix}{n}" for n in ("host", "path", "rule", "verdict"))
    if clash := [n for n in (host, path, rule, verdict) if n in pages.columns]:
        raise ValueError(f"columns exist already: {clash}")
    parts = pages.withColumns(dict(zip((host, path), url_parts(F.col(url_col)), strict=True)))
    if not rules:
        return parts.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(default)})
    found = match_rules(parts.select(F.col(host).alias("host"), F.col(path).alias("path")), rules)
    found = found.withColumnsRenamed({"host": host, "path": path, "rule": rule, "verdict": verdict})
    joined = parts.join(found, [host, path], "left")
    return joined.select(*pages.columns, host, path, rule, F.coalesce(verdict, F.lit(default)).alias(verdict))
