"""Expert evidence: feature models, findings, container rules, log-odds fusion, explanations.

Findings come in long form (clip, expert, feature, value); models and weights
are tables of a few hundred rows that the cluster's size limit for broadcast
joins lets Spark broadcast by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import clip, finite, forensic_verdict, lit, logit, prior_shift, robust_z, sigmoid, three_digits

#: Fixed values of the container rules.
CONTAINER_WEIGHTS = {"synth_tool_tag": 4.0, "header_issues": 0.8, "vocoder_grid": 1.2, "timestamp_issues": 1.0, "device_claim": -0.4}


def contributions(features: DataFrame, model: DataFrame) -> DataFrame:
    """(clip, expert, feature, value, contribution): coefficient times the clipped z value; non-finite values and features without a model drop out."""
    z = (F.col("value") - F.col("mean")) / F.coalesce(F.nullif("scale", lit(0)), lit(1))
    rows = features.withColumn("value", finite(F.col("value"))).filter("value is not null").join(model, ["expert", "feature"])
    return rows.select("clip", "expert", "feature", "value", (F.col("coef") * clip(z, -6, 6)).alias("contribution"))


def feature_scores(features: DataFrame, model: DataFrame, intercepts: DataFrame) -> DataFrame:
    """(clip, expert, score): null without a model or without any finite feature; a finite feature outside the model counts."""
    z = (F.col("value") - F.col("mean")) / F.coalesce(F.nullif("scale", lit(0)), lit(1))
    part = F.col("coef") * clip(z, -6, 6)
    rows = features.withColumn("value", finite(F.col("value"))).join(model, ["expert", "feature"], "left")
    sums = rows.groupBy("clip", "expert").agg(F.coalesce(F.sum(part), lit(0)).alias("total"), F.count("value").alias("n"))
    return sums.join(intercepts, "expert", "left").select("clip", "expert", F.when(F.col("n") > 0, sigmoid(F.col("intercept") + F.col("total"))).alias("score"))


def findings(scores: DataFrame, info: DataFrame) -> DataFrame:
    """(clip, expert, score, confidence): confidence cut to [0, 1]; the speaker expert abstains unless its backend is wavlm-xvector."""
    silent = (F.col("expert") == "speaker") & ~F.coalesce(F.col("backend") == "wavlm-xvector", F.lit(False))
    joined = scores.join(info, ["clip", "expert"])
    confidence = clip(F.col("confidence"), 0, 1)
    return joined.select("clip", "expert", F.when(~silent, F.col("score")).alias("score"), F.when(silent, lit(0)).otherwise(confidence).alias("confidence"))


def container_finding(df: DataFrame) -> DataFrame:
    """``df`` with score and confidence by the container rules; both features and rules are columns."""
    parts = [F.when(F.col(k) != 0, lit(w) * F.least(lit(2), F.col(k))) for k, w in CONTAINER_WEIGHTS.items()]
    total = sum((F.coalesce(p, lit(0)) for p in parts), lit(0))
    size = sum((F.abs(F.coalesce(p, lit(0))) for p in parts), lit(0))
    some = F.coalesce(*parts).isNotNull()
    return df.withColumns({"score": F.when(some, sigmoid(total)), "confidence": F.when(some, F.least(lit(0.9), lit(0.3) + lit(0.15) * size)).otherwise(lit(0))})


def fusion_terms(found: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(clip, expert, term): weight * confidence * log-odds of each finding with a score.

    Without weights every expert weighs 1; with weights, an expert that isn't among them weighs 0.
    """
    rows = found.filter("score is not null")
    rows = rows.withColumn("weight", lit(1)) if weights is None else rows.join(weights, "expert", "left")
    return rows.select("clip", "expert", (F.coalesce("weight", lit(0)) * F.col("confidence") * logit(F.col("score"))).alias("term"))


def fuse(found: DataFrame, weights: DataFrame | None, bias: float, prior: float) -> DataFrame:
    """(clip, probability, verdict), one row for each clip with findings."""
    terms = fusion_terms(found, weights).groupBy("clip").agg(F.sum("term").alias("total"))
    clips = found.select("clip").distinct().join(terms, "clip", "left")
    p = clips.select("clip", sigmoid(lit(bias) + prior_shift(prior) + F.coalesce("total", lit(0))).alias("probability"))
    return p.withColumn("verdict", forensic_verdict(F.col("probability")))


def top_terms(df: DataFrame, keys: list[str], name: str, value: str, k: int) -> DataFrame:
    """(keys, rank, name, value): the ``k`` largest by magnitude, ties by name; a bounded aggregation would not be shorter than this window over few rows a key."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs(F.col(value)).desc(), F.col(name)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, "rank", name, value)


def explanation(value: Column, median: Column, z: Column, contribution: Column, label: Column) -> Column:
    side = F.when(contribution > 0, "synthetic").otherwise("real")
    return F.concat(label, F.lit(" = "), three_digits(value), F.lit(" (real median "), three_digits(median), F.format_string(", z=%+.1f) points to %s", z, side))


def explanations(clips: DataFrame, parts: DataFrame, model: DataFrame, k: int = 2) -> DataFrame:
    """(clip, expert, text) for each of clips (clip, expert): the ``k`` features that moved the expert's score most.

    ``parts`` (clip, expert, feature, value, contribution, label) from ``contributions``; ``model`` (expert, feature, real_median,
    real_spread, ord), whose order breaks ties. Without contributions there is no calibrated evidence.
    """
    rows = parts.join(model.select("expert", "feature", "real_median", "real_spread", "ord"), ["expert", "feature"])
    z = F.round(robust_z(F.col("value"), F.col("real_median"), F.col("real_spread")), 6)  # so that halves show as halves
    text = explanation(F.col("value"), F.col("real_median"), z, F.col("contribution"), F.coalesce("label", "feature"))
    ranked = F.struct((-F.abs("contribution")).alias("rank"), "ord", text.alias("text"))
    named = rows.groupBy("clip", "expert").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(ranked)), 1, k), lambda r: r["text"]), "; ").alias("text"))
    return clips.select("clip", "expert").distinct().join(named, ["clip", "expert"], "left").fillna("no calibrated evidence", ["text"])


def design_matrix(found: DataFrame, experts: list[str]) -> DataFrame:
    """One row for each clip: confidence-weighted log-odds of each expert, 0 without a score."""
    cell = F.col("confidence") * logit(F.col("score"))
    return found.groupBy("clip").agg(*(F.coalesce(F.max(F.when((F.col("expert") == e) & F.col("score").isNotNull(), cell)), lit(0)).alias(e) for e in experts))


def confidence(expert: str, c: dict[str, Column]) -> Column:
    """An expert's own confidence from its measurements (seconds, Hz)."""
    one = lit(1)
    if expert == "spectral":
        return F.least(one, lit(0.3) + lit(0.25) * c["speech_s"]) * F.when(c["bandwidth_hz"] > lit(6000), one).otherwise(lit(0.6))
    if expert == "compression":
        return F.least(lit(0.7), lit(0.2) + c["duration_s"] / lit(10))
    if expert == "prosody":
        return F.least(one, c["voiced_s"] / lit(3))
    if expert == "environment":
        return F.least(one, lit(0.2) + c["pause_s"] / lit(2)) * F.least(one, c["duration_s"] / lit(4))
    if expert == "splice":
        return F.least(lit(0.8), lit(0.2) + c["duration_s"] / lit(8))
    if expert == "speaker":
        return F.when(c["sim_mean"].isNull(), lit(0)).otherwise(F.least(one, (c["duration_s"] - one) / lit(4)))
    if expert == "deep":
        return F.when(c["deep_score"].isNull(), lit(0)).otherwise(one)
    raise ValueError(f"unknown expert: {expert}")
