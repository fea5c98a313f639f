"""Cost-aware routing over tabulated findings, as a chain of column expressions.

The clip's findings are one row with a struct for each expert; every stage's
posterior is a column over the stages before it, so the whole route is one
projection without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import forensic_verdict, lit, logit, prior_shift, sigmoid
from tessera.operators import ranks
from tessera.operators.calibration import Calibration, HeldOut
from tessera.sources.store import kept

EXPERTS = ("container", "spectral", "compression", "prosody", "environment", "splice", "speaker", "deep")
ESCALATION = ("splice", "speaker", "deep")
#: The reasons of a step.
REASONS = {
    "container": "always: header and metadata triage",
    "spectral": "always: bandwidth steers later choices",
    "lossy": "lossy codec in container",
    "banded": "band-limited: transcoding?",
    "full band": "full-band PCM, no transcoding suspicion",
    "speech": "%.1f s of speech available",
    "no speech": "only %.1f s of speech",
    "environment": "cheap processing check (near-zero segments, mains hum)",
    "short": "short clip without pauses",
    "deep": "deep model set to always run",
    "no splice": "clip shorter than 1.5 s",
    "no speaker": "%.1f s speech < 2.0 s",
    "deep ran": "already run",
    "no deep": "no deep model configured",
    "flags": "metadata red flags",
}
#: The range of uncertain posteriors, costs of the escalation experts and their gain where no AUC is known.
LOW, HIGH = 0.35, 0.95
COST_MS = {"splice": 120.0, "speaker": 900.0, "deep": 400.0}
FALLBACK_GAIN = {"deep": 0.4, "splice": 0.05, "speaker": 0.05}


def escalation_order(expert_auc: dict[str, float], names: tuple[str, ...] = ESCALATION) -> list[str]:
    """Escalation experts by expected value for each millisecond, the largest first."""
    gain = {n: (abs(expert_auc[n] - 0.5) if n in expert_auc else FALLBACK_GAIN[n]) / COST_MS[n] for n in names}
    return sorted(names, key=lambda n: -gain[n])


def route(
    clips: DataFrame,
    weights: dict[str, float] | dict[str, Column],
    bias: float | Column,
    prior: float = 0.30,
    expert_auc: dict[str, float] | None = None,
    deep: str = "never",
    policy: str = "routed",
    low: float = LOW,
    high: float = HIGH,
    order: Column | None = None,
) -> DataFrame:
    """``clips`` with ``probability``, ``verdict`` and ``trace`` (array of expert, action, reason, posterior_after, ms), in running order.

    Columns of ``clips``: clip, duration_s, speech_s, lossy, banded, flags, and for each expert
    ``<expert>_score`` and ``<expert>_confidence``, perhaps ``<expert>_ms`` and ``<expert>_error``. A missing score adds nothing; a
    missing weight is 0, unless there are no weights at all, then 1. An expert with an error text that is called
    leaves a step "error" with that text and adds nothing; what it would have measured counts as not there. ``deep`` is
    never, uncertain or always; ``policy`` routed, or full, which runs every eligible expert.

    Each clip may have a calibration of its own: weights and ``bias`` can be columns, and ``order``, an array of the names of
    the escalation experts, stands in place of the order that ``expert_auc`` gives.
    """
    if deep not in ("never", "uncertain", "always") or policy not in ("routed", "full"):
        raise ValueError(f"unknown deep {deep!r} or policy {policy!r}")
    full = policy == "full"
    text = lambda c, where: F.format_string(where, c)
    there = lambda name, kind: F.col(name).cast(kind) if name in clips.columns else F.lit(None).cast(kind)
    failed = lambda e: there(f"{e}_error", "string").isNotNull()

    def term(e: str) -> Column:
        weight = weights.get(e, 0.0 if weights else 1.0)
        weight = F.coalesce(weight, lit(0)) if isinstance(weight, Column) else lit(weight)
        return F.coalesce(weight * there(f"{e}_confidence", "double") * logit(there(f"{e}_score", "double")), lit(0))

    out = clips.withColumn("_total", (bias if isinstance(bias, Column) else lit(bias)) + prior_shift(prior))
    steps: list[str] = []
    chosen = lambda name, of: F.coalesce(*(F.when(name == e, of(e)) for e in ESCALATION))

    def add(expert: str | Column, runs: Column, why: Column, why_not: Column) -> None:
        """One more step as columns: what it does, its reason, and the total after it. An expert that differs by clip is a column."""
        nonlocal out
        of = (lambda f: f(expert)) if isinstance(expert, str) else (lambda f: chosen(expert, f))
        error = of(lambda e: there(f"{e}_error", "string"))
        out = out.withColumn("_called", runs).withColumn("_runs", F.col("_called") & error.isNull())
        out = out.withColumn("_reason", F.when(F.col("_runs"), why).when(F.col("_called"), error).otherwise(why_not))
        out = out.withColumn("_total", F.col("_total") + F.when(F.col("_runs"), of(term)).otherwise(lit(0)))
        action = F.when(F.col("_runs"), "run").when(F.col("_called"), "error").otherwise("skip")
        after = F.when(F.col("_runs"), F.round(sigmoid(F.col("_total")), 4))
        ms = F.when(F.col("_runs"), of(lambda e: there(f"{e}_ms", "double")))
        name = F.lit(expert) if isinstance(expert, str) else expert
        steps.append(f"_step_{len(steps)}")
        out = out.withColumn(steps[-1], F.struct(name.alias("expert"), action.alias("action"), F.col("_reason").alias("reason"), after.alias("posterior_after"), ms.alias("ms")))

    yes, none = F.lit(True), F.lit("")
    unless_full = lambda why: F.lit("full") if full else why
    known = lambda name, expert: F.coalesce(F.col(name), F.lit(False)) & ~failed(expert)
    speech, flags, lossy, banded = F.col("speech_s"), known("flags", "container"), known("lossy", "container"), known("banded", "spectral")
    add("container", yes, F.lit(REASONS["container"]), none)
    add("spectral", yes, F.lit(REASONS["spectral"]), none)
    why = F.when(lossy, REASONS["lossy"]).otherwise(REASONS["banded"])
    add("compression", yes if full else lossy | banded, unless_full(why), F.lit(REASONS["full band"]))
    add("prosody", speech >= 1, text(speech, REASONS["speech"]), text(speech, REASONS["no speech"]))
    long_enough = (F.col("duration_s") >= 2) | (speech < F.col("duration_s") - lit(0.3))
    add("environment", long_enough, unless_full(F.lit(REASONS["environment"])), F.lit(REASONS["short"]))
    always = deep == "always" or (deep != "never" and full)
    if always:
        add("deep", yes, F.lit(REASONS["deep"]), none)
    eligible = {
        "splice": (F.col("duration_s") >= lit(1.5), F.lit(REASONS["no splice"])),
        "speaker": (speech >= 2, text(speech, REASONS["no speaker"])),
        "deep": (failed("deep") if always else F.lit(deep != "never"), F.lit(REASONS["deep ran" if always else "no deep"])),
    }
    for e in escalation_order(expert_auc or {}) if order is None else [order[i] for i in range(len(ESCALATION))]:
        can, why_not = eligible[e] if isinstance(e, str) else (chosen(e, lambda name, part=part: eligible[name][part]) for part in (0, 1))
        p = sigmoid(F.col("_total"))
        uncertain = (p > lit(low)) & (p < lit(high))
        forced = flags & (F.lit(e == "splice") if isinstance(e, str) else e == "splice")
        inside, outside = (text(p, f"{word}: P=%.2f {where} ({low}, {high})") for word, where in (("uncertain", "inside"), ("confident", "outside")))
        why = F.when(forced & ~uncertain, REASONS["flags"]).otherwise(inside)
        add(e, can if full else can & (uncertain | forced), unless_full(why), F.when(~can, why_not).otherwise(outside))
    p = sigmoid(F.col("_total"))
    return out.select(*clips.columns, p.alias("probability"), forensic_verdict(p).alias("verdict"), F.array(*steps).alias("trace"))


def calibration_columns(calibration: Calibration) -> DataFrame:
    """(without, weights map, bias, order) of each of a calibration's sets of left-out folds: a row for each."""
    rows = [(o, {e: float(w) for e, w in own.items()}, float(calibration.bias[o]), escalation_order({e: a for e, a in calibration.aucs.get(o, {}).items() if a == a})) for o, own in calibration.weights.items()]
    return SparkSession.getActiveSession().createDataFrame(rows, "without string, weights map<string,double>, bias double, order array<string>")


def route_by(clips: DataFrame, calibrations: DataFrame, key: str = "without", **options: object) -> DataFrame:
    """``route`` with each clip's own weights, bias and order, from the row of ``calibrations`` (key, weights, bias, order) with its ``key``."""
    joined = clips.join(F.broadcast(calibrations.select(F.col(key), F.col("weights").alias("_weights"), F.col("bias").alias("_bias"), F.col("order").alias("_order"))), key)
    experts = [c.removesuffix("_score") for c in clips.columns if c.endswith("_score")]
    out = route(joined, {e: F.col("_weights")[e] for e in experts}, F.col("_bias"), order=F.col("_order"), **options)
    return out.select(*clips.columns, "_weights", "_bias", "probability", "verdict", "trace")


def wide_findings(terms: DataFrame, experts: Sequence[str] = EXPERTS) -> DataFrame:
    """One row for each clip of (clip, expert, score, confidence, ...) with ``<expert>_score`` and ``<expert>_confidence``."""
    return terms.groupBy("clip").agg(*(F.max(F.when(F.col("expert") == e, F.col(c))).alias(f"{e}_{c}") for e in experts for c in ("score", "confidence")))


def replay_out_of_fold(clips: DataFrame, held: HeldOut, prior: float = 0.30, metric_prior: float = 0.5, **options: object) -> tuple[DataFrame, DataFrame]:
    """Routed decisions and those of all findings, each clip under the calibration fitted without its fold.

    ``clips``: (clip, duration_s, speech_s, lossy, banded, flags), perhaps ``<expert>_ms`` and ``<expert>_error``; ``held``
    from ``calibration.held_out``. Deep scores say nothing of the folds they come from, so ``deep`` stays never. Returns the
    routed clips (with y, without, probability, full_probability, verdict, trace) and the report of ``replay_report``.
    """
    if options.get("deep", "never") != "never":
        raise ValueError("replay out of fold needs deep='never'")
    if held.source is None:
        labels = held.folds.select("clip", "y", F.col("fold").cast("string").alias("without"))
        rows = clips.join(labels, "clip").join(wide_findings(held.terms), "clip", "left")
    else:
        rows = clips.join(held.source.wide(EXPERTS).drop("total"), "clip")  # labels and findings without a shuffle of their own
    routed = route_by(rows, calibration_columns(held.calibration), prior=prior, **options)
    total = F.col("_bias") + prior_shift(prior)
    for e in EXPERTS:
        if e != "deep":
            total = total + F.coalesce(F.col("_weights")[e] * F.col(f"{e}_confidence") * logit(F.col(f"{e}_score")), lit(0))
    routed = kept(routed.withColumn("full_probability", sigmoid(total)).drop("_weights", "_bias"))
    return routed, replay_report(routed, metric_prior)


def replay_report(routed: DataFrame, metric_prior: float = 0.5) -> DataFrame:
    """(mode full or routed, auc, eer, min_dcf_nsa, min_dcf_code, metric_p_spoof, mean_experts_run, escalated_share, compute_share_vs_full).

    ``routed``: (y, probability, full_probability, trace, perhaps <expert>_ms). The share of the cost is that of the steps that
    ran in the cost of all findings; null without costs. The last three are the same in both rows.
    """
    ran = F.transform(F.filter("trace", lambda s: s["action"] == "run"), lambda s: s["expert"])
    costs = F.create_map(*(x for e in EXPERTS if f"{e}_ms" in routed.columns for x in (F.lit(e), F.col(f"{e}_ms").cast("double")))) if any(c.endswith("_ms") for c in routed.columns) else F.lit(None).cast("map<string,double>")
    spent = lambda of: F.aggregate(of, lit(0), lambda s, v: s + F.coalesce(v, lit(0)))
    steps = routed.select(F.col("y").cast("double").alias("y"), "full_probability", "probability", ran.alias("ran"), costs.alias("ms"))
    late = F.arrays_overlap("ran", F.array(*map(F.lit, ESCALATION))).cast("int")
    # Several passes read these numbers; traces are some hundred bytes a clip.
    each = kept(steps.select("y", "full_probability", "probability", F.size("ran").alias("n"), late.alias("late"), spent(F.transform("ran", lambda e: F.col("ms")[e])).alias("spent"), spent(F.map_values("ms")).alias("whole")))
    share = F.round(F.sum("spent") / F.nullif(F.sum("whole"), lit(0)), 3)
    totals = each.agg(F.round(F.avg("n"), 2).alias("mean_experts_run"), F.round(F.avg("late"), 3).alias("escalated_share"), share.alias("compute_share_vs_full"))

    def modes(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        y, full, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "full_probability", "probability"))
        yield from (("full", full, y), ("routed", part, y))

    found = ranks.summaries(each.select("y", "full_probability", "probability"), modes, metric_prior)
    columns = ("auc", "eer", "min_dcf_nsa", "min_dcf_code", "metric_p_spoof")
    scores = routed.sparkSession.createDataFrame([(m, *(own[c] for c in columns)) for m, own in sorted(found.items())], f"mode string, {', '.join(f'{c} double' for c in columns)}")
    return scores.join(F.broadcast(totals), how="cross")


def skip_reasons(routed: DataFrame, k: int = 8) -> DataFrame:
    """(reason, n): the most frequent "expert: reason" of skipped steps, up to a colon in the reason."""
    steps = routed.select(F.explode("trace").alias("s")).filter("s.action = 'skip'")
    reason = F.concat_ws(": ", "s.expert", F.element_at(F.split("s.reason", ":"), 1))
    return steps.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)


def replay_totals(routed: DataFrame, cost_ms: DataFrame) -> DataFrame:
    """One row: mean experts run, share of escalated clips, share of the full cost, from a cost table (expert, ms)."""
    steps = routed.select("clip", F.explode("trace").alias("s")).select("clip", "s.expert", (F.col("s.action") == "run").cast("int").alias("ran")).join(F.broadcast(cost_ms), "expert")
    late = F.col("expert").isin("splice", "speaker", "deep").cast("int") * F.col("ran")
    clips = steps.groupBy("clip").agg(F.sum("ran").alias("ran"), F.max(late).alias("late"), F.sum(F.col("ms") * F.col("ran")).alias("spent"), F.sum("ms").alias("full"))
    return clips.agg(F.avg("ran").alias("mean_experts_run"), F.avg("late").alias("escalated_share"), (F.sum("spent") / F.sum("full")).alias("compute_share_vs_full"))


def replay(clips: DataFrame, weights: dict[str, float], bias: float, y: str = "y", prior: float = 0.30, expert_auc: dict[str, float] | None = None, deep: str = "never", metric_prior: float = 0.5) -> DataFrame:
    """(mode, auc, eer, min_dcf_nsa, min_dcf_code, metric_p_spoof): routed decisions beside those of all experts' fused findings."""
    from tessera.operators import metrics

    experts = [c.removesuffix("_score") for c in clips.columns if c.endswith("_score") and (deep != "never" or c != "deep_score")]
    total = lit(bias) + prior_shift(prior)
    for e in experts:
        total = total + F.coalesce(lit(weights.get(e, 0.0 if weights else 1.0)) * F.col(f"{e}_confidence") * logit(F.col(f"{e}_score")), lit(0))
    routed = route(clips, weights, bias, prior, expert_auc, deep).select(F.col(y).alias("y"), F.col("probability").alias("p"))
    whole = clips.select(F.col(y).alias("y"), sigmoid(total).alias("p"))
    named = lambda mode, df: metrics.summary(df, metric_prior).select(F.lit(mode).alias("mode"), "*")
    return named("full", whole).unionByName(named("routed", routed))
