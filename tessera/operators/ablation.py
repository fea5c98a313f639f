"""The whole validation of several labelled sets in one document.

Each set's clips are packed into blocks once; the held-out scores, transfers, replay and the final calibration
all start from these. Only metrics, some dozen rows for each set, reach the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import ALERT, P_SPOOF, TEST_PRIOR, prior_shift, sigmoid
from tessera.operators import calibration as C
from tessera.operators import routing
from tessera.operators.blocks import unpacked
from tessera.operators.running import percentiles
from tessera.sources.store import kept

EXPERTS = ("spectral", "compression", "prosody", "environment", "splice", "speaker", "container")
PROTOCOL = "nested clip-disjoint validation; the fusion uses inner out-of-fold scores"


class LabelledSet(NamedTuple):
    """rows (clip, expert, x), findings (clip, expert, score, confidence), labels (clip, y), generators (clip, group), and for replay
    contexts (clip, duration_s, speech_s, lossy, banded, flags)."""

    rows: DataFrame
    found: DataFrame
    labels: DataFrame
    groups: DataFrame
    contexts: DataFrame | None = None

    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.rows, self.found, self.labels

    def longer(self, clips: DataFrame) -> LabelledSet:
        """The same tables for some clips (clip)."""
        return LabelledSet(*(None if t is None else t.join(clips, "clip", "left_semi") for t in self))


def _plain(value: object) -> object:
    """Numbers that are not finite as null."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _by(df: DataFrame, key: str) -> dict[str, dict[str, object]]:
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in df.orderBy(key).collect()}


def within(held: C.HeldOut, groups: DataFrame, experts: Sequence[str] = EXPERTS, prior: float = P_SPOOF) -> dict[str, object]:
    """Metrics of held-out clips: each expert alone, all fused, the drop without each expert, and each generator against all real clips."""
    alone = _by(held.source.expert_summaries(experts, prior), "expert")
    fused = alone.pop("fused")
    fused.pop("coverage")
    return {
        "validation": {"protocol": PROTOCOL, "outer_folds": len(held.calibration.bias) - 1, "metric_p_spoof": prior, "ablation": "held-out inference omission; fusion is not refitted"},
        "experts": alone,
        "fused": fused,
        "heldout_expert_omission_auc_drop": {k: v["auc_drop"] for k, v in _by(held.source.omission_drops(experts), "expert").items()},
        "fused_auc_by_group": {k: v["auc"] for k, v in _by(C.slice_aucs(held.scored, groups), "group").items()},
    }


def transferred(train: C.HeldOut, test: C.HeldOut, experts: Sequence[str] = EXPERTS, prior: float = P_SPOOF) -> dict[str, object]:
    """The clips of one set under a calibration of the whole other; both are there in blocks."""
    alone = _by(C.applied(C.refitted(train), test).expert_summaries(experts, prior), "expert")
    fused = alone.pop("fused")
    fused.pop("coverage")
    return {"validation": "cross-dataset diagnostic; source independence not asserted", "metric_p_spoof": prior, "experts": {k: v["auc"] for k, v in alone.items()}, "fused": fused}


def unlabelled_scores(rows: DataFrame, found: DataFrame, calibration: C.Calibration) -> tuple[DataFrame, dict[str, object]]:
    """(clip, forensic_score, one column for each expert, null without a score) at the test's prior, and quantiles of the fused scores."""
    wide = C.applied(calibration, rows, found).wide(EXPERTS)
    table = wide.select("clip", F.round(sigmoid(F.col("total") + prior_shift(TEST_PRIOR)), 5).alias("forensic_score"), *(F.round(f"{e}_score", 4).alias(e) for e in EXPERTS))
    points = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    quantiles = percentiles(table, "forensic_score", points).select(*(F.round(p, 3).alias(p) for p in points)).first()
    shares = table.agg(F.count("*").alias("files"), *(F.round(F.avg((F.col("forensic_score") >= t).cast("int")), 3).alias(n) for n, t in (("share_above_alert_threshold", ALERT), ("share_above_0.5", 0.5)))).first()
    return table, shares.asDict() | {"quantiles": quantiles.asDict() if quantiles else {}}


def report(sets: dict[str, LabelledSet], transfers: Sequence[tuple[str, str]], deploy: Sequence[str], replayed: str, unlabelled: tuple[DataFrame, DataFrame] | None = None, experts: Sequence[str] = EXPERTS, prior: float = P_SPOOF, earlier: dict[str, object] | None = None) -> tuple[str, C.Calibration]:
    """The validation of all sets as JSON, and the candidate calibration fitted on those in ``deploy``.

    Keys: datasets, within_set_oof, transfer, router_replay_<replayed>, candidate_calibration, metric_p_spoof, perhaps
    test_set_forensic_scores; "observations" and "test_set_profile" of an ``earlier`` document are kept. Numbers that are not finite are null.
    """
    data = {n: s._replace(labels=kept(s.labels)) for n, s in sets.items()}
    held = {n: C.held_out(*s.parts(), ranked=n == replayed) for n, s in data.items()}
    sizes = {n: s.labels.agg(F.count("*").alias("files"), F.sum("y").alias("synthetic")).first() for n, s in data.items()}
    out: dict[str, object] = {
        "datasets": {n: {"files": r.files, "synthetic": r.synthetic, "real": r.files - r.synthetic} for n, r in sizes.items()},
        "within_set_oof": {n: within(h, data[n].groups, experts, prior) for n, h in held.items()},
        "transfer": {f"{a} -> {b}": transferred(held[a], held[b], experts, prior) for a, b in transfers},
    }
    rows, found = unpacked(_union([held[n].source.packed for n in deploy]))
    folds = kept(C.dealt(_union([data[n].labels.select("clip", "y") for n in deploy])))
    candidate = C.fit_calibration(rows, found, folds, folds.agg(F.max("fold")).first()[0] + 1)
    routed, replay = routing.replay_out_of_fold(data[replayed].contexts, held[replayed], metric_prior=prior)
    modes = _by(replay, "mode")
    cost = {k: modes["routed"].pop(k) for k in ("mean_experts_run", "escalated_share", "compute_share_vs_full")}
    out[f"router_replay_{replayed}"] = {"full": {k: v for k, v in modes["full"].items() if k not in cost}, "routed": modes["routed"], **cost, "top_skip_reasons": {r["reason"]: r["n"] for r in routing.skip_reasons(routed).collect()}}
    out["candidate_calibration"] = {"trained_on": list(deploy), "fusion_weights": candidate.weights[""], "expert_cv_auc": {e: round(a, 4) for e, a in candidate.aucs[""].items()}, "prior_shift_logit": round(math.log(TEST_PRIOR / (1 - TEST_PRIOR)), 4)}
    out["metric_p_spoof"] = prior
    if unlabelled:
        out["test_set_forensic_scores"] = unlabelled_scores(*unlabelled, candidate)[1]
    out |= {k: v for k, v in (earlier or {}).items() if k in ("observations", "test_set_profile")}
    return json.dumps(_plain(out), indent=1), candidate


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
