"""Report documents and files, explanations, the validation document, labelled lists and templates."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ablation, evidence, reports
from tessera.operators import calibration as C
from tessera.plans import evidence as plans
from tessera.sources import readers
from tests.test_calibration import contexts, frames

NAN = float("nan")


def plain_report(path, probability, verdict, trace, findings, terms):
    clean = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    ranked = sorted(terms.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:3]
    return {
        "file": path.rsplit("/", 1)[-1],
        "synthetic_probability": round(probability, 4),
        "verdict": verdict,
        "decision_threshold": 0.8,
        "expert_logodds": {k: round(v, 3) for k, v in terms.items()},
        "why": [f"{k} ({v:+.2f} log-odds toward {'synthetic' if v > 0 else 'real'}): {findings[k]['summary']}" for k, v in ranked],
        "trace": trace,
        "findings": {k: {n: {a: clean(b) for a, b in v.items() if a != "series"} if isinstance(v, dict) else clean(v) for n, v in f.items()} for k, f in findings.items()} or None,
    }


def test_documents_and_files(spark, tmp_path):
    step = lambda e, a: {"expert": e, "action": a, "reason": f"why {e}"}
    finding = lambda e, s, **more: {"expert": e, "score": s, "confidence": 0.5, "summary": f"{e} says", "features": {"a": 1.5, "b": NAN}, "evidence": {"x": "1", "series": "long"}, "contributions": {"a": math.inf}, "elapsed_ms": NAN} | more
    clips = {
        "/in/a b.wav": (0.123456, "likely real", [step("container", "run")], {e: finding(e, s) for e, s in (("spectral", 0.9), ("prosody", NAN), ("splice", 0.2), ("speaker", 0.4))}, {"spectral": 2.34567, "splice": -2.5, "speaker": 0.01, "prosody": -0.5}),
        "/in/b.wav": (0.9, "likely synthetic", [step("container", "error")], {}, {}),
        "/other/b.wav": (0.5, "suspicious", [], {"deep": finding("deep", None, features={}, evidence={}, contributions={}, elapsed_ms=3.0)}, {}),
    }
    kinds = "path string, probability double, verdict string, trace array<struct<expert:string,action:string,reason:string>>"
    routed = spark.createDataFrame([(p, x, v, [tuple(s.values()) for s in t]) for p, (x, v, t, _, _) in clips.items()], kinds)
    found = spark.createDataFrame([(p, *f.values()) for p, (*_, own, _) in clips.items() for f in own.values()], f"path string, {reports.FINDING}")
    terms = spark.createDataFrame([(p, e, t) for p, (*_, own) in clips.items() for e, t in own.items()], "path string, expert string, term double")
    docs = reports.report_documents(routed, found.repartition(3), terms)
    got = {r.path: (r.report_id, json.loads(r.json)) for r in docs.collect()}
    assert {p: d for p, (_, d) in got.items()} == {p: plain_report(p, *rest) for p, rest in clips.items()}
    assert list(got["/in/a b.wav"][1]["findings"]) == ["prosody", "speaker", "spectral", "splice"]
    for _ in range(2):  # the second set takes the place of the first
        assert reports.write_reports(docs, str(tmp_path / "r")) == 3
    files = {p.parent.name.removeprefix("report_id="): p.read_text() for p in (tmp_path / "r").rglob("part-*.txt")}
    assert {k: json.loads(v) for k, v in files.items()} == dict(got.values()) and len(files) == 3


def test_documents_move_lines_and_orders_once(spark):
    df = plans.report_documents(spark, "/root/testdata/sf0.001")
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum(" Exchange hashpartitioning(" in line and "ReusedExchange" not in line for line in final.splitlines()) <= 2 and "lineitem" in final


def test_three_significant_digits(spark):
    values = [0.0, 1.0, -2.5, 123.456, 999.4, 999.6, 1000.0, 12345.678, 0.00012345, 0.000099, -0.0001, 1e-12, 3e20, 0.1, 100.0, 45.0, 0.5, 22450.0, 12.25, 9995.0]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.three_digits(F.col("v")).alias("t")).collect()]
    assert got == [f"{v:.3g}" for v in values]


def test_explanations(spark):
    parts = spark.createDataFrame([("a", "x", "u", 1.5, 0.5, "the u"), ("a", "x", "v", 2.0, -0.5, None), ("a", "x", "w", 3.0, 0.1, None), ("b", "x", "u", 0.5, 0.0, "the u")], "clip string, expert string, feature string, value double, contribution double, label string")
    model = spark.createDataFrame([("x", f, 1.0, s, i) for i, (f, s) in enumerate((("v", 0.5), ("u", 0.0), ("w", 1.0)))], "expert string, feature string, real_median double, real_spread double, ord int")
    clips = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "clip string, expert string")
    got = {r.clip: r.text for r in evidence.explanations(clips, parts, model).collect()}
    assert got == {"a": "v = 2 (real median 1, z=+2.0) points to real; the u = 1.5 (real median 1, z=+0.5) points to synthetic", "b": "the u = 0.5 (real median 1, z=-0.5) points to real", "c": "no calibrated evidence"}


def test_validation_document(spark):
    sets = {}
    for name, seed in (("one", 4), ("two", 9)):
        rows, found, labels = frames(spark, 60, seed)
        moved = lambda df, n=name: df.withColumn("clip", F.concat(F.lit(f"{n}/"), "clip"))
        groups = labels.select("clip", F.when(F.col("y") == 1, F.concat(F.lit("g"), F.crc32(F.col("clip").cast("binary")) % 2)).otherwise("real").alias("group"))
        sets[name] = ablation.LabelledSet(*(moved(t) for t in (rows, found, labels, groups, contexts(spark, 60))))
    experts = ("good", "noise", "speaker", "rare", "container")
    text, candidate = ablation.report(sets, [("one", "two")], ["one", "two"], "two", sets["one"].parts()[:2], experts, earlier={"observations": ["kept"], "other": 1})
    out = json.loads(text)
    assert out["datasets"] == {n: {"files": 60, "synthetic": 30, "real": 30} for n in sets} and out["observations"] == ["kept"] and "other" not in out and "NaN" not in text
    held = C.held_out(*sets["two"].parts())
    assert out["within_set_oof"]["two"] == json.loads(json.dumps(ablation.within(held, sets["two"].groups, experts)))
    assert out["within_set_oof"]["two"]["experts"]["rare"]["auc"] == 0.5 and out["within_set_oof"]["two"]["validation"]["outer_folds"] == 5
    assert set(out["transfer"]["one -> two"]["experts"]) == set(experts) and 0.5 < out["transfer"]["one -> two"]["fused"]["auc"] <= 1
    assert out["candidate_calibration"]["fusion_weights"] == candidate.weights[""] and out["candidate_calibration"]["fusion_weights"]["container"] == 1
    assert set(out["router_replay_two"]) == {"full", "routed", "mean_experts_run", "escalated_share", "compute_share_vs_full", "top_skip_reasons"}
    table, told = ablation.unlabelled_scores(*sets["one"].parts()[:2], candidate)
    scores = sorted(r.forensic_score for r in table.collect())
    assert out["test_set_forensic_scores"] == told and told["files"] == 60 == len(scores) and told["quantiles"]["p50"] == pytest.approx((scores[29] + scores[30]) / 2, abs=1e-3)
    assert told["share_above_0.5"] == pytest.approx(sum(s >= 0.5 for s in scores) / 60, abs=1e-3)


def test_labelled_lists_and_templates(spark):
    kinds = "path string, duration double, findings map<string,double>"
    found = spark.createDataFrame([("a", 4.0, {"x": 1.0}), ("b", 2.0, {"x": 1.0}), ("c", 9.0, None), ("d", None, {"x": 1.0}), ("e", 5.0, {"x": 1.0})], kinds)
    items = spark.createDataFrame([(p, 1, f"g{p}") for p in "abcd"] + [("a", 1, "again")], "path string, y int, group string")
    rows = lambda least: sorted((r.path, r.group) for r in readers.labelled_findings(found, items, least).collect())
    assert rows(3.0) == [("a", "again"), ("a", "ga")] and rows(0.0) == [("a", "again"), ("a", "ga"), ("b", "gb"), ("d", "gd")]
    scores = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "filename string, score double")
    template = spark.createDataFrame([("a", "x"), ("b", "x")], "filename string, other string")
    assert [tuple(r) for r in readers.template_scores(scores, template).collect()] == [("a", 0.25), ("b", 0.5)]
    for bad in (template.limit(1), template.unionByName(spark.createDataFrame([("c", "x")], "filename string, other string"))):
        with pytest.raises(ValueError, match="coverage"):
            readers.template_scores(scores, bad)


def test_summary_table(spark, tmp_path):
    kinds = "path string, probability double, trace array<struct<expert:string,action:string>>"
    rows = [("/b/clip.wav", 0.25, [("container", "run"), ("prosody", "error"), ("spectral", "run"), ("splice", "skip")]), ("/a/clip.wav", 1 / 3, []), ("/a/other.wav", 1.0, [("deep", "run")])]
    routed = spark.createDataFrame(rows, kinds).repartition(3)
    assert reports.write_summary(routed, str(tmp_path / "s")) == 3
    lines = [line for p in sorted((tmp_path / "s").glob("part-*")) for line in p.read_text().splitlines()]
    cells = [line.split("\t") for line in lines]
    assert cells[0] == ["filename", "cm-score", "experts_run", "source_path", "report_id"]
    assert sorted(tuple(c[:4]) for c in cells[1:]) == [("clip.wav", "0.250000", "container,spectral", "/b/clip.wav"), ("clip.wav", "0.333333", "", "/a/clip.wav"), ("other.wav", "1.000000", "deep", "/a/other.wav")]
    assert len({c[4] for c in cells[1:]}) == 3
