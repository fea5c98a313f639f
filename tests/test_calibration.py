"""Calibration, nested validation, replay and caches against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration as C
from tessera.operators import blocks, metrics, ranks, routing

NAMES = {"good": ("u", "v"), "noise": ("u", "v"), "speaker": ("sim",), "rare": ("u",)}


def evidence(n=80, seed=4):
    """Experts of which one knows the class; speaker rows of two backends; an expert with few clips; rules and deep scores."""
    rng = random.Random(seed)
    features, found, backends, labels = [], [], [], []
    for i in range(n):
        y = i % 2
        labels.append((f"c{i}", y))
        for e, gap in (("good", 1.2), ("noise", 0.0)):
            found.append((f"c{i}", e, None, 0.9))
            features += [(f"c{i}", e, f, rng.gauss(gap * y, 0.8) if rng.random() < 0.95 else rng.choice([None, float("nan")])) for f in ("u", "v")]
        features.append((f"c{i}", "speaker", "sim", rng.gauss(0.3 * y, 0.5)))
        backends.append((f"c{i}", "wavlm-xvector" if i % 3 else "mfcc-stats"))
        found.append((f"c{i}", "speaker", None, 0.8 if i % 3 else 0.0))
        if i < 15:
            features.append((f"c{i}", "rare", "u", float(y)))
        found.append((f"c{i}", "container", rng.choice([0.9, 0.6]) if y else rng.choice([0.5, 0.2]), 0.6) if i % 4 else (f"c{i}", "container", None, 0.0))
        found.append((f"c{i}", "deep", 0.99 if y else 0.02, 1.0))
    return features, found, backends, labels


def frames(spark, n=80, seed=4):
    features, found, backends, labels = evidence(n, seed)
    rows = C.expert_rows(spark.createDataFrame(features, "clip string, expert string, feature string, value double"), NAMES, spark.createDataFrame(backends, "clip string, backend string"))
    return rows.cache(), spark.createDataFrame(found, "clip string, expert string, score double, confidence double"), spark.createDataFrame(labels, "clip string, y int")


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def logit(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def plain_fit(x, y, c):
    """Newton steps on the whole design; classes weigh the same."""
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.append(np.full(x.shape[1], 1 / c), 1e-9)
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = sigmoid(z @ beta)
        beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * beta)
    return beta[:-1], beta[-1]


class Plain:
    """The calibration of the clips for which ``learns`` holds, whose inner folds are their folds."""

    def __init__(self, seed, n, folds, learns, validated=("container",)):
        features, found, backends, labels = evidence(n, seed)
        y = dict(labels)
        self.conf = {(c, e): p for c, e, _, p in found}
        self.rule = {(c, e): s for c, e, s, _ in found if e in validated and s is not None}
        backend = dict(backends)
        cells = {}
        for c, e, f, v in features:
            if v is not None and math.isfinite(v) and (e != "speaker" or backend[c] == "wavlm-xvector"):
                cells.setdefault((c, e), {})[f] = v
        self.x = {k: np.array([v.get(f, np.nan) for f in NAMES[k[1]]]) for k, v in cells.items()}
        self.models, self.auc, oof = {}, {}, {}
        for e in NAMES:
            clips = [c for c, _ in labels if learns(c) and (c, e) in self.x]
            if len(clips) < 20 or len({y[c] for c in clips}) < 2:
                continue
            self.models[e] = self.model(clips, e, y)
            for k in {folds[c] for c in clips}:
                inner = self.model([c for c in clips if folds[c] != k], e, y)
                oof |= {(c, e): self.score(inner, self.x[c, e]) for c in clips if folds[c] == k}
            p, t = np.array([oof[c, e] for c in clips]), np.array([y[c] for c in clips])
            self.auc[e] = np.mean([(a > b) + (a == b) / 2 for a in p[t == 1] for b in p[t == 0]])
        names, everyone = sorted(self.models), [c for c, _ in labels if learns(c)]
        design = np.array([[self.conf.get((c, e), 0) * logit(oof[c, e]) if (c, e) in oof else 0.0 for e in names] for c in everyone])
        coef, self.bias = plain_fit(design, np.array([float(y[c]) for c in everyone]), 1.0)
        self.weights = {e: round(w, 4) for e, w in zip(names, coef, strict=True)} | {"container": 1.0, "deep": 1.0}

    def model(self, clips, e, y):
        x, t = np.array([self.x[c, e] for c in clips]), np.array([float(y[c]) for c in clips])
        mean, scale = np.nanmean(x, 0), np.nanstd(x, 0)
        z = np.clip((np.where(np.isfinite(x), x, mean) - mean) / scale, -6, 6)
        real = x[t == 0]
        q25, q50, q75 = np.nanpercentile(real, [25, 50, 75], axis=0)
        return mean, scale, *plain_fit(z, t, 0.3), q50, (q75 - q25) / 1.349

    def score(self, model, x):
        mean, scale, coef, intercept, *_ = model
        return sigmoid(intercept + coef @ np.clip((np.where(np.isfinite(x), x, mean) - mean) / scale, -6, 6))

    def terms(self, clip):
        scores = {e: self.score(m, self.x[clip, e]) for e, m in self.models.items() if (clip, e) in self.x} | {e: s for (c, e), s in self.rule.items() if c == clip}
        return {e: self.weights.get(e, 0.0) * self.conf.get((clip, e), 0.0) * logit(s) for e, s in scores.items()}

    def fused(self, clip):
        return sigmoid(self.bias + sum(self.terms(clip).values()))


def test_calibration_matches_a_plain_one(spark):
    rows, found, labels = frames(spark)
    folds = C.dealt(labels)
    of = {r.clip: r.fold for r in folds.collect()}
    got = C.fit_calibration(rows, found, folds, 5)
    want = Plain(4, 80, of, lambda c: True)
    assert set(want.models) == {"good", "noise", "speaker"} and {m.split("|")[1] for m in got.models} == set(want.models)  # "rare" has 15 clips
    for e, (mean, scale, coef, intercept, median, spread) in want.models.items():
        m = got.models[f"|{e}"]
        for a, b in ((m.mean, mean), (m.scale, scale), (m.coef, coef), (m.median, median), (m.spread, spread)):
            assert np.allclose(a, b, atol=1e-6)
        assert math.isclose(m.intercept, intercept, abs_tol=1e-6) and math.isclose(got.aucs[""][e], want.auc[e], abs_tol=1e-9)
    assert got.weights[""] == pytest.approx(want.weights, abs=1.01e-4) and math.isclose(got.bias[""], want.bias, abs_tol=1e-6)


def test_nested_validation_matches_a_plain_one_and_leaks_nothing(spark):
    rows, found, labels = frames(spark)
    folds = C.dealt(labels).cache()
    held = C.held_out(rows, found, labels, folds=folds)
    of = {r.clip: r.fold for r in folds.collect()}
    plain = {k: Plain(4, 80, of, lambda c, k=k: of[c] != k) for k in range(5)}
    got = {r.clip: r.probability for r in held.scored.collect()}
    assert len(got) == 80 and all(math.isclose(p, plain[of[c]].fused(c), abs_tol=1e-4) for c, p in got.items())

    # Labels of the clips of one fold say nothing about how they are scored.
    swapped = folds.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    again = {r.clip: r.probability for r in C.held_out(rows, found, labels, folds=swapped).scored.collect()}
    assert all(math.isclose(again[c], got[c], abs_tol=1e-9) for c in got if of[c] == 0) and any(abs(again[c] - got[c]) > 1e-3 for c in got if of[c] != 0)

    # Container evidence counts; deep scores only if they are asked for.
    without = {r.clip: r.probability for r in C.held_out(rows, found.filter("expert != 'container'"), labels, folds=folds).scored.collect()}
    changed = [c for c, e, s, _ in evidence()[1] if e == "container" and s is not None and s != 0.5]
    assert changed and all(abs(without[c] - got[c]) > 1e-6 for c in changed)
    deep = {r.clip: r.probability for r in C.held_out(rows, found, labels, folds=folds, fixed=("container", "deep")).scored.collect()}
    y = {r.clip: r.y for r in labels.collect()}
    assert all((deep[c] > got[c]) == bool(y[c]) for c in got)

    # Omissions, experts alone, slices.
    area = lambda p: np.mean([(p[a] > p[b]) + (p[a] == p[b]) / 2 for a in p if y[a] for b in p if not y[b]])
    experts = ["container", "good", "noise", "rare", "speaker"]
    drops = {r.expert: r.auc_drop for r in C.omission_drops(held.scored, held.terms, experts).collect()}
    terms = {}
    for r in held.terms.collect():
        terms.setdefault(r.clip, {})[r.expert] = (r.score, r.term)
    total = {c: logit(p) for c, p in got.items()}
    for e in experts:
        assert drops[e] == pytest.approx(area(got) - area({c: round(total[c] - terms.get(c, {}).get(e, (0, 0))[1], 9) for c in got}), abs=1.01e-4)
    assert drops["rare"] == 0 and drops["good"] > 0.05
    alone = {r.expert: r for r in C.expert_summaries(held.scored, held.terms, experts).collect()}
    assert set(alone) == {"fused", *experts} and (alone["rare"].auc, alone["rare"].coverage) == (0.5, 0.0) and alone["fused"].coverage == 1
    for e in experts:
        own = {c: terms.get(c, {}).get(e, (None, 0))[0] for c in got}
        assert alone[e].auc == pytest.approx(area({c: 0.5 if s is None else s for c, s in own.items()}), abs=5.1e-5)
        assert alone[e].coverage == pytest.approx(np.mean([s is not None for s in own.values()]), abs=5.1e-4)
    one = metrics.summary(held.scored.select("y", F.col("probability").alias("p"))).first()
    assert all(getattr(one, c) == alone["fused"][c] for c in one.asDict())
    groups = labels.select("clip", F.when(F.col("y") == 1, F.concat(F.lit("g"), F.crc32(F.col("clip").cast("binary")) % 3)).otherwise("real").alias("group"))
    of_group = {r.clip: r.group for r in groups.collect()}
    for r in C.slice_aucs(held.scored, groups).collect():
        assert r.auc == pytest.approx(area({c: p for c, p in got.items() if not y[c] or of_group[c] == r.group}), abs=5.1e-4)


def test_transfer(spark):
    rows, found, labels = frames(spark)
    rows2, found2, labels2 = frames(spark, 40, 9)
    moved, terms = C.transfer((rows, found, labels), (rows2, found2, labels2))
    of = {r.clip: r.fold for r in C.dealt(labels).collect()}
    train, test = Plain(4, 80, of, lambda c: True), Plain(9, 40, {f"c{i}": i % 5 for i in range(40)}, lambda c: True)
    test.models, test.weights, test.bias = train.models, train.weights, train.bias
    assert all(math.isclose(r.probability, test.fused(r.clip), abs_tol=1e-4) for r in moved.collect())
    assert {r.expert for r in terms.select("expert").distinct().collect()} == {"good", "noise", "speaker", "container", "rare"}


def test_fits_are_the_same_together_and_alone(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 2, (90, 2)) + 3
    y = (x[:, 0] + rng.normal(0, 2, 90) > 4).astype(int)
    df = spark.createDataFrame([("m", i % 3, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "kind string, fold long, x array<double>, y int").repartition(3)
    models, n = C.fit_models(df, 0.3, {"all": ("m", frozenset()), "some": ("m", frozenset({1})), "none": ("other", frozenset())})
    assert n == {"all": 90, "some": 60} and set(models) == {"all", "some"}
    for name, part in (("all", np.arange(90)), ("some", np.flatnonzero(np.arange(90) % 3 != 1))):
        m = models[name]
        z = np.clip((x[part] - x[part].mean(0)) / x[part].std(0), -6, 6)
        coef, intercept = plain_fit(z, y[part].astype(float), 0.3)
        assert np.allclose(m.mean, x[part].mean(0)) and np.allclose(m.scale, x[part].std(0)) and np.allclose(m.coef, coef, atol=1e-6) and abs(m.intercept - intercept) < 1e-6
    assert C.fit_models(df.withColumn("y", F.lit(1)), 0.3, {"all": ("m", frozenset())})[0] == {}


def test_grouped_summary_is_that_of_each_group(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(2), round(rng.random(), n)) for g, n in (("ties", 1), ("fine", 4), ("inverted", 2)) for _ in range(70)] + [("single", 1, 0.5), ("single", 1, 0.2)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r for r in metrics.grouped_summary(df, "g", 0.3).collect()}
    for g in ("ties", "fine", "inverted"):
        want = metrics.summary(df.filter(F.col("g") == g), 0.3).first().asDict()
        assert {k: got[g][k] for k in want} == want
    assert got["single"].auc is None and got["single"].eer is None


def test_metrics_of_blocks_are_those_of_tables(spark, monkeypatch):
    """Blocks and ranges of a few clips each; scores that tie within a block and between blocks."""
    monkeypatch.setattr(blocks, "BLOCK", 5)
    monkeypatch.setattr(ranks, "STEP", 2)
    monkeypatch.setattr(ranks, "RANGE", 60)
    rows, found, labels = frames(spark, 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        held = C.held_out(rows, found, labels, ranked=False)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    experts = ["container", "good", "noise", "rare", "speaker"]
    plain = lambda df: {r.expert: r.asDict() for r in df.collect()}
    assert held.source.packed.count() > 15
    assert plain(held.source.expert_summaries(experts, 0.3)) == plain(C.expert_summaries(held.scored, held.terms, experts, 0.3))
    assert plain(held.source.omission_drops(experts)) == plain(C.omission_drops(held.scored, held.terms, experts))
    wide = {r.clip: r for r in held.source.wide(experts).collect()}
    for r in held.terms.collect():
        assert (wide[r.clip][f"{r.expert}_score"], wide[r.clip][f"{r.expert}_confidence"], wide[r.clip].without) == (r.score, r.confidence, r.without)


def test_rows_of_wide_and_long_features_are_the_same(spark):
    names = {"good": ("u", "v"), "speaker": ("v",)}
    wide = [("a", "good", 1.0, None, None), ("a", "good", 0.5, float("nan"), None), ("a", "good", None, 3.0, None), ("b", "good", None, float("inf"), None), ("b", "speaker", 1.0, 2.0, None), ("c", "speaker", None, 5.0, None), ("d", "good", None, None, 1.0), ("d", "other", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(wide, "clip string, expert string, u double, v double, w double")
    long = spark.createDataFrame([(c, e, f, v) for c, e, *own in wide for f, v in zip("uvw", own, strict=True)], "clip string, expert string, feature string, value double")
    backends = spark.createDataFrame([("b", "wavlm-xvector"), ("c", "mfcc-stats"), ("e", "wavlm-xvector")], "clip string, backend string")
    want = {("a", "good"): [1.0, 3.0], ("b", "speaker"): [2.0], ("d", "good"): [None, None]}
    for features in (df, long):
        assert {(r.clip, r.expert): r.x for r in C.expert_rows(features, names, backends).collect()} == want


def context(i):
    return (f"c{i}", 3.0 + i % 3, 2.5 if i % 5 else 0.5, i % 4 == 0, i % 6 == 0, i % 10 == 0, *(float(10 * k + 5) for k in range(7)), "no decoder" if i % 7 == 0 else None)


EXPERTS = ("container", "spectral", "compression", "prosody", "environment", "splice", "speaker")


def contexts(spark, n=80):
    kinds = "clip string, duration_s double, speech_s double, lossy boolean, banded boolean, flags boolean, " + ", ".join(f"{e}_ms double" for e in EXPERTS) + ", prosody_error string"
    return spark.createDataFrame([context(i) for i in range(n)], kinds)


def plain_route(i, weights, bias, order, score, prior=0.3):
    """(probability, [(expert, action, reason)]) step by step."""
    _, duration, speech, lossy, banded, flags, *_, error = context(i)
    total, trace = bias + math.log(prior / (1 - prior)), []

    def step(e, runs, why, why_not):
        nonlocal total
        if runs and e == "prosody" and error:
            trace.append((e, "error", error))
        elif runs:
            trace.append((e, "run", why))
            s, c = score.get(e, (None, None))
            total += weights.get(e, 0.0) * c * logit(s) if s is not None else 0.0
        else:
            trace.append((e, "skip", why_not))

    step("container", True, routing.REASONS["container"], "")
    step("spectral", True, routing.REASONS["spectral"], "")
    step("compression", lossy or banded, routing.REASONS["lossy" if lossy else "banded"], routing.REASONS["full band"])
    step("prosody", speech >= 1, f"{speech:.1f} s of speech available", f"only {speech:.1f} s of speech")
    step("environment", duration >= 2 or speech < duration - 0.3, routing.REASONS["environment"], routing.REASONS["short"])
    can = {"splice": (duration >= 1.5, "clip shorter than 1.5 s"), "speaker": (speech >= 2, f"{speech:.1f} s speech < 2.0 s"), "deep": (False, "no deep model configured")}
    for e in order:
        p = sigmoid(total)
        inside, forced = 0.35 < p < 0.95, flags and e == "splice"
        why = f"uncertain: P={p:.2f} inside (0.35, 0.95)" if inside else "metadata red flags"
        step(e, can[e][0] and (inside or forced), why, f"confident: P={p:.2f} outside (0.35, 0.95)" if can[e][0] else can[e][1])
    return sigmoid(total), trace


def named(terms):
    """Experts of the router for those of ``evidence``."""
    known = F.create_map(*(F.lit(x) for pair in (("good", "spectral"), ("noise", "prosody"), ("speaker", "speaker"), ("rare", "splice"), ("container", "container")) for x in pair))
    return terms.withColumn("expert", known[F.col("expert")])


def test_replay_uses_held_out_calibrations(spark):
    rows, found, labels = frames(spark)
    held = C.held_out(rows, found, labels)
    alias = {"good": "spectral", "noise": "prosody", "speaker": "speaker", "container": "container", "deep": "deep"}
    cal = held.calibration
    renamed = C.Calibration({}, {o: {alias[e]: w for e, w in own.items()} for o, own in cal.weights.items()}, cal.bias, {o: {alias[e]: a for e, a in own.items()} for o, own in cal.aucs.items()})
    # The second fold's calibration is told from the others by its order and bias.
    renamed.aucs["1"]["speaker"], renamed.aucs["2"]["speaker"], renamed.bias["1"] = 0.999, 0.5001, renamed.bias["1"] + 2
    moved = C.HeldOut(held.scored, named(held.terms), held.folds, renamed)
    routed, report = routing.replay_out_of_fold(contexts(spark), moved)
    scores, fold = {}, {r.clip: r.fold for r in held.folds.collect()}
    for r in moved.terms.collect():
        scores.setdefault(r.clip, {})[r.expert] = (r.score, r.confidence)
    got, actions = routed.collect(), set()
    assert len(got) == 80
    for r in got:
        o, own = str(fold[r.clip]), scores.get(r.clip, {})
        order = routing.escalation_order({e: a for e, a in renamed.aucs[o].items() if a == a})
        p, trace = plain_route(int(r.clip[1:]), renamed.weights[o], renamed.bias[o], order, own)
        assert [(s.expert, s.action, s.reason) for s in r.trace] == trace and math.isclose(r.probability, p, abs_tol=1e-9)
        whole = renamed.bias[o] + math.log(0.3 / 0.7) + sum(renamed.weights[o].get(e, 0) * c * logit(s) for e, (s, c) in own.items() if s is not None)
        assert math.isclose(r.full_probability, sigmoid(whole), abs_tol=1e-9)
        assert all((s.posterior_after is None) == (s.action != "run") and (s.ms is None) == (s.action != "run") for s in r.trace if s.expert != "deep")
        actions |= {s.action for s in r.trace}
    assert actions == {"run", "skip", "error"} and len({tuple(s.expert for s in r.trace) for r in got}) > 1
    modes = {r["mode"]: r for r in report.collect()}
    for mode, column in (("full", "full_probability"), ("routed", "probability")):
        want = metrics.summary(routed.select("y", F.col(column).alias("p"))).first().asDict()
        assert {k: modes[mode][k] for k in want} == want
    ran = [[s.expert for s in r.trace if s.action == "run"] for r in got]
    assert modes["full"].mean_experts_run == pytest.approx(np.mean([len(x) for x in ran]), abs=0.0051)
    spent = sum(10 * EXPERTS.index(e) + 5 for x in ran for e in x)
    assert modes["routed"].compute_share_vs_full == pytest.approx(spent / (80 * sum(10 * k + 5 for k in range(7))), abs=5.1e-4)
    assert not any("prosody" in r["reason"] and "decoder" in r["reason"] for r in routing.skip_reasons(routed).collect())
    with pytest.raises(ValueError, match="deep"):
        routing.replay_out_of_fold(contexts(spark), moved, deep="always")


def test_failed_container_and_deep(spark):
    base = {"clip": "c", "duration_s": 3.0, "speech_s": 3.0, "lossy": True, "banded": True, "flags": True, "spectral_score": 0.01, "spectral_confidence": 1.0}
    rows = spark.createDataFrame([base | {"container_error": "bad header", "spectral_error": None, "deep_error": "no weights"}, base | {"container_error": "bad header", "spectral_error": "too short", "deep_error": None}], "clip string, duration_s double, speech_s double, lossy boolean, banded boolean, flags boolean, spectral_score double, spectral_confidence double, container_error string, spectral_error string, deep_error string")
    one, two = ({s.expert: (s.action, s.reason) for s in r.trace} for r in routing.route(rows, {}, 0.0, 0.5).collect())
    assert one["container"] == ("error", "bad header") and one["compression"] == ("run", "band-limited: transcoding?") and one["splice"][0] == "skip"  # no flags without a header
    assert two["spectral"] == ("error", "too short") and two["compression"][0] == "skip" and two["splice"] == ("run", "uncertain: P=0.50 inside (0.35, 0.95)")
    failed, ran = routing.route(rows, {}, 0.0, 0.5, deep="always").collect()
    assert [(s.action, s.reason) for s in failed.trace if s.expert == "deep"] == [("error", "no weights"), ("skip", "confident: P=0.01 outside (0.35, 0.95)")]
    assert [(s.action, s.reason) for s in ran.trace if s.expert == "deep"] == [("run", "deep model set to always run"), ("skip", "already run")]
