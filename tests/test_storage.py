"""Manifests with coordinates, late reading, caches that grow, staged writes, the detector's parts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration as C
from tessera.operators import detector, learning, metrics, sampling
from tessera.plans import corpus
from tessera.sources import caches, corpora, readers, store
from tessera.sources.spectral import NAMES, SHORTCUTS, power_spectrogram
from tessera.streaming.drop_folder import analyse_folder
from tests.compare import compare, connection
from tests.test_operators import wav


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_coordinates_of_a_table_of_several_files(spark, tmp_path):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for i, name in enumerate(("a!c", "a b", "a+d", "a%20e")):
        found.filter(F.col("doc_id") % 4 == i).toPandas().to_parquet(tmp_path / "whole.parquet")
        (tmp_path / "documents.parquet").mkdir(exist_ok=True)
        (tmp_path / "whole.parquet").rename(tmp_path / "documents.parquet" / f"{name}.parquet")
    assert compare(spark, corpus.manifest_coordinates, corpus.SQL["manifest_coordinates"], connection(str(tmp_path)), str(tmp_path)) == ""


def test_manifests_with_coordinates(spark, tmp_path):
    rows = [(f"s{i % 3}", f"clip{i}", f"A{i % 4}", i % 2, {"bytes": wav([100 * i, -100 * i] * 400), "path": None}) for i in range(60)]
    kinds = "speaker_id string, audio_file_name string, system_id string, key int, audio struct<bytes:binary,path:string>"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(str(tmp_path / "ext" / "la19_train.parquet"))
    m = corpora.load_corpus(spark, "la19:train", str(tmp_path))
    assert m.columns == list(corpora.COLUMNS) and "audio" not in plan(m).split("ReadSchema")[1].split(">")[0].replace("audio_file_name", "")
    got = {r.uid: r for r in m.collect()}
    assert len(got) == 60 and all((got[n].speaker, got[n].label, got[n].system) == (s, k, "bonafide" if k == 0 else a) for s, n, a, k, _ in rows)
    assert len({(r.path, r.row) for r in got.values()}) == 60 and len({r.path for r in got.values()}) == 3
    one = corpora.read_clips(spark, m.filter("uid = 'clip7'")).collect()
    assert [(r.uid, r.rate) for r in one] == [("clip7", 16_000)] and np.allclose(one[0].samples[:2], [700 / 32768, -700 / 32768])
    assert {r.uid: len(r.samples) for r in corpora.read_clips(spark, m).collect()} == {f"clip{i}": 800 for i in range(60)}

    spark.createDataFrame([("p1", "a/b/p1_01.mic1.flac"), ("p2", "p2_02.flac")], "speaker_id string, file string").write.parquet(str(tmp_path / "ext" / "vctk_0.parquet"))
    assert {(r.uid, r.speaker, r.label, r.system, r.row >= 0) for r in corpora.load_corpus(spark, "vctk", str(tmp_path)).collect()} == {("p1_01.mic1", "p1", 0, "bonafide", True), ("p2_02", "p2", 0, "bonafide", True)}
    folder = tmp_path / "lj" / "resampled" / "gen" / "speaker_1"
    folder.mkdir(parents=True)
    (folder / "a.wav").write_bytes(wav([5, -5] * 100))
    (folder / "b.wav").write_bytes(b"broken")
    lj = corpora.load_corpus(spark, "lj", str(tmp_path))
    assert {(r.uid, r.speaker, r.system, r.label, r.row) for r in lj.collect()} == {(f"lj/gen/speaker_1/{n}.wav", "speaker_1", "bonafide", 0, -1) for n in "ab"}
    mixed = {r.uid: (r.samples is not None, r.error) for r in corpora.read_clips(spark, lj.unionByName(m.filter("uid = 'clip7'"))).collect()}
    assert mixed["lj/gen/speaker_1/a.wav"] == (True, None) and not mixed["lj/gen/speaker_1/b.wav"][0] and mixed["lj/gen/speaker_1/b.wav"][1] and mixed["clip7"][0]
    with pytest.raises(KeyError):
        corpora.load_corpus(spark, "la19", str(tmp_path))
    assert corpora.read_clips(spark, m.filter("uid = 'none'")).count() == 0


def test_staged_writes_keep_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(5), spark.range(9)
    assert store.staged(one, path) == 5 and store.staged(two, path) == 9 and spark.read.parquet(path).count() == 9

    def refuse(df):
        raise ValueError(f"{df.count()} rows")

    with pytest.raises(ValueError, match="5 rows"):
        store.staged(one, path, check=refuse)
    fails = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("in the middle"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="in the middle"):
        store.staged(fails, path)
    assert spark.read.parquet(path).count() == 9 and [p.name for p in tmp_path.iterdir()] == ["t"]
    good = spark.createDataFrame([("b.wav", 0.25), ("a.wav", 1.0)], "filename string, score double")
    assert readers.write_submission(good, str(tmp_path / "out")) == 2
    for bad in (good.withColumn("score", F.lit(1.5)), good.withColumn("filename", F.lit("a.wav"))):
        with pytest.raises(ValueError):
            readers.write_submission(bad, str(tmp_path / "out"))
    assert [(r.filename, r.score) for r in readers.read_scores(spark, str(tmp_path / "out")).orderBy("filename").collect()] == [("a.wav", 1.0), ("b.wav", 0.25)]


def test_feature_shards(spark, tmp_path):
    kinds = "uid string, ssl array<double>, spec array<double>, label int, system string, speaker string, source string, partition string"
    rows = lambda *uids: spark.createDataFrame([(u, [1.0], [2.0], 1, "s", "k", "c", "p") for u in uids], kinds)
    path = str(tmp_path / "f")
    read = lambda *names: sorted((r.uid, r.set) for r in caches.read_features(spark, path, "m", list(names)).collect())
    with pytest.raises(FileNotFoundError):
        read("train")
    assert caches.write_features(rows("a"), path, "m", "train", (0, 3)) == 1
    caches.write_features(rows("c", "d"), path, "m", "train", (2, 3))
    with pytest.raises(FileNotFoundError, match=r"\{3: \[1\]\}"):
        read("train")
    caches.write_features(rows("b"), path, "m", "train", (1, 3))
    assert read("train") == [(u, "train") for u in "abcd"]
    caches.write_features(rows("w"), path, "m", "train.v2")
    assert read("train", "train.v2") == [(u, "train") for u in "abcd"] + [("w", "train.v2")]
    caches.write_features(rows("x", "y"), path, "m", "train")
    assert read("train") == [("x", "train"), ("y", "train")]  # the whole set goes before its shards


FOUND = "path string, findings map<string,struct<score:double>>, trace array<struct<expert:string,action:string>>"


def test_findings_grow_by_versions(spark, tmp_path):
    source, cache, log = (tmp_path / n for n in ("in", "cache", "log"))
    source.mkdir()
    calls = spark.sparkContext.accumulator(0)

    def analyse(files):
        length = F.length("content").cast("double")
        made = files.select("path", F.create_map(F.lit("x"), F.struct(length.alias("score"))).alias("findings"), F.array(F.struct(F.lit("x").alias("expert"), F.lit("run").alias("action"))).alias("trace"))
        calls.add(files.count())
        return made

    def run(how=analyse):
        analyse_folder(spark, str(source), str(cache), str(log), how, FOUND).awaitTermination()
        return {r.path.rsplit("/", 1)[-1]: r.findings["x"].score for r in caches.cached_findings(spark, str(cache), FOUND).collect()}

    for n in "ab":
        (source / n).write_bytes(b"1" * (ord(n) - 90))
    assert run() == {"a": 7.0, "b": 8.0} and calls.value == 2
    assert run() == {"a": 7.0, "b": 8.0} and calls.value == 2 and caches.versions(spark, str(cache)) == [0]
    (source / "c").write_bytes(b"123")

    def stops(files):
        raise RuntimeError("stopped")

    with pytest.raises(Exception, match="stopped"):
        run(stops)
    assert caches.cached_findings(spark, str(cache), FOUND).count() == 2
    assert run()["c"] == 3.0 and calls.value == 3  # the stopped batch goes on

    # The same batch once more, as after a stop between its rows and the stream's log: nothing is added.
    files = spark.read.format("binaryFile").load(str(source)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    assert caches.add_findings(files, str(cache), analyse, FOUND) == 0 and caches.versions(spark, str(cache)) == [0, 1]
    # A later entry of a path wins; compaction keeps it alone.
    again = files.limit(1).select("path", F.create_map(F.lit("x"), F.struct(F.lit(99.0).alias("score"))).alias("findings"), F.array(F.struct(F.lit("x").alias("expert"), F.lit("skip").alias("action"))).alias("trace"))
    changed = again.first().path
    assert caches._next_version(spark, str(cache), again) == 1
    scores = lambda: {r.path: r.findings["x"].score for r in caches.cached_findings(spark, str(cache), FOUND).collect()}
    assert scores()[changed] == 99.0 and len(scores()) == 3
    before = scores()
    assert caches.compact_findings(spark, str(cache), FOUND) == 3 and caches.versions(spark, str(cache)) == [2] and scores() == before
    # One expert anew where it ran; a failure leaves the cache as it was.
    fresh = lambda rows: rows.select("path", F.struct((F.col("findings")["x"]["score"] + 1).alias("score")).alias("finding"))
    with pytest.raises(Exception, match="broken"):
        caches.refresh_cache(spark, str(cache), FOUND, "x", lambda rows: fresh(rows).withColumn("path", F.raise_error(F.lit("broken")).cast("string")))
    assert scores() == before
    assert caches.refresh_cache(spark, str(cache), FOUND, "x", fresh) == 2
    assert scores() == {p: v if p == changed else v + 1 for p, v in before.items()} and sorted(p.name for p in tmp_path.iterdir()) == ["cache", "in", "log"]


def test_calibration_files(spark, tmp_path):
    cal = C.Calibration({"|e": C.Model(np.array([1.0]), np.array([2.0]), np.array([0.5]), 0.25, np.array([3.0]), np.array([4.0])), "0|e": C.Model(np.zeros(1), np.ones(1), np.ones(1), 0.0)}, {"": {"e": 1.5, "container": 1.0}}, {"": -0.5}, {"": {"e": 0.75}})
    caches.write_calibration(spark, cal, str(tmp_path / "c"))
    got = caches.read_calibration(spark, str(tmp_path / "c"))
    assert got.weights == cal.weights and got.bias == cal.bias and got.aucs == cal.aucs and set(got.models) == set(cal.models) and got.models["0|e"].median is None
    assert [v.tolist() for v in (got.models["|e"].coef, got.models["|e"].median, got.models["|e"].spread)] == [[0.5], [3.0], [4.0]] and got.models["|e"].intercept == 0.25


def test_refreshed_findings(spark):
    cached = spark.createDataFrame([("a", {"x": (0.1,), "y": (0.2,)}, [("x", "run")]), ("b", {"x": (0.3,)}, [("x", "skip")]), ("c", {"y": (0.4,)}, [("x", "error")])], FOUND)
    again = spark.createDataFrame([(p, (0.9,)) for p in "abc"], "path string, finding struct<score:double>")
    out = {r.path: {k: v.score for k, v in r.findings.items()} for r in caches.refresh_findings(cached, "x", again).collect()}
    assert out == {"a": {"x": 0.9, "y": 0.2}, "b": {"x": 0.3}, "c": {"x": 0.9, "y": 0.4}}


def numbers(i, y, rng, cut):
    """99 numbers of which the shortcuts tell the class, and the others only if ``cut`` is false."""
    return [float(y * 10 + i % 3) if n in SHORTCUTS else rng.gauss(0.0 if cut else 0.8 * y, 1) for n in NAMES]


SMALL = {"maxIter": 6, "maxDepth": 3, "minInstancesPerNode": 5}


def test_trees_see_no_shortcut_and_explain_themselves(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", float(i % 2), 1.0, numbers(i, i % 2, rng, True)) for i in range(600)]
    df = spark.createDataFrame(rows, "clip string, y double, weight double, v array<double>").withColumn("spec", learning.dense("v")).cache()
    cut = learning.tree_head(df.filter("int(substring(clip, 2)) < 300"), "spec", names=NAMES, exclude=SHORTCUTS, **SMALL)
    scored = learning.log_odds(cut, df.filter("int(substring(clip, 2)) >= 300"), "p")
    area = metrics.auc(metrics.score_counts(scored.withColumn("y", F.col("y").cast("int")))).first().auc
    assert abs(area - 0.5) < 0.1
    seeing = learning.tree_head(df.filter("int(substring(clip, 2)) < 300"), "spec", **SMALL)
    assert metrics.auc(metrics.score_counts(learning.log_odds(seeing, df, "p").withColumn("y", F.col("y").cast("int")))).first().auc > 0.99

    for model in (cut, seeing):
        nodes = learning.tree_nodes(spark, model)
        used = {NAMES[r.feature] for r in nodes.filter("feature is not null").select("feature").distinct().collect()}
        assert (used & set(SHORTCUTS) == set()) == (model is cut)
        table = {(r.tree, r.node): r for r in nodes.collect()}
        got = {r.clip: r for r in learning.tree_contributions(df, "clip", "spec", nodes, 3).collect()}
        odds = {r.clip: 2 * r.raw for r in model.transform(df).select("clip", F.col("rawPrediction")).withColumn("raw", learning.vector_to_array("rawPrediction")[1]).collect()}
        assert len(got) == 600 and all(math.isclose(r.base + sum(r.contributions.values()), odds[c], abs_tol=1e-9) for c, r in got.items())
        for r in df.limit(20).collect():  # each tree walked by hand
            want = {}
            for t in {t for t, _ in table}:
                node = table[t, 0]
                while node.feature is not None:
                    child = table[t, node.left if r.v[node.feature] <= node.threshold else node.right]
                    want[node.feature] = want.get(node.feature, 0) + child.value - node.value
                    node = child
            assert got[r.clip].contributions == pytest.approx(want, abs=1e-9)


def test_linear_head_by_layers(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(float(i % 2), 1.0, [rng.gauss(i % 2 * (k == 1), 1) for k in range(6)]) for i in range(200)], "y double, weight double, v array<double>").withColumn("x", learning.dense("v"))
    model = learning.linear_head(df, "x")
    rows = learning.layer_shares(model, learning.log_odds(model, df, "odds"), "x", 3).collect()
    intercept = model.stages[1].intercept
    assert all(len(r.layer_contributions) == 3 and math.isclose(sum(r.layer_contributions) + intercept, r.odds, abs_tol=1e-9) for r in rows)


def test_detector_on_two_corpora(spark, tmp_path):
    rng = random.Random(1)
    corpora_of = ["la19", "lj", "diffssd"]
    rows = [(f"f{i}.wav", i % 2, f"sys{i % 6}", f"spk{i % 5}", corpora_of[i % 3 if i % 2 else i % 2], [rng.gauss(1.5 * (i % 2), 1) for _ in range(4)], numbers(i, i % 2, rng, False)) for i in range(160)]
    df = spark.createDataFrame(rows, "clip string, y int, system string, speaker string, source string, a array<double>, b array<double>")
    clips = df.select("clip", "y", "system", "speaker", "source", learning.dense("a").alias("ssl"), learning.dense("b").alias("spec"))
    seen = []
    real = learning.tree_head
    learning.tree_head = lambda some, *a, **k: seen.append({r.clip: r.weight for r in some.select("clip", "weight").collect()}) or real(some, *a, **k)
    try:
        fitted = detector.fit_detector(clips, **SMALL)
    finally:
        learning.tree_head = real
    want = {r.clip: r.weight for r in sampling.corpus_weights(clips.select("clip", "y", "system", "source")).collect()}
    assert max(seen, key=len) == pytest.approx(want) and len(seen) == 4 and all(w[c] == pytest.approx(want[c]) for w in seen for c in w)
    system = {r[0]: r[2] if r[1] else r[3] for r in rows}
    for part in (w for w in seen if len(w) < 160):  # whole systems and speakers are left out
        out = {(system[c], int(c[1:-4]) % 2) for c in want if c not in part}
        assert out and not any((system[c], int(c[1:-4]) % 2) in out for c in part)
    assert min(fitted.fusion.coefficients) >= 0 and 0 <= fitted.analyst <= 1
    scored = fitted.predict(clips)
    assert metrics.auc(metrics.score_counts(scored, "y", "probability")).first().auc > 0.85
    fitted.save(str(tmp_path / "d"))
    again = {r.clip: r.probability for r in detector.Detector.load(str(tmp_path / "d")).predict(clips).collect()}
    assert all(math.isclose(again[r.clip], r.probability, rel_tol=1e-9) for r in scored.collect())
    (tmp_path / "audio").mkdir()
    for name, content in (("f0.wav", wav([1000, -1000] * 4000)), ("f1.wav", b"broken"), ("new.wav", wav([5] * 9000)), ("f2.wav", wav([700, -700] * 97_000))):
        (tmp_path / "audio" / name).write_bytes(content)
    files = readers.audio_files(spark, str(tmp_path / "audio"), strict=True, content=True)
    learned = clips.select(F.col("clip").alias("filename"), "ssl")
    out = {r.filename: r for r in detector.score_audio(files, fitted, learned).collect()}
    assert out["f0.wav"].error is None and 0 < out["f0.wav"].score < 1 and (out["f0.wav"].duration_s, out["f0.wav"].truncated) == (0.5, False) and out["f2.wav"].truncated
    assert out["f1.wav"].error.startswith("only PCM") and out["f1.wav"].duration_s is None and out["new.wav"].error == "no learned features" and out["new.wav"].score == fitted.default_score
    assert detector.score_directory(spark, str(tmp_path / "audio"), fitted, learned, str(tmp_path / "scores")) == 4
    assert {r.filename: r.score for r in readers.read_scores(spark, str(tmp_path / "scores")).collect()} == {n: pytest.approx(r.score, abs=5.1e-7) for n, r in out.items()}


def test_power_spectrogram(spark):
    rng = np.random.default_rng(0)
    clips = {"a": rng.normal(0, 1, 1000), "short": rng.normal(0, 1, 511), "one": rng.normal(0, 1, 512)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()] + [("none", None)], "clip string, x array<double>")
    got = {(r.clip, r.frame): r.power for r in power_spectrogram(df, "clip", "x").collect()}
    assert set(got) == {("a", i) for i in range(4)} | {("one", 0)}
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 512) for i in range(512)]
    for (clip, i), power in got.items():
        want = np.abs(np.fft.rfft(clips[clip][160 * i : 160 * i + 512] * window) / sum(window)) ** 2 + 1e-14
        assert np.allclose(power, want, rtol=1e-9)
