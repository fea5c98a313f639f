import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import coverage, metrics, routing, running, sampling, sequence
from tessera.plans import evidence, surrogates
from tessera.sources import audio, readers
from tessera.streaming.drop_folder import route_folder


def scored(spark, y, p):
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, y int, p double")


def plain_dcf(y, p, prior, four_on_flags):
    y, p = np.array(y), np.array(p)
    a, b = (prior, 4 * (1 - prior)) if four_on_flags else (4 * prior, 1 - prior)
    return min(min((a * (p[y == 1] <= t).mean() + b * (p[y == 0] > t).mean()) / min(a, b) for t in [-np.inf, *p]), 1)


@pytest.mark.parametrize("prior", [0.3, 0.5, 0.8])
def test_costs_match_plain_enumeration(spark, prior):
    rng = random.Random(int(prior * 10))
    y = [int(rng.random() < 0.3) for _ in range(200)]
    p = [round(rng.random() + 0.5 * v, 2) for v in y]
    row = metrics.summary(scored(spark, y, p), prior).first()
    assert math.isclose(row.min_dcf_nsa, plain_dcf(y, p, prior, True), abs_tol=6e-5) and math.isclose(row.min_dcf_code, plain_dcf(y, p, prior, False), abs_tol=6e-5)
    full = metrics.detection_metrics(scored(spark, y, p), prior).first()
    assert math.isclose(full.min_dcf, plain_dcf(y, p, prior, True), abs_tol=1e-9)
    pairs = [(a > b) + 0.5 * (a == b) for a, v in zip(p, y) if v for b, w in zip(p, y) if not w]
    assert math.isclose(full.auc, np.mean(pairs), abs_tol=1e-9)


def test_perfect_inverted_and_constant_scores(spark):
    y = [0] * 70 + [1] * 30
    for p, cost in (([v * 0.9 for v in y], 0), ([1 - v for v in y], 1), ([0.5] * 100, 1)):
        assert metrics.detection_metrics(scored(spark, y, p)).first().min_dcf == cost


def test_running_sums_over_few_ranges(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(7)), rng.randrange(5)) for i in range(300)]
    got = running.running_sums(spark.createDataFrame(rows, "id long, x double, v long"), "x", [F.asc("id")], {"s": "v"}, 16).collect()
    total, want = 0, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        want[i] = total
    assert {r.id: r.s for r in got} == want


def test_running_sums_in_groups(spark):
    rng = random.Random(5)
    rows = [(i, f"g{rng.randrange(3)}", float(rng.randrange(9)), rng.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, x double, v long")
    got = {r.id: r.s for r in running.running_sums(df, "x", [F.asc("id")], {"s": "v"}, 5, ["g"]).collect()}
    assert got == {i: sum(v for j, h, y, v in rows if h == g and (y, j) <= (x, i)) for i, g, x, _ in rows}


def test_percentiles_match_numpy(spark):
    rng = random.Random(6)
    rows = [(f"g{i % 3}", rng.choice([None, round(rng.gauss(0, 3), 1)])) for i in range(400)] + [("one", 7.5), ("none", None)]
    points = {"p05": 0.05, "p50": 0.5, "p90": 0.9}
    got = {r.g: r for r in running.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", points, ["g"]).collect()}
    assert set(got) == {"g0", "g1", "g2", "one"}
    for g, r in got.items():
        own = [v for h, v in rows if h == g and v is not None]
        assert r.n == len(own) and all(math.isclose(r[k], np.quantile(own, q), abs_tol=1e-9) for k, q in points.items())


def test_curve_and_corners_agree_on_a_hot_score(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RUN", 7)
    rng = random.Random(3)
    y = [int(rng.random() < 0.4) for _ in range(150)]
    p = [0.5 if rng.random() < 0.6 else round(rng.random(), 2) for _ in y]
    df = scored(spark, y, p)
    order = sorted(range(150), key=lambda i: (p[i], -y[i]))
    n1, n0, ones, want = sum(y), 150 - sum(y), 0, [(0, 0.0, 1.0)]
    for k, i in enumerate(order, 1):
        ones += y[i]
        want.append((k, ones / n1, (n0 - (k - ones)) / n0))
    got = sorted((r["rank"], r.frr, r.far) for r in metrics.det_curve(df).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose(np.array(got), np.array(want))
    curve = metrics.det_curve(df)
    eer = curve.agg(metrics.eer_of(curve, "frr", "far", F.col("rank")).alias("e")).first().e
    assert math.isclose(metrics.detection_metrics(df).first().eer, eer) and metrics.det_corners(df).count() <= curve.count()


def test_priors_are_checked():
    for bad in (0, 1, -0.5, float("nan"), float("inf"), "x", None):
        with pytest.raises(ValueError):
            S.check_prior(bad)
    assert S.check_prior("0.25") == 0.25


def test_weights(spark):
    """Every class, and every group of a class, weighs the same, whatever the sizes."""
    rng = random.Random(9)
    rows = [(k, f"c{k}-{rng.randrange(4) if rng.random() < 0.8 else 4}") for k in [0] * 37 + [1] * 11 + [2] * 50]
    got = sampling.balanced_weights(spark.createDataFrame(rows, "y int, g string"), "y", "g").collect()
    by_class = {k: sum(r.weight for r in got if r.y == k) for k in (0, 1, 2)}
    by_group = {g: sum(r.weight for r in got if r.g == g) for _, g in rows}
    assert all(math.isclose(v, len(rows) / 3) for v in by_class.values())
    for k in by_class:
        own = [v for g, v in by_group.items() if g.startswith(f"c{k}-")]
        assert math.isclose(min(own), max(own))


def test_caps_are_repeatable(spark):
    rows = [(f"u{i}", i % 2 * (1 + 0), f"s{i % 3}") for i in range(60)] + [("t", -1, "z")]
    df = spark.createDataFrame(rows, "uid string, label int, system string")
    a = {r.uid for r in sampling.capped_sample(df, 5, 3, 1).collect()}
    assert a == {r.uid for r in sampling.capped_sample(df.repartition(7), 5, 3, 1).collect()} and "t" in a and len(a) == 5 + 9 + 1


def test_caps_take_the_first_of_large_groups(spark):
    df = spark.range(6000).select(F.concat(F.lit("u"), "id").alias("uid"), (F.col("id") % 2).cast("int").alias("label"), F.concat(F.lit("s"), (F.col("id") / 2).cast("long") % 3).alias("system"))
    import hashlib

    key = lambda u: hashlib.md5(f"{u}:4".encode()).hexdigest()
    want = set(sorted((f"u{i}" for i in range(0, 6000, 2)), key=key)[:20])
    for k in range(3):
        want |= set(sorted((f"u{i}" for i in range(1, 6000, 2) if i // 2 % 3 == k), key=key)[:7])
    assert {r.uid for r in sampling.capped_sample(df, 20, 7, 4).collect()} == want


def test_length_batches(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.randrange(100, 400)) for i in range(500)], "id long, n int")
    batches = {}
    for r in sampling.length_batches(df, "n", 16, 3).collect():
        batches.setdefault(r.batch, []).append(r.n)
    assert sum(map(len, batches.values())) == 500 and all(len(b) <= 16 and max(b) <= 1.05 * min(b) for b in batches.values())
    assert len(batches) < 120


def test_coverage_and_scores(spark):
    make = lambda names: spark.createDataFrame([(n,) for n in names], "filename string")
    coverage.require_coverage(make("ab"), make("ba"), "filename")
    for expected in ("a", "abc", "ac"):
        with pytest.raises(ValueError, match="coverage"):
            coverage.require_coverage(make("ab"), make(expected), "filename")
    a, b = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "f string, s double"), spark.createDataFrame([("b", 0.900001), ("a", 0.1)], "f string, s double")
    row = coverage.reproduction(a, b, "f", "s", 1e-5).first()
    assert math.isclose(row.max_difference, 1e-6, rel_tol=1e-6) and (row.different, row.beyond_tolerance) == (1, 0)


def test_tables_are_strict(spark, tmp_path):
    """Each fault is put by itself into a table that is read without it."""

    def write(lines):
        path = tmp_path / f"t{len(list(tmp_path.iterdir()))}.tsv"
        path.write_text("".join(f"{line}\n" for line in lines))
        return str(path)

    plain = ["cm-score\tfilename\tnote", "0.25\tx-7\t", "1\t0042\tfirst", "0\tnull\tlast"]
    good = readers.read_scores(spark, write(plain))
    assert {(r.filename, r.score) for r in good.collect()} == {("x-7", 0.25), ("0042", 1.0), ("null", 0.0)}
    cell = lambda row, column, text: [*plain[:row], "\t".join(text if i == column else c for i, c in enumerate(plain[row].split("\t"))), *plain[row + 1 :]]
    faults = [[], plain[:1], [*plain, plain[2]], [*plain, ""], [*plain, "0.5\tshort"], [line + "\tmore" if i == 3 else line for i, line in enumerate(plain)], [line.replace("\t", ";") for line in plain]]
    faults += [cell(0, 2, "filename"), cell(0, 1, "file")] + [cell(1, 1, n) for n in ("", " x-7", "x-7\u00a0", "0042")]
    faults += [cell(2, 0, v) for v in ("", "high", "NaN", "Infinity", "1.0000001", "-1e-9", "0x1")]
    for lines in faults:
        with pytest.raises(ValueError):
            readers.read_scores(spark, write(lines))
    key = ["note\tfilename\tcm-label", "a\tp\tspoof", "b\tq\tbonafide"]
    assert {(r.filename, r.y) for r in readers.read_key(spark, write(key)).collect()} == {("p", 1), ("q", 0)}
    for last in ("b\tq\tBonafide", "b\tq\t", "b\tp\tbonafide", "b\tq \tspoof"):
        with pytest.raises(ValueError):
            readers.read_key(spark, write([*key[:2], last]))
    assert {r.filename for r in readers.template_filenames(spark, write(["cm-score\tfilename", "?\tp", "\tq"])).collect()} == {"p", "q"}
    with pytest.raises(ValueError, match="duplicate"):
        readers.template_filenames(spark, write(["filename", "p", "p"]))
    readers.write_submission(good, str(tmp_path / "out"))
    assert {(r.filename, r.score) for r in readers.read_scores(spark, str(tmp_path / "out")).collect()} == {("x-7", 0.25), ("0042", 1.0), ("null", 0.0)}


def test_protocols_and_variants(spark, tmp_path):
    (tmp_path / "p.txt").write_text("LA_1 u1 - A07 spoof\nLA_2  u2 - - bonafide\n")
    protocol = readers.read_protocol(spark, str(tmp_path / "p.txt"))
    assert {tuple(r) for r in protocol.collect()} == {("u1", "LA_1", "A07", 1), ("u2", "LA_2", "-", 0)}
    clips = spark.createDataFrame([("u2", 3)], "uid string, n int")
    assert [(r.uid, r.attack, r.label) for r in readers.join_protocol(clips, protocol).collect()] == [("u2", "-", 0)]
    with pytest.raises(ValueError, match="u9"):
        readers.join_protocol(spark.createDataFrame([("u9", 1)], "uid string, n int"), protocol)
    assert readers.dataset_variant("la_trim_channel", ["la"]) == ("la", True, True) and readers.dataset_variant("la_channel", ["la"]) == ("la", True, False) and readers.dataset_variant("la", ["la"]) == ("la", False, False)
    for unknown in ("lb", "la_trim", "_channel"):
        with pytest.raises(KeyError):
            readers.dataset_variant(unknown, ["la"])


def test_findings_cache_keeps_the_last(spark, tmp_path):
    found = '{"container": {"expert": "container", "score": %s}}'
    rows = ['{"path": "a", "at": "2024-01-02T00:00:00", "duration": 2.0, "findings": %s}' % (found % 0.2), '{"path": "a", "at": "2024-01-03T00:00:00", "duration": 2.0, "findings": %s}' % (found % 0.9)]
    rows += ['{"path": "b", "duration": 0.5, "findings": %s}' % (found % 0.4), '{"path": "c", "duration": 3.0, "error": "x"}']
    (tmp_path / "f.json").write_text("\n".join(rows))
    assert [(r.path, r.findings["container"].score) for r in readers.read_findings(spark, str(tmp_path / "f.json"), 1.0).collect()] == [("a", 0.9)]


def wav(samples, rate=16000):
    data = struct.pack(f"<{len(samples)}h", *samples)
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def test_audio_files(spark, tmp_path):
    tone = (0.5 * 32767 * np.sin(2 * np.pi * 440 * np.arange(25600) / 22050)).astype(int).tolist()
    (tmp_path / "gen" / "speaker_1").mkdir(parents=True)
    (tmp_path / "gen" / "speaker_1" / "a.wav").write_bytes(wav(tone, 22050))
    (tmp_path / "b.WAV").write_bytes(wav([0] * 16000)[:-10])
    (tmp_path / "c.wav").write_bytes(b"nothing")
    (tmp_path / ".hidden.wav").write_bytes(wav([1]))
    (tmp_path / "notes.txt").write_text("x")
    files = readers.audio_files(spark, str(tmp_path), strict=True, content=True)
    assert {r.name for r in files.select("name").collect()} == {"a.wav", "b.WAV", "c.wav"}
    facts = {r.path.rsplit("/", 1)[1]: r for r in audio.headers(files).collect()}
    codes = lambda name: [i.code for i in facts[name].issues]
    assert codes("a.wav") == [] and facts["a.wav"].n_samples == 25600 and codes("c.wav") == ["not_wave"]
    assert codes("b.WAV") == ["riff_size", "data_cut"] and facts["b.WAV"].n_samples == 16000 - 5
    found = {r.path.rsplit("/", 1)[1]: r for r in audio.profiles(files).collect()}
    assert math.isclose(found["a.wav"].rms_dbfs, 20 * math.log10(0.5 / math.sqrt(2)), abs_tol=0.1) and math.isclose(found["a.wav"].duration_s, 25600 / 22050, abs_tol=1e-3) and found["c.wav"].error
    total = {r.measure: r for r in audio.profile_summary(audio.profiles(files)).collect()}
    assert total["peak"].n_files == 3 and total["peak"].n_errors == 1 and total["peak"].p95 == found["a.wav"].peak
    readers.write_profiles(audio.profiles(files), str(tmp_path / ".out"))
    assert {r.grid for r in audio.survey(files).collect()} >= {"22050/256"}
    (tmp_path / "gen" / "c.wav").write_bytes(b"x")
    with pytest.raises(ValueError, match="duplicate"):
        readers.audio_files(spark, str(tmp_path), strict=True)


def test_null_findings(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "id int, z double")
    assert [r[0] for r in df.orderBy("id").select(S.sigmoid(F.col("z"))).collect()][0] is None
    assert [r[0] for r in df.orderBy("id").select(S.logit(F.col("z"))).collect()] == [None, 0.0]


def test_runs_at_edges(spark):
    rows = [("c", i, b) for i, b in enumerate([True, True, False, True, False, False, True])]
    got = sequence.runs(spark.createDataFrame(rows, "clip string, i int, b boolean"), "clip", "i", "b").collect()
    assert {(r.first, r.end) for r in got} == {(0, 2), (3, 4), (6, 7)}


def test_escalation_order():
    assert routing.escalation_order(surrogates.AUCS) == ["deep", "splice", "speaker"]


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = evidence._route_input(spark, sf)
    rows.write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    route_folder(spark, schema, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), surrogates.WEIGHTS, surrogates.BIAS, expert_auc=surrogates.AUCS).awaitTermination()
    got = {(r.clip, round(r.probability, 9)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.clip, round(r.probability, 9)) for r in evidence._routed(spark, sf).collect()}


def test_header_faults():
    good = wav([1, -2, 3, 4])
    codes = lambda raw: [c for c, _, _ in audio.read_header(raw)["issues"]]
    at = good.index(b"fmt ") + 8
    patched = lambda offset, value: good[:offset] + value + good[offset + len(value) :]
    assert codes(good) == [] and codes(patched(0, b"RF64")) == [] and codes(b"") == ["not_wave"]
    assert codes(patched(at + 12, struct.pack("<H", 3))) == ["block_align", "byte_rate"]
    assert codes(patched(at + 8, struct.pack("<I", 5))) == ["byte_rate"]
    assert codes(good + b"xyz") == ["riff_size", "trailing_bytes"] and codes(good + b"\0" * 3) == ["riff_size"]
    assert codes(good[: good.index(b"data")]) == ["riff_size", "missing_chunk"]
    odd = b"RIFF" + struct.pack("<I", len(good) + 4) + good[8:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + good[12:]
    assert audio.read_header(odd)["chunks"] == ["LIST", "fmt ", "data"] and audio.read_header(odd)["n_samples"] == 4 and codes(odd) == []


def test_resampling_keeps_a_tone():
    for rate in (8000, 22050, 24000, 44100):
        x = 0.4 * np.sin(2 * np.pi * 700 * np.arange(rate) / rate)
        y = audio.resample(x, rate)
        want = 0.4 * np.sin(2 * np.pi * 700 * np.arange(16000) / 16000)
        assert len(y) == 16000 and np.abs(y - want)[400:-400].max() < 2e-3
    high = np.sin(2 * np.pi * 11000 * np.arange(44100) / 44100)
    assert np.abs(audio.resample(high, 44100)[400:-400]).max() < 0.01


def test_profile_against_its_definition():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.2, 16000), rng.normal(0, 0.002, 16000)])
    got = audio.profile(x)
    power = np.array([(x[a : a + 400] ** 2).mean() for a in range(0, len(x) - 399, 160)]) + 1e-14
    level = 10 * np.log10(power)
    quiet = power[level <= np.percentile(level, 20)].mean()
    assert math.isclose(got["snr_db"], 10 * math.log10((power.mean() - quiet) / quiet), rel_tol=1e-9) and math.isclose(got["noise_floor_dbfs"], 10 * math.log10(quiet), rel_tol=1e-9)
    window, total, n = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048), 0.0, 0
    for a in range(0, len(x) - 2047, 1024):
        part = x[a : a + 2048]
        total, n = total + np.abs(np.fft.rfft((part - part.mean()) * window)) ** 2, n + 1
    f, psd = np.arange(1025) * 16000 / 2048, total / n
    db = lambda low, high: 10 * math.log10(psd[(f > low) & (f < high)].mean())
    assert math.isclose(got["top_band_db"], db(7700, 7950) - db(6000, 7000), abs_tol=1e-6) and got["rolloff_10db_hz"] == 8000 and abs(got["rumble_db"]) < 3


def test_spectral_vectors(spark):
    from tessera.sources.spectral import NAMES, spectral_vectors

    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.1, 9000) * np.repeat([1, 0.001, 0.5], 3000) + 0.01
    clips = {"zeros": np.zeros(100), "silence": np.zeros(16000), "three": np.ones(3), "nan": np.full(900, np.nan), "empty": np.zeros(0), "tone": 0.3 * np.sin(2 * np.pi * 2500 * np.arange(32000) / 16000), "noise": x}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in clips.items()] + [("none", None)], "clip string, x array<double>").repartition(3)
    made = {r.clip: r.spec for r in spectral_vectors(df, "clip", "x").collect()}
    assert len(NAMES) == len(set(NAMES)) == 99 and made.pop("none") is None and set(made) == set(clips)
    assert all(len(v) == 99 and np.isfinite(v).all() for v in made.values())
    tone = dict(zip(NAMES, made["tone"]))
    assert tone["duration_s"] == 2 and abs(tone["centroid_mean"] - 2500) < 60 and tone["band_2000_3000_mean"] > -0.1 and abs(tone["crest_factor_db"] - 3.01) < 0.01

    # All numbers once more, frame by frame.
    got = dict(zip(NAMES, made["noise"]))
    padded = np.append(x, np.zeros(-(len(x) - 512) % 160))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 512) for i in range(512)]
    power = [[abs(v / 256) ** 2 + 1e-12 for v in np.fft.rfft(padded[a : a + 512] * window)] for a in range(0, len(padded) - 511, 160)]
    level = [10 * math.log10(sum(p)) for p in power]
    loud = np.percentile(level, 95)
    active = [v > loud - 30 for v in level]
    frames = [p for p, a in zip(power, active) if a]
    hz = [31.25 * i for i in range(257)]
    edges = [256 * i / 41 for i in range(42)]
    cepstra = []
    for p in frames:
        bank = [math.log(sum(v * max(0, min((b - edges[j]) / (edges[j + 1] - edges[j]), (edges[j + 2] - b) / (edges[j + 2] - edges[j + 1]))) for b, v in enumerate(p)) + 1e-12) for j in range(40)]
        cepstra.append([sum(v * math.cos(math.pi * k * (2 * j + 1) / 80) for j, v in enumerate(bank)) * math.sqrt((1 if k == 0 else 2) / 40) for k in range(20)])
    want = {}
    for k in range(20):
        own = [c[k] for c in cepstra]
        want |= {f"lfcc{k}_mean": np.mean(own), f"lfcc{k}_std": np.std(own), f"dlfcc{k}_std": np.std(np.diff(own))}
    for name in NAMES:
        if name.startswith("band_"):
            _, low, high, stat = name.split("_")
            own = [10 * math.log10(sum(v for v, h in zip(p, hz) if int(low) <= h < int(high)) / sum(p)) for p in frames]
            want[name] = np.mean(own) if stat == "mean" else np.std(own)
    flat = lambda p: math.exp(np.mean(np.log(p))) / np.mean(p)
    centroid = [sum(h * v for h, v in zip(hz, p)) / sum(p) for p in frames]
    crossing = [float(np.sign(x[i + 1]) != np.sign(x[i])) for i in range(len(x) - 1)]
    zcr = [np.mean(crossing[a : a + 160]) for a in range(0, len(crossing) - 159, 160)]
    flux = [math.sqrt(np.mean((np.log(b) - np.log(a)) ** 2)) for a, b in zip(power, power[1:])]
    both = {"flatness": [flat(p) for p in frames], "centroid": centroid, "zcr": zcr, "spectral_flux": flux}
    want |= {f"{k}_mean": np.mean(v) for k, v in both.items()} | {f"{k}_std": np.std(v) for k, v in both.items()}
    want |= {
        "hi_flatness_mean": np.mean([flat([v for v, h in zip(p, hz) if 4000 < h < 7000]) for p in frames]), "rolloff95_mean": np.mean([next(h for i, h in enumerate(hz) if sum(p[: i + 1]) / sum(p) > 0.95) for p in frames]),
        "energy_range_db": loud - np.percentile(level, 5), "pause_ratio": 1 - np.mean(active), "lead_silence_s": active.index(True) / 100, "trail_silence_s": active[::-1].index(True) / 100, "frame_energy_std": np.std(level),
        "dc_offset": np.mean(x), "crest_factor_db": 20 * math.log10(max(abs(x)) / math.sqrt(np.mean(x**2))), "clip_ratio": np.mean(abs(x) > 0.999), "duration_s": len(x) / 16000,
    }
    assert set(want) == set(NAMES)
    for name in NAMES:
        assert math.isclose(got[name], want[name], rel_tol=1e-3, abs_tol=1e-4), name


def test_spaced_windows(spark):
    got = {r.n: r.w for r in spark.createDataFrame([(n,) for n in (10, 64_600, 64_601, 200_000, 1_920_000, 1_920_001)], "n long").select("n", S.spaced_windows(F.col("n")).alias("w")).collect()}
    assert got == {10: [0], 64_600: [0], 64_601: [0, 1], 200_000: [0, 67_700, 135_400], 1_920_000: [0, 927_700, 1_855_400], 1_920_001: None}


def test_wording_and_tools(spark):
    from tessera.functions.wording import describe_feature, synth_tools

    names = {"dlfcc3_std": "frame-to-frame jitter of cepstral coefficient 3 (spectral envelope detail)", "band_150_500_std": "variability of energy in the 150-500 Hz band", "clip_ratio": "fraction of clipped samples", "lfcc0_std": "variation over time of cepstral coefficient 0 (spectral envelope detail)", "other": "other"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.d for r in df.select("n", describe_feature(F.col("n")).alias("d")).collect()} == names
    tags = spark.createDataFrame([(1, {"Encoder": "my Tacotron2", "FileName": "bark.wav"}), (2, {"Comment": "embark tts"}), (3, {}), (4, None)], "id int, tags map<string,string>")
    assert {r.id: r.t for r in tags.select("id", synth_tools(F.col("tags")).alias("t")).collect()} == {1: ["tacotron"], 2: [], 3: [], 4: []}


def clip_row(**changes):
    row = {"clip": "c", "duration_s": 5.0, "speech_s": 3.04, "lossy": False, "banded": False, "flags": False}
    row |= {f"{e}_score": 0.5 for e in ("container", *surrogates.EXPERTS)} | {f"{e}_confidence": 1.0 for e in ("container", *surrogates.EXPERTS)}
    return row | changes


def routed(spark, policy="routed", deep="never", **changes):
    df = spark.createDataFrame([clip_row(**changes)])
    r = routing.route(df, {}, 0.0, 0.5, surrogates.AUCS, deep, policy).first()
    return r, {s.expert: (s.action, s.reason, s.posterior_after) for s in r.trace}


def test_routing_policies(spark):
    r, t = routed(spark)
    assert [s.expert for s in r.trace] == ["container", "spectral", "compression", "prosody", "environment", "deep", "splice", "speaker"]
    assert t["prosody"][:2] == ("run", "3.0 s of speech available") and t["compression"] == ("skip", "full-band PCM, no transcoding suspicion", None) and t["deep"][:2] == ("skip", "no deep model configured")
    assert t["splice"] == ("run", "uncertain: P=0.50 inside (0.35, 0.95)", 0.5)
    _, t = routed(spark, spectral_score=0.01, splice_score=0.9, flags=True)
    assert t["spectral"][2] == 0.01 and t["splice"][:2] == ("run", "metadata red flags") and t["speaker"][:2] == ("skip", "confident: P=0.08 outside (0.35, 0.95)")
    _, t = routed(spark, speech_s=0.5, duration_s=1.0, lossy=True)
    assert t["prosody"][:2] == ("skip", "only 0.5 s of speech") and t["splice"][1] == "clip shorter than 1.5 s" and t["speaker"][1] == "0.5 s speech < 2.0 s" and t["compression"][1] == "lossy codec in container" and t["environment"][0] == "run"
    r, t = routed(spark, "full", "uncertain", spectral_score=0.01)
    assert all(a == "run" for a, _, _ in (t[e] for e in ("compression", "splice", "speaker"))) and t["compression"][1] == "full"
    assert [(s.action, s.reason) for s in r.trace if s.expert == "deep"] == [("run", "deep model set to always run"), ("skip", "already run")]
    _, t = routed(spark, deep="always", spectral_score=0.01)
    assert t["splice"][0] == "skip" and t["deep"][1] == "already run"
    _, t = routed(spark, deep="uncertain")
    assert t["deep"][0] == "run"
    with pytest.raises(ValueError):
        routed(spark, "fast")
    df = spark.createDataFrame([clip_row(clip=f"c{i}", y=i % 2, spectral_score=0.2 + 0.6 * (i % 2), splice_score=0.5) for i in range(20)])
    modes = {r["mode"]: r.auc for r in routing.replay(df, {}, 0.0, expert_auc=surrogates.AUCS).collect()}
    assert modes == {"full": 1.0, "routed": 1.0}


def test_whole_queries_keep_every_clip(spark):
    from tessera.plans import registry
    from tessera.plans import surrogates as T

    sf, q = "/root/testdata/sf0.001", registry.queries()
    ids = lambda name: {r[0] for r in T.table(spark, sf, name).select("doc_id").collect()}
    assert {r.doc_id for r in q["set_difference"](spark, sf).collect()} == ids("documents") - ids("labels")
    clips = lambda df: {(r.clip, r.expert) for r in df.select("clip", "expert").distinct().collect()}
    assert clips(q["report_json"](spark, sf)) == clips(T.features(spark, sf))
