import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm import text_kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered)]


def test_statistics_match_plain_versions():
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "你", " ", " ", "\n", "\t", "#", "the", "cat", "\u00a0", "<"]
    texts = [None, "", "\n\n", "a a a a", "x y z x y z"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]
    got = []
    for _, data, offsets in K.slices(pa.array(texts), 400):
        _, out = quality.text_stats(data, offsets)
        got += np.stack(list(out.values()), 1).tolist()
    assert got == [plain(t) for t in texts]


def made(n=900):
    rng = random.Random(1)
    good, bad, toxic = [f"good{i}" for i in range(60)], [f"spam{i}" for i in range(60)], [f"vile{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        kind = i % 5
        pool = bad if kind == 0 else toxic if kind == 1 else good
        docs.append((i, " ".join(rng.choice(pool + good) + rng.choice([".", ""]) for _ in range(80)), "x"))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = made()
    d = spark.createDataFrame([*docs, (5000, None, "y"), (5001, "", "y"), (None, "few words", "y"), docs[2], docs[2]], "doc_id long, text string, kept_by string")
    model = quality.train_quality(d, spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int"))
    rows = quality.score_quality(d, model).collect()
    assert len(rows) == len(docs) + 5 and rows[0].kept_by
    right = [r.kept == (r.doc_id % 5 > 1) for r in rows if r.doc_id is not None and 600 <= r.doc_id < 5000]
    assert np.mean(right) > 0.97
    assert not any(r.kept for r in rows if r.doc_id is None or r.doc_id >= 5000)
    none = quality.train_quality(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.score_quality(d, none).count() == len(rows) and quality.score_quality(d.limit(0), model).count() == 0


def test_calibration_of_classes_far_apart():
    rng = np.random.default_rng(2)
    for gap in (1, 5, 20, 80):
        y = (np.arange(1200) % 7 == 0).astype(float)
        margin = np.where(y > 0, gap, -gap) + rng.normal(0, 2, len(y))
        slope, shift = quality._platt(margin, y)
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        assert slope > 0 and p[y > 0].mean() > p[y == 0].mean() and abs(p.mean() - y.mean()) < 0.02


@pytest.mark.parametrize(("sf", "low", "toxic"), [("sf0.01", 0.5, 0.45), ("sf0.1", 0.9, 0.85)])
def test_held_out_labels(spark, sf, low, toxic):
    """Fitted on one half of the labelled documents: the share of bad ones in the other half that go, and of good ones that stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    model = quality.train_quality(docs.select("doc_id", "text"), labels.filter(half == 0))
    rows = quality.score_quality(docs.select("doc_id", "text").join(labels.filter(half == 1), "doc_id"), model, with_text=False).collect()
    gone = lambda some: np.mean([not r.kept for r in some])
    assert gone([r for r in rows if r.quality == 0]) > low
    assert gone([r for r in rows if r.toxic == 1]) > toxic
    assert gone([r for r in rows if r.quality == 1 and r.toxic == 0 and not r.base_failed]) < 0.05


def test_character_runs_are_code_points():
    data, offsets = np.frombuffer("añb你x".encode() + b"yz", np.uint8), np.array([0, 8, 8, 10])
    got = [(data[a:b].tobytes().decode(), int(d)) for a, b, d in zip(*next(quality.character_runs(data, offsets, [3])))]
    assert got == [("añb", 0), ("ñb你", 0), ("b你x", 0)]
    assert [bytes(data[a:b]).decode() for a, b, _ in zip(*next(quality.character_runs(data, offsets, [2])))] == ["añ", "ñb", "b你", "你x", "yz"]


def test_training_leaves_no_memory_with_the_driver(spark):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024

    rng = random.Random(5)
    pools = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)] for _ in range(2)]
    docs = [(i, " ".join(rng.choices(pools[i % 2], k=400))) for i in range(2500)]
    d, tags = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, i % 2) for i in range(2500)], "doc_id long, quality int, toxic int")
    quality.train_quality(d, tags, rows=10)  # imports what it needs
    K.return_memory()
    before = held()
    for _ in range(2):
        quality.train_quality(d, tags)
    assert held() - before < 20
