import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import passage_quality as Q
from tessera.llm import queries
from tessera.llm import text_kernels as K

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def test_passages_are_cut_at_words():
    rng = random.Random(2)
    texts = ["", " \n ", "one", *[" ".join(rng.choice(["a", "é", "\n", "word"]) for _ in range(n)) for n in (63, 64, 65, 400, 1000)], ""]
    for _, data, offsets in K.slices(pa.array(texts), 500):
        p = Q.cut_passages(data, offsets)
        at = np.concatenate([[0], np.cumsum(p.count)])
        for d in range(len(offsets) - 1):
            raw = data[offsets[d] : offsets[d + 1]].tobytes()
            starts = [m.start() for m in WORD.finditer(raw)]
            want = [0] + starts[Q.PASSAGE :: Q.PASSAGE]
            assert (p.borders[at[d] : at[d + 1]] - offsets[d]).tolist() == want
        assert p.borders[-1] == len(data)
        assert all(p.borders[k] <= i < p.borders[k + 1] for i, k in enumerate(p.of_byte))


def test_encoding_against_plain_numbers():
    texts = ["The THE the!! 12 cat\nThe THE", "", "x " * 130, "éé a"]
    counts, rows = np.zeros((2, 1 << Q.BITS)), np.array([10, 30])
    [(_, data, offsets)] = K.slices(pa.array(texts))
    count, x = Q.encode(data, offsets, counts, rows)
    assert count.tolist() == [1, 1, 3, 1] and x.shape == (6, 24)
    raw = texts[0].encode()
    assert np.isclose(x[0, 0], np.log(8)) and np.isclose(x[0, 1], sum(65 <= b < 91 for b in raw) / len(raw)) and np.isclose(x[0, 3], 2 / len(raw)) and np.isclose(x[0, 8], 1 / len(raw))
    assert not x[1].any() and np.allclose(x[0, 12:15], [0, 1 / 7, 2 / 7]) and np.allclose(x[2, 12:15], [63 / 64, 63 / 64, 63 / 64])
    assert np.abs(x[:, 15:]).max() < 1e-6  # features that no row has are no evidence
    parts = Q.features(data, offsets, K.words(data, offsets))
    shapes = parts[1][1]
    assert shapes[0] == shapes[5] and shapes[1] == shapes[6] and len({shapes[0], shapes[1], shapes[2], shapes[3], shapes[4]}) == 5
    for _, feature in parts:
        counts[1][np.unique(feature)] += 1
    without = Q.encode(data, offsets, counts, rows, np.ones(4, np.int64))[1]
    assert np.abs(without[:, 15:]).max() < np.abs(Q.encode(data, offsets, counts, rows)[1][:, 15:]).max()


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    count, y = np.array([1, 4, 2, 6]), np.array([0.0, 1, 1, 0])
    x = rng.normal(size=(13, 5))
    shapes = [(5, 6), (6,), (6, 3), (3,), (6, 3), (3,), (3,), (6,), (1,)]
    weights = [rng.normal(size=s) for s in shapes]
    net = Q.Network(np.zeros(5), np.ones(5), *weights, 1.0, 0.0)

    def loss():
        m = net.run(x, count)[0]
        return float((np.logaddexp(0, m) - y * m).mean())

    for w, g in zip(weights, Q.gradients(net, x, count, y), strict=True):
        for i in np.ndindex(w.shape):
            was = w[i]
            w[i] = was + 1e-6
            up = loss()
            w[i] = was - 1e-6
            down = loss()
            w[i] = was
            assert np.isclose((up - down) / 2e-6, g[i], atol=1e-6)


def made(n=600):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "of", "stone", "river", "walked", "and", "house"]) + rng.choice(["", ",", "."]) for _ in range(400)]
        if i % 4 == 0:  # one bad passage among good ones
            words[200:250] = [rng.choice(["BUY!!", "win$$$", "CLICK##"]) for _ in range(50)]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 != 0)))
    return docs, labels


def test_held_out_accuracy_attention_and_odd_rows(spark):
    docs, labels = made()
    odd = [(5000, None, "y"), (5001, "", "y"), (None, "few words", "y"), docs[3], docs[3], (5002, "word " * 30_000, "y")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, n_passages_of string")
    tags = spark.createDataFrame([*labels[:400], (None, 1), (7, None), (99_999, 0), (1, 1)], "doc_id long, quality int")
    model = Q.train_passage_quality(d, tags)
    rows = Q.score_passage_quality(d, model).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    later = [r for r in rows if r.doc_id is not None and 400 <= r.doc_id < 5000]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in later]) > 0.97
    bad = [r for r in later if r.doc_id % 4 == 0]
    assert np.mean([r.top_passage == 3 for r in bad]) > 0.9 and all(r.n_passages == 7 for r in bad)
    assert {r.n_passages for r in rows if r.doc_id == 5002} == {469} and len({r.score for r in rows if r.doc_id == 3}) == 1
    with pytest.raises(ValueError, match="columns exist"):
        Q.score_passage_quality(d.withColumnRenamed("n_passages_of", "score"), model)
    assert Q.score_passage_quality(d.limit(0), model).count() == 0
    for labels_of, want in ((tags.limit(0), 0.5), (tags.filter("quality = 1"), 1.0)):
        assert np.allclose([r.score for r in Q.score_passage_quality(d, Q.train_passage_quality(d, labels_of)).limit(5).collect()], want)
    few = Q.train_passage_quality(d, tags, rows=50, most_bytes=100_000)
    assert 0 < few.rows.sum() <= 50


def test_held_out_labels(spark):
    """The query's own folds at sf0.1: labels of texts that it did not learn from."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op13_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    up, down = np.array([s for s, _, y in held if y]), np.array([s for s, _, y in held if not y])
    auc = (np.searchsorted(np.sort(down), up, "left") + np.searchsorted(np.sort(down), up, "right")).mean() / 2 / len(down)
    right = np.mean([p == y for _, p, y in held])
    print("held out", len(held), "auc", auc, "right", right, "low caught", np.mean(down < 0.3), "good lost", np.mean(up < 0.3))
    assert auc > 0.95 and right > 0.95
