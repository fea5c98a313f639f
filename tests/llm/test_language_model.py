import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import language_model as M
from tessera.llm import text_kernels as K

LOWER = {c: c + 32 for c in range(65, 91)}


def made(seed=5, n=400):
    rng = random.Random(seed)
    pools = [[f"{p}{i}" for i in range(50)] for p in ("en", "fr", "de")]
    docs = {1: None, 2: "", 3: "Unknown-word"}
    for i in range(10, 10 + n):
        pool = pools[i % 3]
        docs[i] = " ".join(rng.choice(pool) if rng.random() < 0.9 else f"Rare{rng.randrange(10**6)}" for _ in range(rng.randrange(120)))
    return docs


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def learned(i):
    return zlib.crc32(str(i).encode()) % 10 != 0


def test_base_scores_and_held_out_gain(spark):
    docs = made()
    df = spark.createDataFrame([(i, t, True) for i, t in docs.items()], "doc_id long, text string, train boolean").repartition(3)
    rows = M.score_texts(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0).collect()
    count = Counter(t for i, x in docs.items() if learned(i) for t in tokens(x))
    total, distinct = sum(count.values()), len(count)
    z = math.log10(total + 0.1 * (distinct + 1))
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r.doc_id])
        assert (r.training, r.n_tokens, r.n_known, r.train_tokens) == (learned(r.doc_id), len(own), sum(count[t] > 0 for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10(count[t] + 0.1) for t in own) - len(own) * z, rel_tol=1e-9, abs_tol=1e-6)
    held = [r for r in rows if not r.training and r.n_tokens > 30]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_rare_words_outside_the_dictionary(spark, monkeypatch):
    docs = made(9, 60)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    split = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    whole = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in M.score_texts(df, split).collect()}
    monkeypatch.setattr(M, "DICTIONARY", 20)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in M.score_texts(df, split).collect()} == whole


def test_probabilities_sum_to_one():
    words = [f"w{i}" for i in range(300)]
    h = np.sort(M.token_hashes(*next((d, o) for _, d, o in K.slices(pa.array([" ".join(words)]))))[0])
    d = M.Dictionary(h, np.arange(len(h)), np.full(len(h), 5.0), 5 * len(h), len(h))
    weights = M.Weights.unpack(M.start_weights(d) + np.random.default_rng(1).normal(0, 0.3, len(M.start_weights(d))).astype(np.float32))
    t = M.tokens(*next((x, o) for _, x, o in K.slices(pa.array(["w1 w2 w3"]))), d)
    place = 2
    total = 0.0
    for rank in [*range(M.MODELLED), M.MODELLED]:
        one = M.Tokens(t.hash[place : place + 1], t.doc[:1], t.place[:1], np.array([rank]), t.features[place : place + 1])
        total += 10 ** M.log_probabilities(one, weights)[0]
    assert abs(total - 1) < 1e-3


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "b a"), (2, "a c")], "doc_id long, text string")
    rows = M.score_texts(df, F.col("doc_id").isNotNull()).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=str) == sorted([(None, 3), (1, 2), (1, 3), (2, 3)], key=str)
    assert M.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_partitions_do_not_matter(spark):
    docs = made(7, 300)
    split = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    one, many = ({r.doc_id: r for r in M.score_texts(df.repartition(n, "doc_id"), split).collect()} for n in (1, 60))
    assert all(abs(one[i].score - many[i].score) < 1e-3 * one[i].n_tokens for i in docs)
    held = [r for r in many.values() if not r.training]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_ranks_follow_training_counts_only(spark, monkeypatch):
    monkeypatch.setattr(M, "DICTIONARY", 3)
    monkeypatch.setattr(M, "MODELLED", 2)
    kept = []
    monkeypatch.setattr(M, "start_weights", lambda d, own=M.start_weights: kept.append(d) or own(d))
    df = spark.createDataFrame([(1, "a a a b b"), (2, "held " * 50)], "doc_id long, text string")
    M.score_texts(df, F.col("doc_id") == 1).collect()
    assert sorted(kept[0].count.tolist()) == [1.0, 2.0, 3.0]


def test_table_grows_with_training_tokens():
    assert [M.row_bits(n) for n in (0, 10**6, 10**9, 10**10)] == [13, 13, 15, 17]


def test_held_out_texts_change_no_other_score(spark):
    docs = made(11, 150)
    split = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    score = lambda d: {r.doc_id: r for r in M.score_texts(spark.createDataFrame(list(d.items()), "doc_id long, text string").repartition(3, "doc_id"), split).collect()}
    changed = {i: t if learned(i) or i % 2 else "other words " * 70 for i, t in docs.items()}
    one, two = score(docs), score(changed)
    same = [i for i in docs if docs[i] == changed[i]]
    assert len(same) < len(docs) and all(abs(one[i].score - two[i].score) < 1e-4 * one[i].n_tokens and one[i].base_score == two[i].base_score for i in same)


def test_expected_counts_read_each_row_of_the_table_once(monkeypatch):
    rng = np.random.default_rng(4)
    flat = np.concatenate([rng.normal(0, 0.3, 2 * (M.WIDTH << M.ROW_BITS)), rng.normal(-3, 1, M.CLASSES * (M.WIDTH + 1))]).astype(np.float32)
    w, rows, of_class = M.Weights.unpack(flat), np.minimum(rng.zipf(1.3, (1500, 4)), 400) % 390, rng.integers(0, M.CLASSES - 1, 1500)
    for factor, small in ((1, True), (1000, False)):  # logits of some hundreds need their shift
        counts = M._Counts(flat * np.float32(factor), False)
        assert counts.w.small() == small
        for table, bias, own in ((counts.w.classes, counts.w.class_bias, None), (counts.w.words, counts.w.word_bias, of_class)):
            z = table[rows].sum(1).astype(float) + (bias if own is None else bias[own])
            p = np.exp(z - z.max(1, keepdims=True))
            plain = np.zeros(table.shape)
            for column in rows.T:
                np.add.at(plain, column, p / p.sum(1, keepdims=True))
            to, read, take = np.zeros(table.size, np.float32), [], np.take
            monkeypatch.setattr(np, "take", lambda a, i, *args, **more: (np.shares_memory(a, to) and read.append(len(i)), take(a, i, *args, **more))[1])  # noqa: B023
            counts._expect(to, table, bias, rows, own)
            monkeypatch.undo()
            assert len(read) == 4 and np.allclose(to.reshape(plain.shape), plain, rtol=1e-3 if small else 1e-2, atol=1e-3)


def test_equal_histories_are_computed_once(monkeypatch):
    rng = random.Random(3)
    sayings = [" ".join(rng.choice(("on", "off", "up", "Down", "x1", "x2")) for _ in range(30)) for _ in range(7)]
    texts = [rng.choice(sayings) for _ in range(300)]
    data, offsets = next((x, o) for _, x, o in K.slices(pa.array(texts)))
    h, n = np.unique(M.token_hashes(data, offsets)[0], return_counts=True)
    rank = np.where(n == n.min(), M.MODELLED, 60 + np.arange(len(h)))  # of two classes, and one word of the last one
    d = M.Dictionary(h, rank, n.astype(float), int(n.sum()), len(h), M._starts(h))
    start = M.start_weights(d)
    flat = start + np.random.default_rng(2).normal(0, 0.2, len(start)).astype(np.float32)
    w, t = M.Weights.unpack(flat), M.tokens(data, offsets, d)
    of_class = np.minimum(t.rank >> 6, M.CLASSES - 1)
    inner = of_class < M.CLASSES - 1
    plain = [np.zeros(w.classes.shape), np.zeros(w.words.shape)]
    rows = [M._class_rows(t.features, w.classes), M._word_rows(t.features[inner], of_class[inner], w.words)]
    for to, table, own, bias in zip(plain, (w.classes, w.words), rows, (w.class_bias, w.word_bias[of_class[inner]]), strict=True):
        p = np.exp(table[own].sum(1).astype(float) + bias)
        for column in own.T:
            np.add.at(to, column, p / p.sum(1, keepdims=True))
    powers, computed = M._powers, []
    monkeypatch.setattr(M, "_powers", lambda table, bias, rows, *more: (computed.append(len(rows)), powers(table, bias, rows, *more))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([True] * 300), pa.array(texts)], ["id", "train", "text"])
    for held in (1 << 21, 1000):
        monkeypatch.setattr(M, "HELD", held, raising=False)
        computed.clear()
        got = np.zeros(2 * w.classes.size)
        for part in M._observe(SimpleNamespace(value=tuple(d)), SimpleNamespace(value=flat), False)(iter([batch] * 4)):
            for i, x in zip(part.column("bucket").to_pylist(), part.column("pack").to_pylist(), strict=True):
                got[i * M.BLOCK : (i + 1) * M.BLOCK] += np.frombuffer(M.unpack_text(x), np.float32).reshape(2, -1)[1]
        assert np.allclose(got.reshape(2, *w.classes.shape), 4 * np.stack(plain), rtol=1e-3, atol=1e-3)
        histories = len(np.unique(t.features, axis=0))
        assert max(computed) <= 3 * histories and (held == 1000 or computed[0] == histories and len(computed) == 2)


def test_rows_of_wide_tables_are_sorted_with_their_places(monkeypatch):
    rng = np.random.default_rng(6)
    flat = np.concatenate([rng.normal(0, 0.3, 2 * (M.WIDTH << 17)), rng.normal(-3, 1, M.CLASSES * (M.WIDTH + 1))]).astype(np.float32)
    counts, rows, sort, wide = M._Counts(flat, False), np.minimum(rng.zipf(1.3, (900, 4)), 4000) * 32 + 7, np.argsort, []
    p = np.exp(counts.w.classes[rows].sum(1).astype(float) + counts.w.class_bias)
    plain = np.zeros(counts.w.classes.shape)
    for column in rows.T:
        np.add.at(plain, column, p / p.sum(1, keepdims=True))
    to = np.zeros(plain.size, np.float32)
    monkeypatch.setattr(np, "argsort", lambda x, *args, **more: (x.itemsize > 2 and wide.append(len(x)), sort(x, *args, **more))[1])
    counts._expect(to, counts.w.classes, counts.w.class_bias, rows)
    assert not wide and np.allclose(to.reshape(plain.shape), plain, rtol=1e-3, atol=1e-3)
