import random

import numpy as np

from tessera.llm.decontamination import GAP, MATCH, MISMATCH, align, clean_documents, contaminated


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1][j] + GAP, h[i][j - 1] + GAP)
            best = max(best, h[i][j])
    return best


def test_align_matches_brute_force():
    rng = random.Random(4)
    items, passages = [], []
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 20))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.5:
            b[len(b) // 2 : len(b) // 2] = a[: rng.randrange(len(a) + 1)]
        items.append(np.array(a, np.uint64) + np.uint64(10))
        passages.append(np.array(b, np.uint64) + np.uint64(10))
    for a, b, (score, first, end) in zip(items, passages, align(items, passages), strict=True):
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert score == smith_waterman(a.tolist(), b[first:end].tolist())


def made(seed=2):
    rng = random.Random(seed)
    common = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    prose = lambda n: [word() for _ in range(n)]
    items = {i: prose(rng.randrange(20, 60)) for i in range(12)}
    items[90] = prose(600)
    docs, truth = {1: None, 2: "", 3: "the of and to in " * 50}, set()
    for d in range(10, 200):
        text = prose(rng.randrange(5, 300))
        if d % 3 == 0:
            i = rng.choice(list(items))
            copy = list(items[i])
            for _ in range(len(copy) // 8 * (d % 2)):
                copy[rng.randrange(len(copy))] = word()
            if d % 4 == 0:
                del copy[3:5]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() + "," for w in copy]
            truth.add((d, i))
        docs[d] = " ".join(text)
    return docs, {i: " ".join(t) for i, t in items.items()}, truth


def test_finds_planted_copies_only(spark):
    docs, items, truth = made()
    items[91] = "two words"
    d = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([*items.items(), (None, "no id at all here"), (92, None)], "item_id long, text string")
    got = contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and all(0.5 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in clean_documents(d, b).collect()}
    assert kept == set(docs) - {x for x, _ in truth}


def test_empty_tables(spark):
    docs, items, _ = made()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert contaminated(d.limit(0), b).count() == 0
    assert contaminated(d, b.limit(0)).count() == 0


def test_long_items_leave_no_short_piece(spark):
    rng = random.Random(8)
    items = {n: [f"i{n}x{rng.randrange(10**6)}" for _ in range(n)] for n in (256, 257, 259, 270, 513)}
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    docs = {n: " ".join(filler(40) + w[-14:] + filler(40)) for n, w in items.items()}
    docs |= {1000 + n: " ".join(filler(40) + w + filler(40)) for n, w in items.items()}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1000 + n, n) for n in items}
    assert {r.doc_id for r in clean_documents(d, b).collect()} == set(items)
