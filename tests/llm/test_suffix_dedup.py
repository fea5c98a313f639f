import random

import numpy as np

from tessera.llm.suffix_dedup import equal_windows, merge_spans, remove_repeats


def brute_force(docs, threshold):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - threshold + 1):
            w = raw[s : s + threshold]
            if w in seen:
                gone[s : s + threshold] = b"\1" * threshold
            seen.add(w)
        runs = [p for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1])]
        out[i] = (len(raw), bytes(b for b, g in zip(raw, gone) if not g), len(runs))
    return out


def made_documents(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "été", "naïve", "ing", "zu", "a"]
    prose = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    docs = {1: None, 2: "", 3: "short", 4: "x" * 400, 5: "ab" * 300, 6: "x" * 99, 7: "x" * 100}
    for i in range(10, 10 + n):
        kind = rng.randrange(6)
        if kind == 0 and i > 20:
            docs[i] = docs[rng.randrange(10, i)]
        elif kind == 1 and i > 20:
            t = docs[rng.randrange(10, i)]
            at = rng.randrange(len(t) + 1)
            docs[i] = t[:at] + "EDIT" + t[at:]
        elif kind == 2:
            docs[i] = prose(10) + rng.choice(shared) + prose(10)
        elif kind == 3:
            docs[i] = shared[0][rng.randrange(50) :] + shared[1]
        else:
            docs[i] = prose(rng.randrange(1, 200))
    return docs


def result(spark, docs, threshold=100):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, spans string").repartition(3)
    return {r.doc_id: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in remove_repeats(df, threshold=threshold).collect()}


def test_matches_brute_force(spark):
    docs = made_documents(3)
    for threshold in (100, 37):
        assert result(spark, docs, threshold) == brute_force(docs, threshold)


def test_pieces_of_long_texts(spark, monkeypatch):
    from tessera.llm import suffix_dedup

    docs = made_documents(5, 30)
    docs[50] = " ".join(t for t in docs.values() if t)
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    texts = [(t or "").encode() for t in docs.values()]
    whole = suffix_dedup.Anchors(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 100)
    parts = sum(int(suffix_dedup.Anchors(d, o, 100).count.sum()) for d, o, _, _ in suffix_dedup._pieces(np.arange(len(texts)), texts, 100))
    assert parts == whole.count.sum()


def test_empty_table_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    text = "".join(chr(97 + i * i % 26) for i in range(50)) + "".join(map(str, range(60)))
    df = spark.createDataFrame([(None, text), (1, text), (1, "Z" + text), (2, text[:-1])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in remove_repeats(df).collect())
    first = {r[1]: r[2] for r in got if r[0] == 1}
    assert len(got) == 4 and got[0] == (0, len(text), len(text)) and got[-1] == (2, len(text) - 1, 0) and first == {len(text): 0, len(text) + 1: 1}


def test_equal_windows_and_spans():
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    assert (equal_windows(data, np.arange(100), 50) == np.arange(100) % 10).all()
    assert merge_spans(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])).tolist() == [[0, 4], [5, 12]]
