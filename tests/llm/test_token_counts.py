import random
import re

from tessera.llm.token_counts import TokenTree, apply_edits, disjoint, pattern_edits, segments, token_trees
from tessera.llm.token_ids import encoder, vocabulary_path


def count(text):
    return len(encoder(vocabulary_path()).encode(text)) // 4


def test_edits_match_a_new_count():
    rng = random.Random(8)
    alphabet = [" ", " ", "\n", "  ", "a", "bc", "the", "é", "'s", "12", ".", "word", "\t", "你"]
    made = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    for n in (0, 1, 5, 300, 2000):
        text = made(n)
        own = segments(text)
        assert "".join(own) == text
        tree = TokenTree.build([len(s) for s in own], [count(s) for s in own])
        assert tree.n_tokens == count(text)
        for _ in range(40):
            edits = disjoint([(rng.randrange(len(text) + 1), rng.choice([0, 1, 3, 40, 700]), made(rng.choice([0, 0, 1, 4, 60, 900]))) for _ in range(rng.choice([1, 1, 2, 6]))], len(text))
            plain = text
            for at, size, new in reversed(edits):
                plain = plain[:at] + new + plain[at + size :]
            text, encoded = tree.edit(text, edits, count)
            assert text == plain
            assert tree.n_tokens == count(text) and tree.nodes[1, 0] == len(text) and encoded <= len(text)


def test_small_edits_touch_little():
    text = "some words of a text " * 2000
    own = segments(text)
    tree = TokenTree.build([len(s) for s in own], [count(s) for s in own])
    _, encoded = tree.edit(text, [(20_000, 3, "new")], count)
    assert encoded < 1200


def test_tables(spark):
    docs = {1: None, 2: "", 3: "no digits", 4: "call 555-1234 or 999 999. " * 40, None: "id 12345 is null"}
    df = spark.createDataFrame([(i, t, 3) for i, t in docs.items()], "doc_id long, text string, n_tokens int").repartition(3)
    pattern = r"\d[\d -]*\d"
    out = apply_edits(token_trees(df), pattern_edits(df, pattern, "<N>")).collect()
    assert len(out) == len(docs)
    for r in out:
        text = docs[r.id] or ""
        after = re.sub(pattern, "<N>", text)
        after = after if r.id else text  # edits need an id
        assert (r.n_tokens_before, r.n_tokens, r.n_chars, r.n_edits) == (count(text), count(after), len(after), len(re.findall(pattern, text)) if r.id else 0)
    edits = spark.createDataFrame([(4, None, 1, "x"), (99, 0, 1, "x"), (3, 5, 9999, None), (None, 0, 1, "x")], "id long, at long, size long, new string")
    got = {r.id: (r.n_edits, r.n_tokens) for r in apply_edits(token_trees(df), edits).collect()}
    assert got[4][0] == 0 and got[3] == (1, count("no di")) and 99 not in got
    assert apply_edits(token_trees(df.limit(0)), edits).count() == 0


def test_overlapping_and_equal_edits_and_repeated_ids(spark):
    assert disjoint([(5, 3, "x"), (5, 3, "x"), (6, 1, "y"), (8, 0, "z"), (-2, 1, "a"), (99, 1, "b")], 10) == [(0, 1, "a"), (5, 3, "x"), (8, 0, "z"), (10, 0, "b")]
    df = spark.createDataFrame([("k", "tel 123456 now"), ("k", "no number"), ("k", "tel 123456 now"), ("m", "7654321")], "doc_id string, text string")
    rows = apply_edits(token_trees(df), pattern_edits(df, r"\d+", "<N>")).collect()
    assert sorted((r.id, r.n_edits, r.n_tokens) for r in rows) == sorted([("k", 1, count("tel <N> now"))] * 2 + [("k", 0, count("no number")), ("m", 1, count("<N>"))])


def test_leaves_split_as_they_grow():
    tree = TokenTree.build([0], [0])
    text = ""
    for _ in range(30):
        text, _ = tree.edit(text, [(len(text) // 2, 0, " some more words to count" * 20)], count)
    assert tree.n_tokens == count(text) and max(tree.leaves()[0]) < 1000
