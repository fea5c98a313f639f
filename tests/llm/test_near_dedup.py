import random
import re

from tessera.llm.components import components
from tessera.llm.near_dedup import near_duplicates

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute_force(docs, k, percent=80):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    label = {i: i for i in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def made_documents(seed, n=250):
    rng = random.Random(seed)
    docs = {0: None, 1: "", 2: " \n ", 3: "One two", 4: "one TWO", 5: "one two three", 6: "É a b c d e f", 7: "é a b c d e f"}
    word = lambda: f"w{rng.randrange(400)}"
    for i in range(10, 10 + n):
        if rng.random() < 0.6 and i > 20:
            words = docs[rng.randrange(10, i)].split()
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [word() for _ in range(rng.randrange(3))]
            docs[i] = "\t".join(words)
        else:
            docs[i] = " ".join(word() for _ in range(rng.randrange(3, 120)))
    return docs


def test_matches_brute_force(spark):
    for k, seed in ((4, 1), (5, 2)):
        docs = made_documents(seed)
        df = spark.createDataFrame([(i, t, 5) for i, t in docs.items()], "doc_id long, text string, n long").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=k).collect()}
        assert got == brute_force(docs, k)


def test_empty_table_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "z"), (4, "A b c D e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, None, False), (3, 1, 3, True), (4, 2, None, False)], key=str)


def test_string_ids_and_other_columns(spark):
    df = spark.createDataFrame([("b", "u v w x y z", 1), ("a", "U v w x y z", 2), ("c", "other", 3)], "doc_id string, text string, kept int")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True)}


def test_recall_of_links_near_the_threshold(spark):
    """Pairs of edited copies with similarities from 0.8 to 0.9: at least 0.99 of the links must be found."""
    rng, docs = random.Random(12), {}
    for pair in range(400):
        words = [f"p{pair}w{rng.randrange(10**6)}" for _ in range(120)]
        edited = list(words)
        for at in rng.sample(range(120), rng.randrange(1, 4)):
            edited[at] = f"e{rng.randrange(10**6)}"
        docs[2 * pair], docs[2 * pair + 1] = " ".join(words), " ".join(edited)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_duplicates(df, k=4).collect()}
    linked = [i for i in range(0, 800, 2) if 100 * len((a := shingles(docs[i], 4)) & (b := shingles(docs[i + 1], 4))) >= 80 * len(a | b)]
    assert len(linked) > 300 and sum(got[i + 1] == i for i in linked) >= 0.99 * len(linked)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i * 7) % 23) for i in range(23)] + [(500, 500)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {v for i, v in got.items() if i >= 100} >= {101}
