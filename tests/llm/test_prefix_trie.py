import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import prefix_trie, queries
from tests.compare import compare, connection


def rebuilt(rows, group=5, most=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}:{t}".encode()).hexdigest()
    own = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: (y[0] is not None, y[0] or 0, digest(y[1], y[2])))] for c, x in own.items()}
    share = {c: zlib.crc32(str(c).encode()) % most for c in own}
    head = lambda c: c - (abs(c) % group) * (1 if c > 0 else -1)
    return {c: own.get(head(c), [])[: share[c]] + own[c][share[c] :] for c in own}


def plain(convs):
    """Every node with its sums, from all prefixes of all conversations."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    childs = {}
    for n in members:
        if n:
            childs.setdefault(n[:-1], []).append(n)
    leaves, spared = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in childs.get(n, [])) or 1
        spared[n] = sum(spared[k] for k in childs.get(n, [])) + (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
    ends = lambda n: ",".join(str(c) for c in sorted(members[n]) if len(convs[c]) == len(n))
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(childs.get(n, [])), leaves[n], spared[n], hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items()),
        key=repr,
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(conversations):
    out = prefix_trie.prefix_trie(*prefix_trie.branched(prefix_trie.ordered_turns(conversations)))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_all_prefixes(spark):
    rng = random.Random(5)
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "é", "", None, "long text"])) for c in [*range(-7, 60), 903] for t in range(rng.choice([1, 2, 5, 12]))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(rng.choice([6, 11]))]  # copies
    rows += [(70, 3, "bot", "tied"), (70, 3, "user", "tied"), (70, 3, "bot", "tied"), *rows[:9], (None, 0, "user", "no id"), (None, None, None, None)]
    rows += [(81, t, "user", "again and again") for t in range(1300)] + [(83, t, "user", "again and again" if t < 1200 else "else") for t in range(1300)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"node": F.lit(1), "pos": F.lit("x"), "part": F.lit(2), "digest": F.lit(None).cast("string")})
    assert trie(made.repartition(5)) == plain(rebuilt(rows))


def test_empty_and_turnless(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert trie(spark.createDataFrame([], kinds)) == []
    assert trie(spark.createDataFrame([(None, 1, "user", "x")], kinds)) == []
    rows = [(c, 0, "user", "x" * 50_000) for c in range(5, 40) if c % 5]  # no conversation to begin from: those with a share have no turn
    want = plain(rebuilt(rows))
    assert trie(spark.createDataFrame(rows, kinds)) == want and max(w[3] for w in want) > 20


def test_long_lists_of_ids_are_hashed_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 20)
    ends = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("node"), F.col("id").alias("conv_id"))
    want = hashlib.sha256(",".join(str(i) for i in range(0, 1000, 3)).encode()).hexdigest()
    got = {bytes(r.node): r.ends_sha256 for r in prefix_trie._ends(ends).collect()}
    assert got[b"hot"] == want and got[b"7"] == hashlib.sha256(b"7").hexdigest() and len(got) == 667


def test_query_matches_sql(spark):
    assert compare(spark, queries.op11_prefix_trie, queries.TRIE_SQL, connection()) == ""
