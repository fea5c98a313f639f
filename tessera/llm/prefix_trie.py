"""The trie of conversations that share their first turns, with sums over subtrees by pointer jumping.

A node is a distinct sequence of first turns, named by a digest; the root is the empty sequence.
Its parent is the sequence without the last turn. Sums over subtrees take one round for each
doubling of the depth: in a round, nodes add what they have gathered to the ancestor that they
point at, and then point at that ancestor's ancestor, so that the distance doubles.

No step holds a conversation or a node's members in one task. Turns are put in order by ranges, which
split a long conversation; digests of sequences are made from blocks of ``BLOCK`` turns, these from
blocks of blocks, and so on; members are counted with partial results, and their ids are
hashed as a stream of ready-made stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import discard, saved

#: Turns whose digests one row holds.
BLOCK = 32
#: Bytes of a stretch of joined ids.
STRETCH = 1 << 16
#: The root's name; all others are SHA-256 digests.
ROOT = bytes(1)
_PART_BITS = 33  # of monotonically_increasing_id


class Turns(NamedTuple):
    """Turns in order: ``rows`` (conv_id, part, n, digest, n_bytes), where n rises in a conversation, and ``places``
    (conv_id, part, first): the place of a turn in its conversation is n - first, from 0."""

    rows: DataFrame
    places: DataFrame

    def numbered(self) -> DataFrame:
        """(conv_id, pos, digest, n_bytes)."""
        return self.rows.join(self.places, ["conv_id", "part"]).select("conv_id", (F.col("n") - F.col("first")).alias("pos"), "digest", "n_bytes")

    def lengths(self) -> DataFrame:
        """(conv_id, n_turns)."""
        return self.rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Turns:
    """The turns of each conversation by turn number, nulls first, ties by the digest of role and text.

    Null roles and texts are empty. Rows without a conversation's id belong to none and are left out; ids are whole
    numbers. Repeated rows are turns of their own. Texts stay behind: a turn is its SHA-256 digest and its bytes.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.length(role), role, text), 256)
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("tie")
    )  # the tie lets ranges split rows that are equal
    rows = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "digest", "tie").select("conv_id", "digest", "n_bytes", F.monotonically_increasing_id().alias("n"))
    rows = saved(rows, "turns").withColumn("part", F.shiftright("n", _PART_BITS))
    runs = rows.groupBy("conv_id", "part").agg(F.count("*").alias("c"), F.min("n").alias("start"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return Turns(rows, runs.select("conv_id", "part", (F.col("start") - before).alias("first")))


def branched(turns: Turns, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their ``group`` of successive ids: turns (conv_id, pos, digest,
    n_bytes), and all conversations (conv_id, n_turns), turnless ones included.

    Conversation c takes the first h turns of conversation c - c % group (all if it has fewer, none
    if there is none), then its own after its first h, where h = crc32(c in decimals) % most.
    """
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("share")
    lengths = turns.lengths()
    heads = lengths.select("conv_id", "n_turns", (F.col("conv_id") - F.col("conv_id") % group).alias("head_id"), share)
    stems = lengths.select(F.col("conv_id").alias("head_id"), F.col("n_turns").alias("stem"))
    taken = heads.join(stems, "head_id", "left").withColumn("taken", F.least("share", F.coalesce("stem", F.lit(0))))
    taken = saved(taken.select("conv_id", "head_id", "share", "taken", "n_turns"), "heads")

    moved = turns.places.join(taken, "conv_id").withColumn("shift", F.col("taken") - F.col("share"))
    own = turns.rows.join(moved, ["conv_id", "part"]).withColumn("pos", F.col("n") - F.col("first")).filter("pos >= share")
    own = own.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "n_bytes")
    first = turns.numbered().filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "head_id")
    stem = taken.select("conv_id", "head_id", "taken").join(first, "head_id").filter("pos < taken").select("conv_id", "pos", "digest", "n_bytes")
    convs = taken.select("conv_id", (F.col("taken") + F.greatest(F.col("n_turns") - F.col("share"), F.lit(0))).alias("n_turns"))
    return own.unionByName(stem), convs


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _prefixes(items: DataFrame, last: int, scratch: list[DataFrame]) -> DataFrame:
    """(conv_id, pos, digest, prefix, before) of items (conv_id, pos, digest): the digests of all items up to this one
    and up to the one before, null at the first. ``last``: the largest pos. ``scratch`` gets the tables to delete later.

    Items meet in blocks only: a prefix is that of the blocks before, from the same function, and the block's part.
    """
    blocks = items.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("own"))
    inner = F.transform(F.sequence(F.lit(1), F.size("own")), lambda k: F.sha2(F.array_join(F.slice("own.digest", F.lit(1), k), ""), 256))
    blocks = blocks.withColumn("inner", inner)
    none = F.lit(None).cast("string")
    if last < BLOCK:
        blocks = blocks.withColumns({"outer": none, "ended": none})
    else:
        blocks = saved(blocks, "blocks")
        scratch.append(blocks)
        whole = blocks.filter(F.size("own") == BLOCK).select("conv_id", F.col("block").alias("pos"), F.element_at("inner", -1).alias("digest"))
        above = _prefixes(whole, last // BLOCK, scratch)
        ended = F.when(F.col("before").isNull(), F.col("digest")).otherwise(_hash(F.col("before"), F.col("digest")))
        above = above.select("conv_id", (F.col("pos") + 1).alias("block"), F.col("prefix").alias("outer"), ended.alias("ended"))
        later = blocks.filter("block > 0").join(above, ["conv_id", "block"])
        blocks = blocks.filter("block = 0").withColumns({"outer": none, "ended": none}).unionByName(later)
    through = F.transform("inner", lambda x: F.when(F.col("outer").isNull(), x).otherwise(_hash(F.col("outer"), x)))
    blocks = blocks.withColumn("through", through).withColumn("back", F.concat(F.array("ended"), F.col("through")))
    out = blocks.select("conv_id", F.posexplode("own").alias("i", "item"), "through", "back")
    return out.select("conv_id", "item.pos", "item.digest", F.get("through", F.col("i")).alias("prefix"), F.get("back", F.col("i")).alias("before"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first, ids) of sorted (node, conv_id): runs of ids of one node, joined."""
    node, first, ids, size = None, 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (n != node or size > STRETCH):
                yield row()
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends_sha256) of stretches sorted by node and first id; one is held at a time."""
    node, state = None, hashlib.sha256()
    names, digests = [], []
    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if node is not None:
                    names.append(node)
                    digests.append(state.hexdigest())
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], ["node", "ends_sha256"])
        names, digests = [], []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id)."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_stretches, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str], depth: int) -> DataFrame:
    """(node, values) of nodes (node, parent, values), where only a root has no parent: sums over each node and all below it.

    Pointer jumping: ``depth``, the largest distance from a root, takes log2(depth) + 1 rounds, each over
    the nodes that have an ancestor at twice the distance of the round before.
    """
    gathered = [F.sum(v).alias(v) for v in values]
    active = nodes.filter("parent is not null").select("node", F.col("parent").alias("up"), *values)
    gains, far = [], 1
    while far <= depth:
        gain = saved(active.groupBy(F.col("up").alias("node")).agg(*gathered), "trie-gain")
        gains.append(gain)
        far *= 2
        if far > depth:
            break
        higher = active.select(F.col("node").alias("up"), F.col("up").alias("up_2"))
        jumped = active.join(higher, "up").join(gain.select("node", *(F.col(v).alias(f"{v}_2") for v in values)), "node", "left")
        more = [(F.col(v) + F.coalesce(F.col(f"{v}_2"), F.lit(0))).alias(v) for v in values]
        before, active = active, saved(jumped.select("node", F.col("up_2").alias("up"), *more), "trie-active")
        if far > 2:
            discard(before)
    own = nodes.select("node", *values)
    for gain in gains:
        own = own.unionByName(gain)
    sums = saved(own.groupBy("node").agg(*gathered), "trie-sums")
    discard(*gains, *([active] if far > 2 else []))
    return sums


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of turns (conv_id, pos, digest, n_bytes) of conversations (conv_id, n_turns).

    Columns: conv_id, the node's smallest member; depth, its turns; parent_conv_id, null at the root; n_convs, members;
    n_children; n_leaves, nodes without children in its subtree, itself included; saved_tokens, over its subtree the sum of
    (n_convs - 1) times the bytes of the node's last text; ends_sha256, of the decimal ids of members that have no
    further turn, ascending and joined by commas. Without conversations there is no root and no row.
    """
    turns = saved(turns, "trie-turns")
    last = turns.agg(F.max("pos")).first()[0]
    all_convs = convs.agg(F.min("conv_id").alias("least"), F.count("*").alias("n")).first()
    last = -1 if last is None else last
    scratch = [turns]
    chained = _prefixes(turns.select("conv_id", "pos", "digest"), last, scratch)
    rows = turns.select("conv_id", "pos", "n_bytes").join(chained, ["conv_id", "pos"])
    before = F.when(F.col("before").isNull(), F.lit(ROOT)).otherwise(F.unhex("before"))
    rows = saved(rows.select("conv_id", (F.col("pos") + 1).alias("depth"), F.unhex("prefix").alias("node"), before.alias("parent"), "n_bytes"), "trie-rows")

    alike = [F.min(c).alias(c) for c in ("conv_id", "depth", "parent", "n_bytes")]
    nodes = rows.groupBy("node").agg(*alike, F.count("*").alias("n_convs"))
    root = convs.sparkSession.range(1 if all_convs.n else 0).select(
        F.lit(ROOT).alias("node"), F.lit(all_convs.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("n_bytes"), F.lit(all_convs.n).cast("long").alias("n_convs"),
    )
    nodes = saved(nodes.unionByName(root), "trie-nodes")
    scratch += [rows, nodes]
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").fillna(0, ["n_children"])
    nodes = saved(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}), "trie-counted")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"], last + 1)

    # a parent's smallest member; most children hang on the root, which needs no join
    names = nodes.filter("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    low = nodes.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(all_convs.least).cast("long")))
    named = low.unionByName(nodes.filter("depth > 1").join(names, "parent"))
    ends = rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    turnless = convs.filter("n_turns = 0").select("conv_id", F.lit(ROOT).alias("node"))
    out = named.drop("n_leaves", "saved_tokens").join(sums, "node").join(_ends(ends.unionByName(turnless)), "node", "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    out = saved(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest), "trie")
    discard(*scratch, nodes, sums)
    return out
