"""Sharding of rows by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size
(offset and step from the digest of its name). The shards take turns and each
claims its next free slot until the table is full, so every shard owns an
almost equal number of slots and a change of the shard list moves few of
them. A row's slot is a digest of its key; the table, whose size is the
parameter ``size``, is broadcast and gives the shard in constant time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 4099
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % p for p in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], size: int = SIZE) -> list[int]:
    """The shard index of each slot. ``size`` must be a prime of at most ``MOST_SLOTS``, no less than the shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named and distinct")
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError("size must be a prime, from the number of shards to MOST_SLOTS")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    slots, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            while slots[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            slots[at[shard]] = shard
            left -= 1
            if not left:
                break
    return slots


def assign_shards(df: DataFrame, key: str, shards: Sequence[str], size: int = SIZE, prefix: str = "") -> DataFrame:
    """Every row of ``df`` with ``{prefix}slot`` int, ``{prefix}shard`` int and ``{prefix}shard_name`` string.

    A null key counts as the empty string; equal keys always meet in one shard. Very long keys count as a whole; an
    empty table gives an empty one. Columns of ``df`` with those names raise ValueError; give a ``prefix`` then.
    """
    names = [f"{prefix}slot", f"{prefix}shard", f"{prefix}shard_name"]
    if clash := [n for n in names if n in df.columns]:
        raise ValueError(f"columns exist already: {clash}")
    filled = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",").cast("array<int>")
    lookup = df.sparkSession.range(1).select(F.posexplode(filled).alias(*names[:2]))
    lookup = lookup.withColumn(names[2], F.element_at(F.array(*map(F.lit, shards)), F.col(names[1]) + 1))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
    # The table has at most MOST_SLOTS rows whatever the input, so it is broadcast.
    joined = df.withColumn(names[0], slot).join(F.broadcast(lookup), names[0])
    return joined.select(*df.columns, *names)
