"""Placing rows on shards by a permutation-filled lookup table, in Spark functions only.

Each shard prefers the slots of a prime-sized table in an order of its own. The shards take turns, each claiming the
first free slot of its order, until the table is full; so shares differ by one slot at most, and when a shard comes or
goes few keys move between the others. A key is placed by its hash: one slot, one look-up in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The usual number of slots, a prime; and the most, which bounds what is broadcast to some 20 MB.
SLOTS, MOST_SLOTS = 65_537, 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot. Its size depends on slots alone."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key; null counts as the empty string."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row; equal keys share a shard. Columns of these names are replaced, all others kept.

    A null key is placed as the empty string. Repeated rows stay, an empty table stays empty.
    """
    spark = df.sparkSession
    table = ",".join(map(str, lookup_table(shards, slots)))
    names = ",".join(s.encode().hex() for s in shards)
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("__slot", "__index"))
    rows = rows.select("__slot", F.decode(F.unhex(F.element_at(F.split(F.lit(names), ","), F.col("__index").cast("int") + 1)), "UTF-8").alias("__shard"))
    kept = [c for c in df.columns if c not in (slot_name, shard_name)]
    found = df.select(*(F.col(f"`{c}`") for c in kept), slot_of(F.col(f"`{key}`"), slots).alias("__at"))
    return found.join(F.broadcast(rows), F.col("__at") == F.col("__slot")).select(*(F.col(f"`{c}`") for c in kept), F.col("__at").alias(slot_name), F.col("__shard").alias(shard_name))


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 1, slots: int = SLOTS) -> None:
    """Write df as Parquet, a folder shard=NAME for each shard, in some files files; rows spread over the files of a shard by the hash of the whole row, so a hot key is no hot task."""
    placed = place(df, key, shards, slots)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(files))
    placed.repartition(len(shards) * files, "shard", salt).write.partitionBy("shard").parquet(path)
