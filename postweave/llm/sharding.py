"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a start and a step
from its hashed name, so that the order visits every slot once. Shards take turns, each claiming
the first free slot of its order, until the table is full. Shards then own equal numbers of
slots, give or take one, and when a shard comes or goes most slots keep their owner.

The table is small and of fixed size. It is sent to every executor; a document's slot is the
hash of its key modulo the size, so placing a row is one look-up without any shuffle, and a
key that many rows share costs no more than others.

Defined cases: a null key hashes as the empty string. Equal keys go to the same shard. Columns
named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A prime, at least a hundred times the number of shards for an even share.
SLOTS = 65_537
# Digits of a key's hash that fit a 64-bit number.
HASH_DIGITS = 15


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's preference order."""
    digest = hashlib.md5(name.encode()).hexdigest()
    start, step = int(digest[:HASH_DIGITS], 16), int(digest[-HASH_DIGITS:], 16)
    return start % slots, step % (slots - 1) + 1


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the number of the shard that owns it.

    Shards take turns in the order of their names, so the order they are given in is of no matter.
    """
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("need distinct shards, no more than slots")
    turns = sorted(range(len(shards)), key=lambda k: shards[k])
    order = {k: preference(shards[k], slots) for k in turns}
    tried = dict.fromkeys(turns, 0)
    table, free = [-1] * slots, slots
    while free:
        for k in turns:
            start, step = order[k]
            while table[(start + tried[k] * step) % slots] >= 0:
                tried[k] += 1
            table[(start + tried[k] * step) % slots] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint"), F.lit(slots))


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``: the table as a frame of fixed size."""
    rows = [(slot, shards[k]) for slot, k in enumerate(fill_table(shards, slots))]
    return spark.createDataFrame(rows, "slot bigint, shard string")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row."""
    table = F.broadcast(lookup(docs.sparkSession, shards, slots))
    return docs.drop("slot", "shard").withColumn("slot", slot_of(docs[key], slots)).join(table, "slot")


def write_shards(docs: DataFrame, path: str, shards: list[str], key: str = "doc_id",
                 slots: int = SLOTS) -> None:
    """Write one folder per shard; AQE splits large shards and gathers small ones."""
    placed = place(docs, shards, key, slots)
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
