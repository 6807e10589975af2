"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size.  Shards take turns, each claiming the next free slot of its order, until
the table is full; a shard of weight w takes w turns a round.  A row's key is
hashed to a slot, so placing it is one lookup in a table of fixed size that is
broadcast.  Shards get equal shares (by weight), and adding or removing a shard
moves little more than its own share.

Edge cases: a null key is placed like the empty string; equal keys share a shard
unless ``spread`` deals a key over several slots by the row's own hash; repeated
rows and other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 8191  # a prime; over a hundred slots for each of SHARDS
SHARDS = 64


def _preference(name: str, slots: int) -> tuple[int, int]:
    digest = hashlib.md5(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill(weights: dict[str, int], slots: int = SLOTS) -> list[int]:
    """The shard number (in order of ``weights``) that owns each slot."""
    if not weights or sum(weights.values()) > slots or min(weights.values()) < 1:
        raise ValueError("weights must be positive and fit in the table")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    orders = [_preference(name, slots) for name in weights]
    tries, owner, left = [0] * len(orders), [-1] * slots, slots
    while left:
        for shard, weight in enumerate(weights.values()):
            start, skip = orders[shard]
            for _ in range(min(weight, left)):
                while owner[slot := (start + tries[shard] * skip) % slots] >= 0:
                    tries[shard] += 1
                owner[slot] = shard
                left -= 1
    return owner


def table(spark: SparkSession, weights: dict[str, int], slots: int = SLOTS, name: str = "shard") -> DataFrame:
    """``slot, shard`` with one row for each of the fixed number of slots."""
    owners = F.split(F.lit(",".join(map(str, fill(weights, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", name)).select("slot", F.col(name).cast("int").alias(name))


def slot(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the first 60 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, weights: dict[str, int], slots: int = SLOTS, spread: int = 1, name: str = "shard") -> DataFrame:
    """``df`` with the shard number of each row in column ``name``."""
    value = F.col(key).cast("string")
    if spread > 1:
        copy = F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(spread)).cast("string")
        value = F.concat(F.coalesce(value, F.lit("")), F.lit("#"), copy)
    rows = df.select(F.struct("*").alias("row"), slot(value, slots).alias("slot"))
    owners = F.broadcast(table(df.sparkSession, weights, slots, "owner"))
    return rows.join(owners, "slot").select("row.*", F.col("owner").alias(name))


def write(df: DataFrame, path: str, name: str = "shard") -> None:
    """A folder per shard; a large shard is written by several tasks."""
    df.hint("rebalance", name).write.partitionBy(name).parquet(path)
