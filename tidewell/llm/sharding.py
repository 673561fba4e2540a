"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an offset and a skip, both from its name's
digest, which walk through every slot as the size is prime. Shards take turns; at its turn a shard claims the first
slot of its order that is still free. Shares differ by one slot at most, and when a shard leaves, few slots of the
others change hands. The table depends on parameters alone (``table_size`` slots, never on the data), so it is filled
while the query is planned and travels as a literal; rows find their slot by hash and their shard by a broadcast join
of exactly ``table_size`` rows. No row moves, so a hot key costs nothing here.

Defined cases: keys are hashed by the text of their value, a null key as the empty string; equal keys go to the same
shard, so repeated rows stay together; a key of any length has one digest; an empty table gives an empty result; columns whose names clash with the
result's are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents

SHARDS = 64
TABLE_SIZE = 65537


@lru_cache(maxsize=8)
def fill_table(names: tuple[str, ...], size: int) -> tuple[int, ...]:
    """The shard (its place in ``names``) that owns each slot. ``size`` must be a prime of at least ``len(names)``."""
    if not names or size < max(2, len(names)) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime size with a slot for each of one or more shards")
    seeds = [hashlib.sha256(n.encode()).digest() for n in names]
    walks = [[int.from_bytes(s[:8], "big") % size, int.from_bytes(s[8:16], "big") % (size - 1) + 1] for s in seeds]
    table, free = [-1] * size, size
    while True:
        for shard, walk in enumerate(walks):
            slot, skip = walk
            while table[slot] >= 0:
                slot = (slot + skip) % size
            table[slot], walk[0], free = shard, (slot + skip) % size, free - 1
            if not free:
                return tuple(table)


def shard_names(shards: int) -> tuple[str, ...]:
    return tuple(f"shard-{k:05d}" for k in range(shards))


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(size)


def place(df: DataFrame, key: str, names: tuple[str, ...], size: int = TABLE_SIZE) -> DataFrame:
    """``df``'s key with ``slot`` and ``shard``, the number of the shard that owns the slot."""
    spark = df.sparkSession
    text = ",".join(map(str, fill_table(names, size)))
    table = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard"))
    table = table.select(F.col("slot").cast("bigint").alias("slot"), F.col("shard").cast("bigint").alias("shard"))
    return df.select(F.col(key), slot_of(F.col(key), size).alias("slot")).join(F.broadcast(table), "slot").select(key, "slot", "shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(documents(spark, sf_dir), "doc_id", shard_names(SHARDS))


def oracle() -> str:
    table = ",".join(map(str, fill_table(shard_names(SHARDS), TABLE_SIZE)))
    return f"""
WITH lookup AS (SELECT string_split('{table}', ',') AS owners),
     slots AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, slot, CAST(owners[slot + 1] AS BIGINT) AS shard FROM slots, lookup
"""
