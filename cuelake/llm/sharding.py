"""Shard placement by a permutation-filled lookup table. DataFrame functions only.

Every shard prefers the slots of a prime-sized table in an order of its own, `offset + k * skip`
modulo the size. Shards take turns (a shard of weight 2 takes two turns a round) and claim the next
slot of their order that is free, until the table is full. A key goes to the shard of the slot that
its hash names. When a shard comes or goes, few keys move between the others.

The table is built from the shard names alone, so its rows are bounded by `size`, a parameter; that
is the proven bound under which it is broadcast. The data see a hash and one lookup, and no shuffle.

Edge cases. A null key hashes like the empty text. Repeated keys meet in one shard. Empty table:
empty result. All columns of the input are kept, but for those named like the two new ones, which these
replace; the new names are parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import wrapped


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int, weights: dict[str, int] | None = None) -> list[int]:
    """Index of the shard that holds each slot."""
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table needs a prime size of at least the number of shards")
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shards need distinct names")
    offset = [_digest(f"{s}/offset") % size for s in shards]
    skip = [_digest(f"{s}/skip") % (size - 1) + 1 for s in shards]
    turns = [k for k, s in enumerate(shards) for _ in range((weights or {}).get(s, 1))]
    table = [-1] * size
    asked = [0] * len(shards)
    free = size
    while free:
        for k in turns:
            if not free:
                break
            slot = (offset[k] + asked[k] * skip[k]) % size
            while table[slot] >= 0:
                asked[k] += 1
                slot = (offset[k] + asked[k] * skip[k]) % size
            table[slot] = k
            asked[k] += 1
            free -= 1
    return table


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: 60 bits of its md5 modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def lookup_table(spark, table: list[int]) -> DataFrame:
    """(slot, shard) rows of a filled table, made by one expression."""
    listed = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1, numPartitions=1).select(F.posexplode(listed).alias("slot", "held")).select(
        "slot", F.col("held").cast("int").alias("shard")
    )


def assign_shards(
    df: DataFrame, key: str, shards: list[str], size: int, weights: dict[str, int] | None = None, slot: str = "slot", shard: str = "shard"
) -> DataFrame:
    """`df` with the slot and the shard index of every row."""
    table = lookup_table(df.sparkSession, fill_table(shards, size, weights))
    placed = wrapped(df).withColumn("slot", slot_of(F.col(f"doc.`{key}`"), size)).join(F.broadcast(table), "slot")
    own = [F.col(f"doc.`{c}`") for c in df.columns if c not in (slot, shard)]
    return placed.select(*own, F.col("slot").alias(slot), F.col("shard").alias(shard))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder per shard. A shard's rows are split over tasks by a hash, so that a shard that holds
    most rows is written by many tasks."""
    counts = sharded.groupBy("shard").count()
    parts = F.greatest(F.lit(1), F.ceil(F.col("count") / rows_per_file)).cast("int")
    salted = sharded.join(counts.select("shard", parts.alias("_parts")), "shard").withColumn(
        "_part", F.pmod(F.xxhash64(*[c for c in sharded.columns]), F.col("_parts"))
    )
    salted.repartition("shard", "_part").drop("_part", "_parts").write.partitionBy("shard").parquet(path)
