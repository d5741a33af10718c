"""Permutation-filled lookup table: consistent placement of rows on shards (native).

Every shard has its own permutation of the slots of a prime-sized table, from two hashes of its
name. Shards take turns; at its turn a shard claims the first slot of its permutation that is
still free. The table is then a balanced map slot -> shard, and losing a shard moves few slots
besides its own. Rows find their shard by `hash(key) mod table size`, a lookup in a broadcast
relation of a fixed number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialens.llm.runtime import col, fresh

#: Slots of the table: a prime, so that every stride walks through all slots. It bounds the broadcast.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 199_999


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """Index of the owning shard for each slot.

    `weights` (whole numbers from 1) gives a shard so many turns in each round. Shard names must be
    distinct. Slots differ by at most the largest weight from the exact share.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and at least one")
    if not _is_prime(size) or size > MAX_TABLE_SIZE or size < len(shards):
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    turns = list(weights) if weights is not None else [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("weights: one whole number from 1 for each shard")
    at, step = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1 if size > 2 else 1)
    table = [-1] * size
    left = size
    while True:
        for shard, n in enumerate(turns):
            for _ in range(n):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % size
                table[at[shard]] = shard
                left -= 1
                if not left:
                    return table


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the table size. A null key counts as ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("bigint")


def assign_shards(
    df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None, slot_col: str = "slot", shard_col: str = "shard"
) -> DataFrame:
    """df with the slot (long) and the shard's name (string) of each row.

    Equal keys share a shard, so repeated rows stay together; null keys count as the empty text. An
    empty table gives an empty result. Columns of df named like the two new ones are replaced.
    The lookup relation has `size` rows whatever df holds, so its broadcast is bounded; no shuffle.
    """
    spark = df.sparkSession
    slot, join_slot, owner = fresh(df, "slot", "table_slot", "owner")
    table = ",".join(map(str, lookup_table(shards, size, weights)))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias(join_slot, owner))
    lookup = lookup.select(F.col(join_slot).cast("bigint").alias(join_slot), F.element_at(names, F.col(owner).cast("int") + 1).alias(owner))
    kept = [col(c) for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    placed = df.withColumn(slot, key_slot(col(key), size)).join(F.broadcast(lookup), F.col(slot) == F.col(join_slot), "left")
    return placed.select(*kept, F.col(slot).alias(slot_col), F.col(owner).alias(shard_col))


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str], **options) -> None:
    """Writes df as Parquet, one folder for each shard. Rows are written where they are: no shuffle,
    so a hot key never gathers in one task."""
    assign_shards(df, key, shards, **options).write.partitionBy("shard").mode("overwrite").parquet(path)
