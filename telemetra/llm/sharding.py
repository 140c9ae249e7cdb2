"""Consistent sharding through a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own
(offset and skip from hashes of its name).  Shards take turns to claim their next
free slot, so all hold nearly the same number of slots, and a lost or added
shard moves little else.  Placing a row is one hash and one look into the table,
which is broadcast; its size is the ``slots`` parameter and not that of the data.

A null key is placed like the empty string, equal keys go to the same shard, so
choose a key that tells rows apart (a document id, not its source).  All columns
are kept; ``slot`` and ``shard`` are added, or replaced.  An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537


def fill(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of each slot. ``slots`` must be a prime above the number of shards."""
    if not shards or len(set(shards)) < len(shards) or len(shards) >= slots:
        raise ValueError("shards must be distinct, at least one, and fewer than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    offset = [xxhash.xxh64_intdigest(s, 1) % slots for s in shards]
    skip = [xxhash.xxh64_intdigest(s, 2) % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, np.int32)
    following, free = list(offset), slots
    while free:
        for i in range(len(shards)):
            at = following[i]
            while table[at] >= 0:
                at = (at + skip[i]) % slots
            table[at] = i
            following[i] = (at + skip[i]) % slots
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.xxhash64(text), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The table as (slot, shard)."""
    names = np.array(shards, dtype=object)[fill(shards, slots)]
    rows = pa.table({"slot": np.arange(slots, dtype=np.int32), "shard": names.tolist()})
    return spark.createDataFrame(rows)


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Adds the slot and the shard of each row."""
    table = table_frame(df.sparkSession, shards, slots)
    rows = df.withColumn("slot", slot_of(F.col(key), slots)).drop("shard")
    return rows.join(F.broadcast(table), "slot", "left").select(
        *[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard"
    )


def write_shards(placed: DataFrame, folder: str, files: int = 4) -> None:
    """Write a folder per shard, each in about ``files`` files by ranges of its slots."""
    spread = F.pmod(F.col("slot"), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(folder)
