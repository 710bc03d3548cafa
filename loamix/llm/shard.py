"""Sharding by jump consistent hashing.

A stable integer key decides its shard by a short chain of pseudo-random jumps;
no ring table exists. Going from n to n + 1 shards moves about 1 / (n + 1) of
the keys, all of them into the new shard.

Defined cases: a null key counts as 0; a null text has size 1 and the checksum
of an empty text; rows with one key are ordered by checksum, size and then
their place in the input; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import stored, written

#: Multiplier of the linear congruential generator of the published algorithm (fixed value).
MULTIPLIER = 2862933555777941757
#: Rows that one task numbers.
ROWS_A_TASK = 2_000_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(state), np.int64)
    landing = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = landing[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        scale = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        landing[live] = np.floor((bucket[live] + 1).astype(np.float64) * scale).astype(np.int64)
        live = live[landing[live] < shards]
    return bucket


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """df with the shard of its key column; no shuffle."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return df.withColumn(name, place(F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint"))))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per document: size, text_crc32, law, shard, slot (gapless in its shard) and grown_shard.

    Texts are read once and never shuffled. The narrow rows are put in order by
    range, so that each task numbers a bounded stretch whatever shard or key is
    hot; a table of rows per (task, shard) then gives each stretch its start.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = with_shard(with_shard(rows, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    placed = written(rows.withColumn("at", F.monotonically_increasing_id()), "shard-rows")
    n = max(1, -(-placed.count() // ROWS_A_TASK))
    ordered = placed.repartitionByRange(n, "shard", "doc_id", "text_crc32", "size", "at")
    ordered = ordered.sortWithinPartitions("shard", "doc_id", "text_crc32", "size", "at")
    spot = F.monotonically_increasing_id()
    numbered, _ = stored(ordered.withColumn("task", F.shiftright(spot, 33)).withColumn("spot", spot), "shard-slots")
    # one row per (task, shard): tasks plus shards rows at most, as tasks are ranges
    counts = numbered.groupBy("task", "shard").agg(F.count("*").alias("n"), F.min("spot").alias("first")).collect()
    starts, before = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["task"])):
        starts.append((r["task"], r["shard"], before.get(r["shard"], 0) - r["first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    offset = spark.createDataFrame(starts, "task bigint, shard int, shift bigint")
    return numbered.join(F.broadcast(offset), ["task", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("spot") + F.col("shift")).alias("slot"),
        "grown_shard",
    )
