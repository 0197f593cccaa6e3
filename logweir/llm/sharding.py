"""Sharding by jump consistent hashing.

A stable 64-bit key and the number of shards decide where a row goes; there is no table of ring points. When one
shard is added, the only rows that move are those that the new shard takes (one in n + 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweir.llm.common import pieces

# Fixed values of the published generator.
MULTIPLIER = np.uint64(2862933555777941757)
ROWS_PER_BUCKET = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key. Every key jumps ahead until it would leave the shards there are."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while moving.size:
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = np.floor((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """``key``: a long column, already mixed (a hash)."""

    @F.pandas_udf("int")
    def take(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return take(key)


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every row's shard, its shard if one more is added, and its place in the shard.

    Returns key, ``size`` (UTF-8 bytes of the text plus 1; null text: 1), ``text_crc32`` (null text: 0), ``shard``,
    ``grown_shard``, ``slot`` (gapless from 0 in each shard). The key column decides alone; rows without a key go by
    their text. Rows with equal keys share a shard; each gets a slot of its own. No other column is read, so
    extra columns do not matter; an empty table gives no rows.

    Slots need no task that holds a shard: a shard is dealt into buckets of about ``rows_per_bucket`` rows, rows are
    numbered in their bucket, and each bucket starts where the buckets before it end. Key and text choose the bucket, so a key
    on many rows with other texts is no bucket of its own.
    """
    buckets = pieces(df.count() / shards, rows_per_bucket)
    mixed = F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    rows = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        mixed.alias("mixed"),
    )
    rows = rows.select(
        "*",
        shard_of(F.col("mixed"), shards).alias("shard"),
        shard_of(F.col("mixed"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("mixed", "text_crc32", "size", F.lit(1)), F.lit(buckets)).alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, shards: int, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write whole rows into one folder per shard (``shard=<n>``), tasks dealt by shard and a salt of the key."""
    mixed = F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text)))
    placed = df.withColumn("shard", shard_of(mixed, shards))
    placed.repartition("shard", F.pmod(F.xxhash64(mixed, F.lit(2)), F.lit(16))).write.partitionBy("shard").parquet(path)
