"""Sharding by jump consistent hashing.

A document's key alone decides its shard, without a table of ring positions;
appending a shard moves only the rows that go into it (in expectation one in n + 1).
Law of this operator: ``key``.

Nulls, ties, empties: a null key counts as key 0; a null text has no bytes; rows
that repeat a key stay together and get places of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._batch import U64, load, mix

_GOLDEN = U64(0x9E3779B97F4A7C15)


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards of 64-bit keys (mixed first: ids are often consecutive) among n."""
    key = mix(keys.astype(np.int64).view(U64) + _GOLDEN)
    shard = np.zeros(len(key), dtype=np.int64)
    live, jump = np.arange(len(key)), np.zeros(len(key), dtype=np.int64)
    while len(live):
        shard[live] = jump
        k = key[live] * U64(2862933555777941757) + U64(1)
        key[live] = k
        jump = ((jump + 1).astype(np.float64) * (float(1 << 31) / ((k >> U64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        stay = jump < n
        live, jump = live[stay], jump[stay]
    return shard


def shard_of(key: Column, n: int) -> Column:
    @F.pandas_udf(T.IntegerType())
    def jump(s: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(s.to_numpy(), n).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, n: int = 24, blocks: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, place in the shard (gapless from 0) and shard among n + 1.

    Places are numbered in n * blocks groups and shifted by the sizes of the groups
    before (a table of n * blocks rows), so no task holds a whole shard. At 100 TB
    blocks grows with the rows per group that one task may sort.
    """
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8).cast("long")).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumns({
        "shard": shard_of(F.col(key), n),
        "grown_shard": shard_of(F.col(key), n + 1),
        "block": F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"),
    })
    sizes = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy(key, "text_crc32")) - 1
    return (
        rows.withColumn("place", place)
        .join(F.broadcast(shift), ["shard", "block"])  # at most n * blocks rows
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("place") + F.col("shift")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, n: int = 24, key: str = "doc_id") -> None:
    """The documents as Parquet, a folder per shard."""
    docs.withColumn("shard", shard_of(F.col(key), n)).repartition("shard", F.pmod(F.xxhash64(key), F.lit(64))).write.partitionBy("shard").parquet(path)


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(load(spark, sf_dir, "documents"))

