"""Sharding by jump consistent hashing: no ring table, and a shard more takes rows only into itself.

A row's shard depends on its key and the number of shards alone. Its slot is its rank in the shard,
by (part, key), where parts deal a shard over many tasks. A null key is a key like any other; rows
that agree in key, checksum and size get consecutive slots in either order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import read_table, salted_rank, text_of

#: Parts into which each shard is dealt for ranking.
PARTS = 64


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket in [0, shards) of each 64-bit key (Lamping and Veach, 2014)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = keys.astype(np.int64).view(np.uint64).copy()
    at = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while live.size:
        at[live] = ahead[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = np.float64(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of any key column, by the xxhash64 of its value."""

    @F.pandas_udf("int")
    def jump(h: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(h.to_numpy(), shards), dtype="int32")

    return jump(F.xxhash64(key))


def shard_rows(df: DataFrame, key: str, shards: int, order: list[str], parts: int = PARTS) -> DataFrame:
    """``df`` with shard, slot and grown_shard (the shard if there were one more)."""
    out = df.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))
    return salted_rank(out, ["shard"], [F.col(c).asc_nulls_last() for c in [key, *order]], F.xxhash64(F.lit(7), F.col(key)), parts, "slot")


def write_shards(df: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """Rows of ``shard_rows`` as one folder for each shard, in files of about ``per_file`` slots."""
    chunk = F.floor(F.col("slot") / F.lit(per_file))
    df.withColumn("__chunk", chunk).repartition("shard", "__chunk").sortWithinPartitions("shard", "slot").drop("__chunk").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    return shard_rows(rows, "doc_id", 40, ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
