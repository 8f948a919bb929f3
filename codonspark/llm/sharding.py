"""Operator 8, sharding by jump consistent hashing.

A shard follows from the key and the number of shards alone, with no ring table: adding a shard
moves into it the share it is due and moves no row between the others. Integer keys are used as they
are, others by their XXH64. Slots number the rows of a shard without gaps. A shard is not numbered in one task:
rows are dealt into `bins` by an id of their own, so that a key that many rows share is dealt over them
too, each bin of a shard is numbered by itself and starts after the earlier bins' counts. Rows are hashed once, into a table in the shared folder.

Defined cases: a null text has no bytes and checksum 0; a null key counts as key 0, with rows in any
order; keys may be integers or of any other type that Spark hashes; rows that repeat a key share its shard and take any of its slots; very long
texts are rows like others; an empty table gives an empty result; extra columns are kept, but for those called shard, grown_shard or slot, in whose place the operator's stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, staged

#: The generator of Lamping and Veach's jump hash (fixed value).
_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among 0 to shards - 1."""
    key, at, ahead = keys.astype(np.int64).view(np.uint64).copy(), np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    while (open_ := ahead < shards).any():
        at[open_] = ahead[open_]
        key[open_] = key[open_] * _MULTIPLIER + np.uint64(1)
        ahead[open_] = ((at[open_] + 1) * (float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.int64) + 1).astype(np.float64))).astype(np.int64)
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Column of jump_hash over a long column."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    return run(F.coalesce(key, F.lit(0).cast("long")))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", keep: list[str] | None = None, bin_rows: int = 1 << 20) -> DataFrame:
    """The columns of `keep` (all by default), with shard, grown_shard (with one shard more) and slot."""
    own = {"shard", "grown_shard", "slot"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in own]
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    long_key = F.col(f"`{key}`").cast("long") if whole else F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(f"`{key}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), long_key.alias("key"))
    # hashed once and written, so that counts and numbers see the same rows with the same ids
    dealt = staged(rows.select("kept", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("row")))
    bins = max(1, -(-dealt.count() // (bin_rows * shards))) * 4
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(bins)))
    counts = dealt.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "bin", (F.sum("n").over(W.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("start"))
    numbered = dealt.withColumn("number", F.row_number().over(W.partitionBy("shard", "bin").orderBy("row")))
    return numbered.join(starts, ["shard", "bin"]).select("kept.*", "shard", "grown_shard", (F.col("start") + F.col("number") - 1).alias("slot"))


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(sized, 40).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
