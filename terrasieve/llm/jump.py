"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself.

The key is a stable 64-bit hash of the id. Slots number the rows of a shard from
0 in order of the key columns, without one task for a shard: rows are dealt by
range of (shard, key), numbered inside their partition, and moved by the counts of
the partitions before.

Defined results: a null id is hashed like any other value, a null text has size 16
and the crc of no bytes, very long texts only add their bytes, equal rows and ties get
neighbouring slots, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, stored, table

#: The generator of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each unsigned 64-bit key, all keys stepping together."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = keys.astype(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        key[live] = key[live] * MULTIPLIER + np.uint64(1)
        nxt = ((out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[nxt < shards]
        out[live] = nxt[nxt < shards]
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key column."""

    @F.pandas_udf("int")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(jump(x.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key)


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``slot``: each row's number from 0 inside its group, in the given order."""
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            g = batch.column(group).to_numpy(zero_copy_only=False)
            if not len(g):
                continue
            row = np.arange(len(g), dtype=np.int64)
            new = np.concatenate([[g[0] != last], g[1:] != g[:-1]])
            begun = np.maximum.accumulate(np.where(new, row, -1))  # -1: in the batch before
            at = np.where(begun < 0, row + count, row - begun)
            last, count = g[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part, np.int32)), pa.array(at)], schema.names)

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    here = stored(dealt.mapInArrow(run, schema), "slots")
    counts = here.groupBy(group, "part").agg(F.count("*").alias("n"))
    before = counts.select(group, "part", (F.sum("n").over(W.partitionBy(group).orderBy("part")) - F.col("n")).alias("before"))
    return here.join(before, [group, "part"]).withColumn("slot", F.col("before") + F.col("at")).drop("part", "at", "before")


def shard_by_key(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of (doc_id, text)."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id").alias("key"),
    )
    placed = sized.withColumn("shard", jump_shard(F.col("key"), shards)).withColumn("grown_shard", jump_shard(F.col("key"), shards + 1)).drop("key")
    return numbered(placed, "shard", "doc_id", "text_crc32", "size").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_key(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), 40)
