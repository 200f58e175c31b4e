"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable 64-bit key and the number of shards decide the shard; there is no
ring table.  With one more shard, a row either stays or moves into the new one.

Defined results: a null key counts as 0, a null text as no bytes.  Equal rows
get the same shard and different slots.  An empty table gives no rows.  Further
columns of the input are ignored by :func:`shard_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orrery.llm.store import written
from orrery.llm.textops import rank_in_group

N_SHARDS = 24


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of each key, vectorised: every step moves the keys that still jump."""
    if n < 1:
        raise ValueError("the number of shards must be positive")
    key = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    live, jump = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(live):
        shard[live] = jump
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        scale = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump = np.floor((shard[live] + 1) * scale).astype(np.int64)
        inside = jump < n
        live, jump = live[inside], jump[inside]
    return shard


def jump_column(key, n: int):
    """``jump_hash`` as a column expression over an integer key (null: 0)."""

    @F.pandas_udf(T.IntegerType())
    def jump(keys):
        import pandas as pd

        return pd.Series(jump_hash(keys.to_numpy(np.int64), n).astype(np.int32))

    return jump(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(0)).cast("long"))


def _assign(n: int):
    """Replaces the last column, a hash key, by shard, grown_shard, the task and the row's rank among its task's rows of the same shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(n, np.int64), TaskContext.get().partitionId()
        for b in batches:
            keys = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            shard, grown = jump_hash(keys, n), jump_hash(keys, n + 1)
            rank = seen[shard] + rank_in_group(shard)
            seen += np.bincount(shard, minlength=n)
            new = (shard.astype(np.int32), grown.astype(np.int32), np.full(len(keys), part, np.int32), rank)
            names = [*b.schema.names[:-1], "shard", "grown_shard", "part", "rank"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v) for v in new)], names=names)

    return run


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, size, text_crc32, shard, slot (gapless in its shard), grown_shard.

    The rows themselves are never shuffled.  Each task numbers its rows within
    each shard and the numbered rows are written once; only one count per task
    and shard is summed up to turn those ranks into slots.
    """
    base = docs.select(
        F.col(key).alias("document"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(key), F.lit(0)).cast("long").alias("hashed"),
    )
    out = [*base.schema.fields[:-1], T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]
    ranked = written(base.mapInArrow(_assign(n_shards), T.StructType(out)), "shards")
    counts = ranked.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return ranked.join(starts, ["shard", "part"]).select(F.col("document").alias(key), "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"), "grown_shard")


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
