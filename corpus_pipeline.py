"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.decontaminate import decontamination_stage
from orrery.llm.language_id import language_stage
from orrery.llm.near_dedup import dedup_stage
from orrery.llm.packing import pack
from orrery.llm.queries import visible
from orrery.llm.store import Table
from orrery.llm.suffix_dedup import repeats_stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a language that is clear enough."""
    return language_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the first, of each group of near copies (five-word shingles, similarity 0.8)."""
    return dedup_stage(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes and more that occur earlier."""
    return repeats_stage(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak an item of the benchmark."""
    return decontamination_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [(f.__name__, visible(f)) for f in (language_id, near_dedup, suffix_dedup, decontaminate, best_fit_packing)]

#: No stage but the last can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        table = Table(stage(spark, docs, sf_dir), name)
        docs = table.frame()
        if before is not None:
            before.drop()  # what a stage was made from isn't read again
        before = table
    return STAGES[-1][1](spark, docs, sf_dir)
