import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm.sharding import jump_column, jump_hash
from orrery.llm.near_dedup import near_duplicates
from orrery.llm.store import BATCH, Table, gathered, on_workers, only, shared_folder, split, written


def test_only_is_an_exact_semi_join(spark):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i}") for i in range(200)], "doc long, text string")
    wanted = spark.createDataFrame([(3,), (3,), (None,), (40,), (10**12,)], "k long")
    got = sorted(map(tuple, only(rows, "doc", wanted).collect()))
    assert got == sorted(map(tuple, rows.filter("doc in (3, 40)").collect())) and got
    assert only(rows, "doc", wanted.limit(0)).count() == 0
    plan = only(rows, "doc", wanted)._jdf.queryExecution().executedPlan().toString()
    assert "mask" in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("bits", [1 << 6, 1 << 27])
def test_filter_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr("orrery.llm.store.FILTER_BITS", bits)
    rows = spark.createDataFrame([(i, i, "t", i, -i, True) for i in range(400)] + [(None, 0, "t", 0, 0, False)], "doc long, at int, word string, mask int, wanted int, hit boolean")
    wanted = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "k long")
    assert sorted(map(tuple, only(rows, "doc", wanted).collect())) == sorted(map(tuple, rows.filter("doc % 3 = 0").collect()))
    hit, rest = split(rows, "doc", wanted)
    assert hit.count() + rest.count() == 401 and rest.filter("doc % 3 = 0").count() == 0 and hit.columns == rest.columns == rows.columns


def test_tables(spark):
    t = Table(spark.range(5), "five")
    assert t.path.startswith(shared_folder(spark).rstrip("/")) and t.frame().count() == 5
    t.drop()
    assert not os.path.exists(t.path.removeprefix("file:"))
    empty = written(spark.range(0), "none")
    assert empty.columns == ["id"] and empty.count() == 0
    on_workers(spark)
    assert os.path.isdir(os.path.join(spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)[0], "orrery"))


def test_jump_column(spark):
    on_workers(spark)
    df = spark.createDataFrame([(1,), (None,), (-5,)], "k long")
    assert [r.s for r in df.select(jump_column("k", 24).alias("s")).collect()] == jump_hash(np.array([1, 0, -5]), 24).tolist()


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "size"])


def test_workers_get_small_batches(spark):
    asked = spark._jsparkSession.conf().contains(BATCH[0]) and spark.conf.get(BATCH[0])
    spark.conf.unset(BATCH[0])
    on_workers(spark)
    long = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 8000).alias("text"))  # 40 MB in one partition
    got = long.mapInArrow(_sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 5000 and max(r.size for r in got) < 10 << 20
    spark.conf.set(BATCH[0], "1000000b")
    on_workers(spark)
    assert spark.conf.get(BATCH[0]) == "1000000b"
    spark.conf.set(*(BATCH if not asked else (BATCH[0], asked)))


def test_tables_of_many_partitions_have_few_files(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files, write = {}, Table.__init__

    def counted(self, df, name):
        write(self, df, name)
        files[self.path] = sum(f.startswith("part-") for f in os.listdir(self.path.removeprefix("file:")))

    monkeypatch.setattr(Table, "__init__", counted)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        words = [f"w{i}" for i in range(30)]
        docs = spark.createDataFrame([(i, " ".join(words[i % 25 :] + [f"d{i % 150}"] * 6)) for i in range(300)], "doc_id long, text string")
        got = {r.doc: r.component_id for r in near_duplicates(docs).collect()}
        assert got == {i: got[i % 150] for i in range(300)} and all(got[i] <= i for i in got)
        assert len(files) > 10 and max(files.values()) <= 4 * spark.sparkContext.defaultParallelism
        wide = spark.range(0, 1000, 1, 64)
        assert gathered(wide).rdd.getNumPartitions() == 16 and sorted(r.id for r in gathered(wide).collect()) == list(range(1000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
