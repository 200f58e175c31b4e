import zlib
from collections import defaultdict

import numpy as np

from orrery.llm.sharding import jump_hash, op8_jump_sharding, shard_documents


def jump_one(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_scalar_form():
    keys = np.array([0, 1, -1, 5, 2**63 - 1, -(2**63), *range(1000, 1400)], dtype=np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert [jump_one(int(k), n) for k in keys] == jump_hash(keys, n).tolist()


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(20000)
    a, b = jump_hash(keys, 24), jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and abs((a != b).mean() - 1 / 25) < 0.01
    assert np.bincount(a).min() > 0.8 * len(keys) / 24


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows, slots = op8_jump_sharding(spark, d).collect(), defaultdict(list)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (jump_one(r.doc_id, 24), jump_one(r.doc_id, 25))
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_edges(spark):
    rows = [(None, None, 1), (None, "", 2), (3, "é", 3), (3, "é", 3), (4, "x" * 100000, 4)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int")).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5
    assert sorted(r["size"] for r in got) == [8, 8, 10, 10, 100008]
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "t", i, i, i) for i in range(50)], "key long, shard string, size int, part int, rank int")
    rows = shard_documents(docs, 7, key="key", text="shard").collect()
    assert sorted(r.key for r in rows) == list(range(50)) and all(r.shard == jump_one(r.key, 7) and r.size == 9 for r in rows)
