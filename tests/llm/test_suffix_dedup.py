import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import suffix_dedup
from orrery.llm.deep_shallow import multikey_quicksort, neighbour_lcp, sort_strings, words_of
from orrery.llm.suffix_dedup import Settings, cut_repeats, op10_suffix_dedup, repeats_stage, spans_of


def brute(texts, length=100):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), n_spans, kept)
    return out


def test_deep_shallow_order():
    rng = random.Random(1)
    for _ in range(150):
        base, strings, groups = bytes(rng.choices(b"ab\0", k=100)), [], []
        for _ in range(rng.randrange(1, 60)):
            s = bytearray(base[: rng.randrange(0, 101)])
            for _ in range(rng.randrange(3)):
                if s:
                    s[rng.randrange(len(s))] = rng.choice(b"abc")
            strings.append(bytes(s))
            groups.append(rng.randrange(3))
        lengths, groups = np.array([len(s) for s in strings]), np.array(groups)
        data, starts = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths
        words, full = words_of(data, starts, lengths, 13), [s + bytes(104 - len(s)) for s in strings]
        order = sort_strings(words, groups, rng.choice([1, 2, 4]))
        assert order.tolist() == sorted(range(len(strings)), key=lambda i: (groups[i], full[i], i))
        lcp = neighbour_lcp(words, order, groups)
        for k in range(1, len(order)):
            a, b = order[k - 1], order[k]
            assert lcp[k] == (-1 if groups[a] != groups[b] else next((j for j in range(104) if full[a][j] != full[b][j]), 104))
        back = words_of(data, starts + lengths, lengths, 13, True)
        assert all(back[i].astype(">u8").tobytes()[: lengths[i]] == s[::-1] for i, s in enumerate(strings))


def test_spans():
    a = np.array
    assert [x.tolist() for x in spans_of(a([2, 1, 1, 1, 2]), a([5, 0, 3, 9, 0]), a([9, 4, 7, 12, 30]))] == [[1, 1, 2], [0, 9, 0], [7, 12, 30]]


def random_texts(rng, n, alphabet, most):
    pool = ["".join(rng.choices(alphabet, k=rng.randrange(1, most))) for _ in range(4)]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(pool)[rng.randrange(5) :] if rng.random() < 0.6 else "".join(rng.choices(alphabet, k=rng.randrange(most))) for _ in range(rng.randrange(5)))
        out.append(t)
    return out


@pytest.mark.parametrize("case", range(4))
def test_equals_brute_force(spark, case):
    rng = random.Random(case)
    settings = [Settings(12, 8), Settings(16, 8, flush=50, hot=2, part=8, held=9), Settings(20, 11, flush=400, hot=3, part=5, spread=9), Settings(9, 9, hot=1, part=2, held=4, spread=5)][case]
    texts = dict(enumerate(random_texts(rng, 120, ["ab", "abcdeé", "abc😀ß", "ab "][case], 60)))
    texts |= {500: None, 501: "", 502: "a" * 300, 503: "ab" * 200, -4: "ab" * 30}
    rows = list(texts.items())
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, doc string, lo int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) for r in cut_repeats(docs, settings=settings).collect()}
    assert got == brute(texts, settings.length)


def test_long_documents_in_units(spark):
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh", k=3000))
    texts = {1: base + "-" + base[100:2500], 2: base[:40], 3: "z" * 1500, 4: base[900:1700]}
    s = Settings(32, 8, unit=700)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) for r in cut_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), settings=s).collect()}
    assert got == brute(texts, 32)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = brute({r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op10_suffix_dedup(spark, d).collect()}
    assert got == {k: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for k, v in want.items()}


def test_nulls_repeated_rows_and_whole_characters(spark):
    t = "é" * 80 + "0123456789" * 12
    rows = [(None, t), (None, t), (1, t), (1, t), (2, t), (3, "😀" * 60), (4, "x" + "😀" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in cut_repeats(docs).collect()), key=str)
    one = brute({1: t})[1][1]
    assert got == sorted([(None, 0), (None, 0), (1, one), (1, one), (2, len(t.encode())), (3, 236), (4, 240)], key=str)
    whole = cut_repeats(docs, whole_characters=True).withColumn("back", F.col("kept").cast("string").cast("binary"))
    assert all(bytes(r.kept) == bytes(r.back) for r in whole.collect())
    assert cut_repeats(docs.limit(0)).count() == 0


def test_hashes_that_collide_remove_nothing(spark, monkeypatch):
    rng, real = random.Random(21), suffix_dedup.hash_spans
    monkeypatch.setattr(suffix_dedup, "hash_spans", lambda data, starts, ends: real(data, starts, ends) & np.uint64(1))
    texts = dict(enumerate(random_texts(rng, 60, "abcd", 40))) | {100: "ab" * 50}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for settings in (Settings(12, 8), Settings(12, 8, flush=60, hot=2, part=7, held=11)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) for r in cut_repeats(docs, settings=settings).collect()}
        assert got == brute(texts, settings.length)


def test_many_copies_and_one_frequent_gram(spark):
    """A passage that all documents share, and one of less than the length amid different bytes."""
    rng = random.Random(8)
    passage, gram = "".join(rng.choices("abcdefgh", k=90)), "".join(rng.choices("xyz", k=25))
    word = lambda n: "".join(rng.choices("mnopqrst", k=n))
    texts = {i: word(rng.randrange(30)) + passage + word(40) + gram + word(40) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    settings = Settings(40, 16, flush=120, hot=5, part=20, held=30)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) for r in cut_repeats(docs, settings=settings).collect()}
    assert got == brute(texts, 40)


def test_multikey_quicksort_splits_equal_and_adverse_keys():
    for keys in (np.arange(3000), np.arange(3000)[::-1], np.zeros(3000, int), np.arange(3000) % 2, np.minimum(np.arange(3000), 5)):
        words = np.stack([keys, keys[::-1]], axis=1).astype(np.uint64)
        order, deep = multikey_quicksort(words, np.zeros(len(keys), np.int64), 2)
        assert order.tolist() == sorted(range(len(keys)), key=lambda i: (words[i, 0], words[i, 1], i))
        assert all((words[order[a:b]] == words[order[a]]).all() and b - a > 1 for a, b in deep)


def test_clashing_names_and_keys(spark):
    t = "0123456789" * 30
    docs = spark.createDataFrame([(i, t, i, "s", 7, 8, 300) for i in range(3)], "doc_id long, text string, of int, spans string, n_bytes int, kept int, n_chars long")
    assert sorted(map(tuple, repeats_stage(docs).collect()))[0][2:6] == (0, "s", 7, 8)
    with pytest.raises(TypeError):
        cut_repeats(spark.createDataFrame([("a", t)], "doc_id string, text string"))
