import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrery.llm.packing import linear_groups, op2_pack_sequences, pack, plan, sequences
from orrery.llm.tokens import TextEncoder, encoder


def filled(histogram, capacity=1024):
    used, got = defaultdict(list), Counter()
    for length, rank, count, first, offset in plan(histogram, capacity):
        assert rank == got[length]
        got[length] += count
        for s in range(first, first + count):
            used[s].append((offset, length))
    assert got == Counter(histogram)
    for x in used.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=200))
def test_plans_are_whole_and_gapless(lengths):
    n = filled(dict(Counter(lengths)))
    assert n >= -(-sum(lengths) // 1024)


def test_few_sequences():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(5.8, 0.8, 20000), 1, 1024).astype(int).tolist()
    bins = []
    for v in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + v <= 1024:
                bins[i] += v
                break
        else:
            bins.append(v)
    h = dict(Counter(lengths))
    assert sequences(plan(h)) <= len(bins) and sequences(plan(h)) <= 1.01 * sum(lengths) / 1024
    assert filled({700: 3}) == 3 and filled({512: 7}) == 4 and filled({}) == 0


def test_groups_have_equal_cardinality():
    groups = linear_groups({900: 5, 800: 50, 700: 1, 300: 44}, 10)
    assert [sum(c for _, c in g) for g in groups] == [10] * 10
    with pytest.raises(ValueError):
        plan({1025: 1})


def check(texts, rows):
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        got[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids = hf.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = [got[d][i] for i in range(len(got[d]))]
        assert sum(p.length for p in pieces) == len(ids) and all(p.length == 1024 for p in pieces[1:])
        assert len(pieces) == max(1, -(-len(ids) // 1024))
        at = 0
        for p in pieces:
            assert (p.start, p.ids_crc32) == (at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            at += p.length
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = op2_pack_sequences(spark, d).collect()
    n = check({r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}, rows)
    assert n <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_edges(spark):
    rng = random.Random(0)
    texts = [None, "", "a", "a", " ".join(str(rng.random()) for _ in range(4000)), "日本語 <|endoftext|> ok", "x\x1c\x85 y　 z", "don't  \t x’s\r\n\r\n end  "]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in enumerate(texts)], "doc_id long, text string, part int, rank string")
    check(dict(enumerate(texts)), pack(docs).collect())
    assert pack(docs.limit(0)).count() == 0


def test_encoder_equals_the_library():
    e = encoder()
    rng = random.Random(5)
    alphabet = list("aeS 'tn\n\t.,1’é…-_ ß") + ["'ll", "  ", "\n\n", "the"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(400)]
    assert e.words is not None
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert e.token_bytes()[ids].sum() == len(t.encode())
    other = TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert other.words is None and other.one("Hello there").tolist() == other.tokenizer.encode("Hello there", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeS 'tsln\n\t.,1’é…-_ß<|¼ªº²\x0b\xa0", max_size=120))
def test_any_text_has_the_ids_of_the_library(text):
    e = encoder()
    assert e.one(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", "!", "\u2003"])
def test_long_runs(unit):
    e = encoder()
    text = unit * 2_000_000 + "b"
    ids = e.one(text)
    assert np.array_equal(ids, e.tokenizer.encode(text, add_special_tokens=False).ids)


def test_packs_a_text_with_a_long_run(spark):
    docs = spark.createDataFrame([(0, " " * 1_500_000 + "x"), (1, "words " * 60_000)], "doc_id long, text string")
    check({r.doc_id: r.text for r in docs.collect()}, pack(docs).collect())


def test_words_that_are_not_remembered(monkeypatch):
    monkeypatch.setattr("orrery.llm.tokens.REMEMBERED", 3)
    e = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "one two three four five one two " * 3
    assert e.one(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids and len(e.known) == 3
