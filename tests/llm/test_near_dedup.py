import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm.graph import components
from orrery.llm.near_dedup import Settings, cells, dedup_stage, least_matches, near_duplicates, op1_minhash_dedup, sequential_test

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(texts, width):
    sets, at = {d: shingles(t, width) for d, t in texts.items()}, defaultdict(list)
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets):
        near = defaultdict(int)
        for s in sets[d]:
            for other in at[s]:
                near[other] += 1
            at[s].append(d)
        for other, c in near.items():
            if 100 * c >= 80 * (len(sets[d]) + len(sets[other]) - c):
                a, b = sorted((root(d), root(other)))
                parent[b] = a
    return {d: (len(sets[d]), root(d), root(d) == d) for d in texts}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op1_minhash_dedup(spark, d).collect()}
    assert got == brute({r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}, 4)


def variants():
    """A chain of small edits, stars of edits around bases, exact copies."""
    rng, out = random.Random(3), []
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    for base in range(4):
        words = [word() for _ in range(120)]
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randrange(1, 9)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        for _ in range(15):
            words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
        out += [" ".join(words)] * 10
    return out


def test_edits_and_chains(spark):
    texts = dict(enumerate(variants() + [None, "", " \n\t ", "one", "One", "two words", "a b c", "a b c d", "A b\tc d", "x" * 40000, "x y " * 9000, "x y " * 8000]))
    rows = [(d, t, d, "s", 1) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, sig string, component_id int")
    for width, block, members in ((4, 400_000, 1024), (5, 1500, 1024), (4, 400_000, 3)):
        got = {r.doc: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, settings=Settings(width=width, block=block, members=members)).collect()}
        assert got == brute(texts, width)
    left = dedup_stage(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, x in brute(texts, 5).items() if x[2]}


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].kept


def test_sequential_test_keeps_similar_pairs():
    rng, s = np.random.default_rng(1), Settings()
    for j, least, most in ((0.8, 0.999, 1), (0.95, 1, 1), (0.4, 0, 0.01)):
        a = rng.integers(0, 256, (4000, 128)).astype(np.uint8)
        b = np.where(rng.random(a.shape) < j, a, rng.integers(0, 256, a.shape)).astype(np.uint8)
        assert least <= sequential_test(a, b, s).mean() <= most
    assert all(m < 0.8 * n for n, m in least_matches(s))


@pytest.mark.parametrize("edges", [[], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 49), (None, 3)]])
def test_components(spark, edges):
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a is not None:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_a_bucket_with_one_large_component_is_dealt_once(spark):
    rows = [(5, 0, i, 1 if i else 0, 10) for i in range(5001)] + [(6, 1, i, i % 2, 10) for i in range(400)]
    docs = spark.createDataFrame(rows, "band long, slot int, doc long, component long, n long")
    dealt = cells(docs, Settings(members=100), lambda df, name: df).collect()
    hot = [r for r in dealt if r.band == 5]
    assert len(hot) == 5001 + 50 and len({(r.p, r.q) for r in hot}) == 51
    # every pair with a row outside meets exactly once
    met = Counter()
    by = defaultdict(list)
    for r in dealt:
        by[r.band, r.p, r.q].append(r)
    for x in by.values():
        for v in x:
            for h in x:
                if v.visitor and h.home and v.doc != h.doc and (h.inside or v.doc > h.doc):
                    met[(v.band, *sorted((v.doc, h.doc)))] += 1
    inside = {(r.band, r.doc): r.inside for r in dealt}
    want = {(b, x, y) for b, n in ((5, 5001), (6, 400)) for x in range(n) for y in range(x) if not (inside[b, x] and inside[b, y])}
    assert set(met) == {(b, y, x) for b, x, y in want} and set(met.values()) == {1}
    assert max(map(len, by.values())) < 450


def test_keys_are_integers(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    with pytest.raises(TypeError):
        near_duplicates(docs)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "one two three four five six", i, i) for i in range(3)], "doc_id long, text string, drop int, _drop int")
    assert sorted(map(tuple, dedup_stage(docs).collect())) == [(0, "one two three four five six", 0, 0)]
