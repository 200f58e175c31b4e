from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orrery.llm.token_counts import attribute, op3_token_counts, sections, token_counts

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(text, cuts, rule):
    out = [0.0] * len(cuts)
    if not text:
        return out
    for a, b in HF.encode(text, add_special_tokens=False).offsets:
        held = [max(0, min(b, e) - max(a, s)) for s, e in cuts]
        if rule == "start":
            out[next(i for i, (s, e) in enumerate(cuts) if s <= a < e)] += 1
        elif rule == "most":
            out[max(range(len(cuts)), key=lambda i: (held[i], -i))] += 1
        else:
            for i, h in enumerate(held):
                out[i] += h / (b - a)
    return out


TEXTS = [None, "", "one line", "two\nlines", "a\n\n\n\nb\n", "\n\n  \n x", "é日本\n😀😀\nß", "x" * 3000 + "\n" + "word " * 2000, "tail \n\n"]


@pytest.mark.parametrize("rule", ["start", "most", "share"])
def test_rules_equal_brute_force(spark, rule):
    docs = spark.createDataFrame([(i, t, f"s{i}", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, section int")
    for fields in (("text",), ("source", "text")):
        got = defaultdict(list)
        for r in token_counts(docs, fields=fields, rule=rule).orderBy("doc_id", "section").collect():
            got[r.doc_id].append(r)
        for i, t in enumerate(TEXTS):
            whole = "\n".join((t or "") if f == "text" else f"s{i}" for f in fields)
            cuts = [(r.char_start, r.char_end) for r in got[i]]
            assert cuts[0][0] == 0 and cuts[-1][1] == len(whole) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
            assert [r.n_tokens for r in got[i]] == pytest.approx(brute(whole, cuts, rule)), (i, fields)


def test_sections():
    assert sections(["a\nb\n"], True) == [(0, 0, 2), (0, 2, 4)]
    assert sections([None], True) == [(0, 0, 0)]
    assert sections(["t", None, "x\ny"], False) == [(0, 0, 2), (1, 2, 3), (2, 3, 6)]
    counts, crossing = attribute(np.array([0, 2]), np.array([2, 5]), np.array([0, 3]), "most")
    assert counts.tolist() == [1, 1] and crossing.tolist() == [1, 0]
    with pytest.raises(ValueError):
        attribute(np.array([0]), np.array([1]), np.array([0]), "none")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    total = defaultdict(int)
    for r in op3_token_counts(spark, d).collect():
        total[r.doc_id] += r.n_tokens
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert total == {k: len(HF.encode(t, add_special_tokens=False).ids) for k, t in texts.items()}
    assert token_counts(spark.read.parquet(f"{d}/documents.parquet").limit(0)).count() == 0
