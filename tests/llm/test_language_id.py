import random
import zlib

import numpy as np
import pytest

from orrery.llm.language_id import Network, Training, language_stage, op5_language_id, predict, train, windows_of

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_gradients_equal_differences():
    net, rng = Network(["a", "b", "c"], 7, 3, 1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(97, 123, (5, 7)).astype(np.int16)
    x[0, 4:] = 256
    y, w = np.array([0, 1, 2, 1, 0]), np.array([1.0, 2, 1, 1, 0.5])
    _, g = net.gradients(x, y, w)
    for k, v in net.p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in v.shape)
            if k[0] == "e":
                i = (i[0], int(x[1, 2]), i[2])
            old, e, loss = v[i], 1e-3, []
            for sign in (1, -1):
                v[i] = old + sign * e
                loss.append(net.gradients(x, y, w)[0])
            v[i] = old
            assert (loss[0] - loss[1]) / (2 * e) == pytest.approx(g[k][i], abs=2e-5), (k, i)


def test_windows_hold_every_byte_once():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    x, owner = windows_of(data, np.array([0, 0, 7, 7, 10]), 4)
    assert owner.tolist() == [1, 1, 3] and bytes(x[x < 256].astype(np.uint8)) == b"abcdefghij"


def test_pooled_equals_a_plain_loop():
    net = Network(["a", "b"], 5, 4, 3)
    p, x = {k: v.astype(np.float64) for k, v in net.p.items()}, np.array([[97, 46, 98, 200, 256], [65, 97, 97, 97, 10]], np.int16)
    sums, letters = net.pooled(x)
    logistic = lambda a: 1 / (1 + np.exp(-2 * a))
    for i, row in enumerate(x):
        score = np.tile(p["bo"], (5, 1))
        for d in (0, 1):
            h = np.zeros(4)
            for t in range(5) if d == 0 else range(4, -1, -1):
                z, r = (logistic(p[f"e{k}"][d, row[t]] + h @ p[f"u{k}"][d]) for k in "zr")
                c = np.tanh(p["en"][d, row[t]] + r * (h @ p["un"][d] + p["bn"][d, 0]))
                h = (1 - z) * c + z * h
                score[t] += h @ p["o"][d]
        prob = np.exp(score) / np.exp(score).sum(axis=1, keepdims=True)
        inside = [t for t in range(5) if row[t] < 256 and (chr(row[t]).isalpha() or row[t] > 127)]
        assert sums[i] == pytest.approx(prob[inside].sum(axis=0), abs=1e-4) and letters[i] == len(inside)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op5_language_id(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [x for x in docs if rows[x.doc_id].held_out and x.lang]
    assert sum(rows[x.doc_id].lang_pred == x.lang for x in held) >= 0.97 * len(held)


def test_edges(spark):
    words = {"en": "the thing with other and shall be ", "fr": "le été où français même garçon "}
    rows = [(i, words[x] * (1 + i % 3), x, None, "s") for i in range(60) for x in words]
    odd = [(900, None, "en", "a", "b"), (901, "", "fr", "a", None), (902, "12 !?\n", "en", "a", "b"), (903, "le été " * 20000, None, "a", "b"), (904, "é", None, "a", "b"), (904, "é", "en", "c", "d"), (None, "the other", "en", "a", "b")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    net = train(docs, t=Training(steps=60))
    got = predict(docs, net).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert [by[i] for i in (900, 901, 902)] == [[("und", 0.0)]] * 3
    assert by[903][0][0] == "fr" and by[904][0] == by[904][1] and len(got) == len(rows) + len(odd)
    assert language_stage(docs).columns == docs.columns
    left = {r.doc_id for r in language_stage(docs).collect()}
    assert not left & {900, 901, 902} and {0, 1, 903} <= left
    blank = spark.createDataFrame([(1, "text", None, None, None)], SCHEMA)
    assert predict(blank, train(blank)).collect()[0].lang_pred == "und"
    assert predict(docs.limit(0), train(docs.limit(0))).count() == 0


def test_unclear_texts_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = {}
    for i in range(40):
        rng = random.Random(i)
        odd[-1 - 3 * i] = "".join(rng.choices("人人生而自由在尊严和权利上一律平等他们赋有理性和良心", k=600))
        odd[-2 - 3 * i] = " ".join(rng.choices("wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw".split(), k=300))
        odd[-3 - 3 * i] = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=2000))
    left = {r.doc_id for r in language_stage(docs.union(spark.createDataFrame([(i, x, None) for i, x in odd.items()], "doc_id long, text string, lang string"))).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.filter("text rlike '[a-z]'").collect()}
    assert len(clean - left) <= 0.005 * len(clean) and len(set(odd) & left) <= 0.75 * len(odd), (len(clean), len(clean - left), len(odd), len(set(odd) & left))
    short = {r.doc_id for r in docs.filter("text rlike '[a-z]' and length(text) < 100").collect()}
    assert short and short <= left


def slow_probabilities(net, text):
    """Means over a text's letters, window by window in double precision."""
    p, raw, total, letters = {k: v.astype(np.float64) for k, v in net.p.items()}, text.encode(), np.zeros(len(net.labels)), 0
    logistic = lambda a: 1 / (1 + np.exp(-2 * a))
    windows = np.full((-(-len(raw) // net.width), net.width), 256)
    windows.ravel()[: len(raw)] = list(raw)
    score = np.tile(p["bo"], (*windows.shape, 1))
    for d in (0, 1):
        h = np.zeros((len(windows), net.hidden))
        for t in range(net.width) if d == 0 else reversed(range(net.width)):
            row = windows[:, t]
            z, r = (logistic(p[f"e{k}"][d, row] + h @ p[f"u{k}"][d]) for k in "zr")
            c = np.tanh(p["en"][d, row] + r * (h @ p["un"][d] + p["bn"][d, 0]))
            h = (1 - z) * c + z * h
            score[:, t] += h @ p["o"][d]
    prob = np.exp(score - score.max(axis=2, keepdims=True))
    prob /= prob.sum(axis=2, keepdims=True)
    inside = (windows < 256) & ((windows >= 128) | ((windows | 32) >= 97) & ((windows | 32) <= 122))
    return prob[inside].sum(axis=0) / max(1, inside.sum())


def test_query_equals_the_slow_network(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = train(docs)
    rows = {r.doc_id: r for r in op5_language_id(spark, d).collect()}
    for x in docs.collect():
        r = rows[x.doc_id]
        if not any(c.isalpha() for c in x.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        mean = slow_probabilities(net, x.text)
        assert r.score == pytest.approx(mean.max(), abs=1e-4)
        if np.sort(mean)[-1] - np.sort(mean)[-2] > 1e-3:
            assert r.lang_pred == net.labels[int(mean.argmax())]


def test_equal_texts_are_equal_to_the_last_bit():
    net = Network(["a", "b", "c"], 96, 8, 3)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abc déf.", k=n)).encode()
    same = [text(1), text(95), text(96), text(97), text(5000), text(400_000)]
    alone = [net.probabilities(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in same]
    for before in (0, 1, 17, 96 * 2047, 96 * 2048, 96 * 2049 + 5):
        texts = [text(before), *same, text(30), *reversed(same)]
        got = net.probabilities(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        for i, want in enumerate(alone):
            assert (got[1 + i] == want[0]).all() and (got[len(texts) - 1 - i] == want[0]).all()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, "the thing and other " * 9, "en", i, True) for i in range(20)], "doc_id long, text string, lang string, _text int, _lettered boolean")
    assert sorted(map(tuple, language_stage(docs).collect())) == sorted(map(tuple, docs.collect()))
