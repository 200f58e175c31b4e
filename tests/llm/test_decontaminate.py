import random
import re

import numpy as np

from orrery.llm.decontaminate import PART, Settings, _part, _sum_binary, best_match, cells, contamination, decontamination_stage, filled, frequencies, lcs, leaks, op4_decontaminate, row_sums, segments, singular_basis, weights, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lcs_slow(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def brute(texts, items, s=Settings()):
    """All windows of all documents against all items."""
    out = set()
    for d, t in texts.items():
        w = WORD.findall((t or "").lower())
        for i, x in items.items():
            p = WORD.findall((x or "").lower())
            m, best = len(p), (0, 0)
            if not m:
                continue
            if m < s.least_words:
                if any(w[b : b + m] == p for b in range(len(w))):
                    out.add((d, i))
                continue
            width = m + m // 4 + 2
            for b in range(max(1, len(w) - width + 1)):
                text = w[b : b + width]
                if len(set(p) & set(text)) >= 3:
                    best = max(best, (lcs(p, text), lcs(p[-s.answer_words :], text)))  # equal to the table, see below
            if leaks(*best, m, s):
                out.add((d, i))
    return out


def test_lcs_equals_the_table():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(n))] for n in (90, 140))
        assert lcs(a, b) == lcs_slow(a, b)


def test_planted_leaks(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(prose(rng.randrange(15, 70))) for i in range(12)} | {50: "of the", 51: None, 52: "", 53: "zebra", 54: "in to and to in"}
    texts, planted = {}, set()
    for d in range(144):
        w = prose(rng.choice([3, 40, 150, 400]))
        if d % 6 == 0:
            i = d // 6 % 12
            x, kind = items[i].split(), d // 6 % 3
            if kind == 1:  # some words replaced, the case changed
                x = [y.upper() if rng.random() < 0.9 else rng.choice(vocabulary) for y in x]
            elif kind == 2:  # words put in between
                x = [z for y in x for z in ((y, "so") if rng.random() < 0.1 else (y,))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
            planted.add((d, i))
        texts[d] = " ".join(w)
    texts |= {900: None, 901: "", 902: ", ;", 903: "é" * 9000, 904: " ".join(prose(30000)) + " " + items[3]}
    planted.add((904, 3))
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts.items()] + [(0, texts[0], "again")], "doc_id long, text string, item string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination(docs, bench).collect()}
    del texts[904]
    want = brute(texts, items)
    assert planted <= got and {x for x in got if x[0] != 904} == want and any(i == 50 for _, i in want)
    bench = bench.filter("item_id < 50 or text is null or text = ''")
    got = {x for x in got if x[1] < 50}
    kept = decontamination_stage(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == (set(texts) | {904}) - {d for d, _ in planted}
    blocks = {(r.doc_id, r.item_id) for r in contamination(docs, bench, settings=Settings(block=5)).collect()}
    assert blocks == got


def test_basis_is_the_leading_row_space(spark):
    rng = np.random.default_rng(1)
    s = Settings(buckets=64, rank=6, extra=10, passage=8, common=1.0)
    latent = rng.integers(0, 64, (6, 5))
    rows = [(i, np.concatenate([rng.choice(latent[rng.integers(6)], 8) for _ in range(12)]).astype(np.uint32).tobytes()) for i in range(40)]
    words = spark.createDataFrame(rows, "doc long, words binary")
    df, n = frequencies(words, s)
    idf = weights(df, n, s)
    basis = singular_basis(words, idf, s)
    a = []
    for _, raw in rows:
        w = np.frombuffer(raw, np.uint32)
        for b in segments(np.array([0, len(w)]), 8):
            x = np.bincount(w[b : b + 8], minlength=64) * idf
            a.append(x / max(np.sqrt((idf[w[b : b + 8] % 64] ** 2).sum()), 1e-9))
    _, value, v = np.linalg.svd(np.array(a), full_matrices=False)
    exact = v[:6].T / value[:6]
    assert np.allclose(np.abs(basis[:, :3]), np.abs(exact[:, :3]), atol=0.05)
    table = rng.standard_normal((64, 3)).astype(np.float32)
    w = np.frombuffer(rows[0][1], np.uint32)
    starts = np.array([0, 10, 10, 20, 50])
    want = [table[w[x:y] % 64].sum(axis=0) for x, y in zip(starts, [*starts[1:], 96], strict=True)]
    assert np.allclose(row_sums(cells(w, starts, 50, 64), filled(table), 100), want, atol=1e-4)


def test_words():
    raw = "Ab ÉÀ×é_x".encode()
    h, to = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    low = "ab éà×é x".encode()
    assert h.tolist() == word_hashes(np.frombuffer(low, np.uint8), np.array([0, len(low)]))[0].tolist() and to.tolist() == [0, 3]


def test_query_and_no_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in op4_decontaminate(spark, d).collect()}
    norm = lambda t: " " + " ".join(WORD.findall(t.lower())) + " "
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    whole = {(r.doc_id, i) for r in spark.read.parquet(f"{d}/documents.parquet").collect() for i, x in items.items() if x in norm(r.text or "")}
    assert whole and whole <= got and len(got) <= len(whole) + 2
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    assert contamination(docs.limit(0), bench).count() == 0 and contamination(docs, bench.limit(0)).count() == 0


def all_windows(texts, items, s=Settings()):
    """As ``brute``, with the rule applied to every window; windows that hold too few of the item's words are left out."""
    out = set()
    for i, p in items.items():
        m, inside = len(p), set(p)
        width = m + m // 4 + 2
        for d, w in texts.items():
            to = np.concatenate([[0], np.cumsum([x in inside for x in w])])
            for b in range(max(1, len(w) - width + 1)):
                if to[min(b + width, len(w))] - to[b] >= s.least * m and leaks(lcs(p, w[b : b + width]), lcs(p[-s.answer_words :], w[b : b + width]), m, s):
                    out.add((d, i))
                    break
    return out


def edited(rng, words, share):
    return [rng.choice(words) if rng.random() < share else x for x in words]


def test_items_of_any_length_are_found(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(3000)]
    common = ["the", "of", "and", "to", "in"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    lengths = [8] * 24 + [15] * 12 + [600] * 3 + [1400] * 3
    items = {i: prose(m) for i, m in enumerate(lengths)}
    texts = {}
    for share in (0.0, 0.2):
        for i, x in items.items():
            w = prose(300)
            w[140:140] = edited(rng, x, share)
            texts[len(texts)] = w
    want = all_windows(texts, items)
    assert {(d, i) for d, i in enumerate(items)} <= want and len(want) > 1.8 * len(items)
    docs, bench = (spark.createDataFrame([(i, " ".join(x)) for i, x in rows.items()], f"{key} long, text string") for rows, key in ((texts, "doc_id"), (items, "item_id")))
    rows = contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and all(-1 <= r.cosine <= 1.001 for r in rows)


def test_every_window_is_judged(spark):
    rng = random.Random(9)
    item, other = [f"w{i}" for i in range(40)], lambda n: ["x" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    most = item[:26] + other(14)  # 65 % without the answer
    answered = [x for i, x in enumerate(item) if i % 7 in (0, 2, 4) or i >= 32]  # fewer words, with the answer
    texts = {0: most + other(200) + answered, 1: answered + other(90) + most, 2: most + other(200), 3: other(300)}
    s = Settings()
    assert 0.5 * 40 <= len(answered) < 26 and all_windows(texts, {7: item}) == {(0, 7), (1, 7)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    rows = contamination(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in rows} == {0, 1} and all((r.common, r.answer_common) == (len(answered), 8) for r in rows)
    assert best_match(list(range(40)), np.arange(100, 300).astype(np.uint32), 0, 200, s) == (0, 0)


def test_long_documents_and_common_words(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(20000)]
    common = ["the", "of", "and", "to", "in"]
    items = {i: [rng.choice(vocabulary) for _ in range(24)] for i in range(8)} | {8: [rng.choice(common) for _ in range(24)]}
    texts = {d: [rng.choice(common) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(16000)] for d in range(9)}
    for d, w in texts.items():
        w[9000:9000] = items[d]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    rows = contamination(docs, spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")).collect()
    assert {(d, d) for d in texts} <= {(r.doc_id, r.item_id) for r in rows} and {(r.doc_id, r.item_id) for r in rows} == all_windows(texts, items)
    s = Settings()
    hashed = spark.createDataFrame([(d, word_hashes(np.frombuffer(raw := " ".join(w).encode(), np.uint8), np.array([0, len(raw)]))[0].tobytes()) for d, w in texts.items()], "doc long, words binary")
    df, n = frequencies(hashed, s)
    used = df > 0
    assert n == sum(-(-len(w) // s.passage) for w in texts.values()) and (weights(df, n, s)[used] > 0).mean() > 0.99


def test_sums_of_many_tasks(spark):
    def run(batches):
        n = sum(b.num_rows for b in batches)
        for i in range(3):
            yield _part(i, np.full(4, n * (i + 1.0)))

    frame = spark.range(500, numPartitions=70)
    got = _sum_binary(frame.mapInArrow(run, PART), 3, 70, 4)
    assert got.tolist() == [500.0] * 4 + [1000.0] * 4 + [1500.0] * 4


def test_clashing_names(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, text, 5, 6), (2, "nothing here", 5, 6), (None, "x", 5, 6)], "doc_id long, text string, drop int, _drop int")
    bench = spark.createDataFrame([(1, text), (1, text)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r["drop"], r["_drop"]) for r in decontamination_stage(docs, bench).collect()) == [(0, 5, 6), (2, 5, 6)]
    assert contamination(docs, bench).count() == 1
