import random
import re

import numpy as np

from orrery.llm.license_scan import BASE, NOTICES, notices, op9_license_scan, pigeonhole, scan, scan_block

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places = WORD.findall(low), []
    for label, phrase in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [x[0] for x in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x[1] for x in places}))


CASES = [
    None, "", "   ", "MIT License", "the mit-license\nand Mit LICENSE", "permit license", "mit licenses", "Apache\tLicense, é mit license é",
    "GNU General Public License general public license", "mit licence here", "mit license " * 50, "x" * 5000, "mit", "license",
    "Permission is herebye granted, free of charge, to any persom obtaining a copy", "é", "\x00mit\x00license\x00", "apache  licens version",
]


def test_base_equals_brute_force(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(CASES)], "doc_id long, text string, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_license_scan(spark, str(tmp_path)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(CASES[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_fuzzy_spans(spark):
    rows = {r.doc_id: r for r in scan(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")).collect()}
    near = {s.label: s for s in rows[9].spans}
    assert near["near-mit"].edits == 1 and CASES[9].encode()[near["near-mit"].start : near["near-mit"].end] == b"mit licence"
    assert any(s.label == "mit-grant" and 0 < s.edits <= 6 for s in rows[14].spans)
    assert not rows[13].spans and not rows[0].spans


def test_corpus(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op9_license_scan(spark, d).collect()
    assert len(got) == len(texts)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]) for r in got)


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_notice_is_found_within_its_edits():
    rng, search = random.Random(4), notices()
    for label, (phrase, edits) in NOTICES.items():
        assert b"".join(p for _, p in pigeonhole(phrase.encode(), edits)) == phrase.encode()
        for _ in range(12):
            t = list(phrase)
            for _ in range(rng.randrange(edits + 1)):
                i, kind = rng.randrange(1, len(t) - 1), rng.randrange(3)
                if t[i] == " ":
                    continue
                if kind == 0:
                    t[i] = "z"
                elif kind == 1:
                    t.insert(i, "q")
                else:
                    del t[i]
            texts = ["before it", "words " * rng.randrange(9) + "".join(t).title() + ", " + "more " * rng.randrange(9), ""]
            raw = [x.encode() for x in texts]
            _, spans = scan_block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), search)
            mine = [s for s in spans[1] if s[0] == label]
            assert mine and mine[0][4] <= edits and not spans[0] and not spans[2], (label, texts[1])
            assert texts[1].encode()[mine[0][1] : mine[0][2]].strip()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_spans(text, phrase, edits):
    """(edits, start, end) of the reported runs of words, from a table of edit distances over all runs."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    found = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            body = b" ".join(low[a:b] for a, b in words[i : j + 1])
            if len(body) > len(phrase) + edits:
                break
            if len(body) >= len(phrase) - edits and (d := edit_distance(body, phrase.encode())) <= edits:
                found.append((d, i, j))
    kept = []
    for d, i, j in sorted(found):
        if all(j < a or b < i for _, a, b in kept):
            kept.append((d, i, j))
    return sorted((words[i][0], words[j][1], d) for d, i, j in kept)


def spans_of_texts(texts):
    raw = [x.encode() for x in texts]
    return scan_block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), notices())[1]


def test_spans_equal_brute_force():
    rng = random.Random(11)
    glue = ["", "s", "x", "the", "license", "mit", "general", "public", "all", "ä", "permit", "generals", "is"]

    def mutated(phrase):
        t = list(phrase)
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(2)] = rng.choice(["", "q", " ", "é", "ee"])
        return "".join(t)

    texts = []
    for _ in range(150):
        parts = [x for _ in range(rng.randrange(5)) for x in (mutated(rng.choice(list(NOTICES.values()))[0]), rng.choice(glue))]
        texts.append(rng.choice(["\n", " ", ", "]).join(parts))
    texts += ["mission is hereby granted free of charge to any person obtaining a copy", "", "permission is hereby granted free of charge to any person obtaining a", "mit licence mit license", "mt license mit licens", "apache licens apache license"]
    for text, spans in zip(texts, spans_of_texts(texts), strict=True):
        for label, (phrase, edits) in NOTICES.items():
            assert sorted((s[1], s[2], s[4]) for s in spans if s[0] == label) == brute_spans(text, phrase, edits), (label, text)


def test_words_are_whole():
    for spans in spans_of_texts(["submit license", "permit licenses", "the summit licensed", "emit licence", "mitlicense mitlicense x"]):
        assert [s for s in spans if s[0] == "near-mit"] == [] or spans[0][4] == 1
    assert spans_of_texts(["submit license", "permit licenses", "the summit licensed"]) == [[], [], []]
    assert [s[4] for s in spans_of_texts(["mitlicense"])[0]] == [1]


def test_a_text_depends_on_itself_only(spark):
    texts = [None, "", "mit licence " * 3000, "mit licence " * 3000, "x " * 400_000 + "apache licens"]
    rows = [(k, t) for k, t in zip([1, None, 2, 2, None], texts, strict=True)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 5 and sorted(len(r.spans) for r in got) == [0, 0, 1, 3000, 3000]
    assert [s.edits for r in got if len(r.spans) == 1 for s in r.spans] == [1]
