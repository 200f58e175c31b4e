import importlib

import corpus_pipeline
from pyspark.sql import functions as F

from orrery.llm.language_id import train
from tests.llm.test_decontaminate import WORD, all_windows
from tests.llm.test_language_id import slow_probabilities
from tests.llm.test_near_dedup import brute as brute_near
from tests.llm.test_packing import check as check_packed

D = "/root/testdata/sf0.001"


def brute_cut(texts, length=200):
    """Texts without repeated strings; spans give up bytes rather than cut a character."""
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        i = 0
        while i < len(b):
            j = i + 1
            while j < len(b) and (b[j] & 0xC0) == 0x80:
                j += 1
            if not all(gone[i:j]):
                gone[i:j] = bytes(j - i)
            i = j
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
    return out


def test_each_stage_on_its_own_input(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "decontaminate", "best_fit_packing"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D).persist()
        rows = docs.collect()
        if name == "best_fit_packing":
            check_packed(texts, rows)
            break
        after = {r.doc_id: r.text for r in rows}
        assert docs.columns == columns and len(after) == len(rows) and set(after) <= set(texts)
        if name == "language_id":
            net = train(spark.read.parquet(f"{D}/documents.parquet"))
            share = {d: slow_probabilities(net, t).max() if any(c.isalpha() for c in t or "") else 0.0 for d, t in texts.items()}
            chance = 1 / len(net.labels)
            least = {d: chance + (1 - chance) * 0.4 * min(1, len((t or "").encode()) / 400) for d, t in texts.items()}
            sure = {d for d in texts if abs(share[d] - least[d]) > 1e-3}
            assert set(after) & sure == {d for d in sure if share[d] >= least[d]} and len(sure) > 0.95 * len(texts)
            assert len(after) >= 0.95 * len(texts)
        elif name == "near_dedup":
            assert after == {d: texts[d] for d, x in brute_near(texts, 5).items() if x[2]}
        elif name == "suffix_dedup":
            want = {d: t for d, t in brute_cut(texts).items() if t or not texts[d]}
            assert after == want and all(r.n_chars == len(r.text) for r in rows if r.text != texts[r.doc_id])
        else:
            items = {r.item_id: WORD.findall((r.text or "").lower()) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
            leaking = {d for d, _ in all_windows({d: WORD.findall((t or "").lower()) for d, t in texts.items()}, items)}
            assert after == {d: t for d, t in texts.items() if d not in leaking}
        texts = after
    whole = corpus_pipeline.run(spark, D).agg(F.count("*"), F.countDistinct("doc_id")).first()
    assert tuple(whole) == (len(rows), len(texts))


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} >= {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= names


def test_odd_rows_end_to_end(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    prose = "the thing and the other of it was with them for all of that and more "
    rows = [(i, prose * 3 + f"number {i} stands here", "en", "s", 10, i, "x") for i in range(40)]
    rows += [(100, None, "en", None, None, 1, None), (101, "", None, "s", 0, 1, None), (102, "12 34", "en", "s", 5, 1, None), (103, prose * 3 + "number 3 stands here", "en", "s", 1, 1, None)]
    rows += [(104, prose + item, "en", "s", 1, 1, None), (105, "the way " * 60_000, "en", "s", 1, 1, None), (105, "the way " * 60_000, "en", "s", 1, 1, None), (None, prose + "of a row without a key", "en", "s", 1, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, drop int, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
    kept = {r.doc_id for r in left.collect()}
    assert not kept & {100, 101, 102, 103, 104} and {0, None} <= kept
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept
    none = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
