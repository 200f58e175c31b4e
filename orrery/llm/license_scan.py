"""Fuzzy search for short licence notices.

A notice that may differ in at most k edits is cut into k + 1 pieces: by the
pigeonhole principle every occurrence holds at least one piece unchanged.  Exact
search for the pieces gives candidates, each of which the ``regex`` library's
bounded-error matching verifies on its own.

Texts are compared as their lower-cased words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``)
joined by single spaces, so line breaks and punctuation between words don't count.
A match is a run of whole words whose joined form is at most k edits (insertions,
deletions, substitutions of bytes) from the notice: ``submit license`` is no
``mit license``.

Defined results: a null or empty text has no words and no spans.  Of matches of one
notice that overlap, the one with the fewest edits is reported, then the earliest,
then the shortest; matches of different notices are each reported.  The result of a
text depends on nothing but the text; equal rows, null keys included, get equal
results.  Further columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.textops import ALNUM, LOWER, blocks, text_bytes

#: Phrases whose exact places are counted, by label.  Fixed values.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Further notices by label: words and the edits allowed.
NOTICES = {
    "near-mit": ("mit license", 1),
    "near-apache": ("apache license", 2),
    "near-gpl": ("general public license", 3),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy", 6),
    "bsd-terms": ("redistribution and use in source and binary forms with or without modification", 6),
    "apache-grant": ("licensed under the apache license version 2 0", 4),
    "gpl-grant": ("under the terms of the gnu general public license", 4),
    "creative-commons": ("creative commons attribution", 2),
    "mozilla": ("mozilla public license", 2),
    "rights-reserved": ("all rights reserved", 2),
    "spdx": ("spdx license identifier", 2),
    "no-warranty": ("provided as is without warranty of any kind", 4),
}

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("word", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("base", T.BooleanType())])


@dataclass
class Notice:
    label: str
    phrase: str
    edits: int
    base: bool = False
    pieces: list[tuple[int, bytes]] = field(default_factory=list)
    patterns: list = field(default_factory=list)  # by the edits allowed

    def __post_init__(self):
        raw = self.phrase.encode()
        self.pieces = pigeonhole(raw, self.edits)
        if not self.base:
            self.patterns = [regex.compile(b"(?:" + regex.escape(raw) + b"){e<=%d}" % e) for e in range(self.edits + 1)]

    def distance(self, body: bytes, a: int, b: int) -> int | None:
        """The least edits that make body[a:b] the phrase, if those are allowed."""
        found = self.patterns[-1].fullmatch(body, a, b)
        least = sum(found.fuzzy_counts) if found else None
        while least and (found := self.patterns[least - 1].fullmatch(body, a, b)):
            least = sum(found.fuzzy_counts)
        return least


def pigeonhole(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """``edits + 1`` contiguous pieces with their offsets; some piece survives any ``edits`` edits."""
    n = edits + 1
    if n > len(phrase):
        raise ValueError("a notice needs more bytes than edits")
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def notices(base: dict[str, str] = BASE, fuzzy: dict[str, tuple[str, int]] = NOTICES) -> list[Notice]:
    return [Notice(k, p, 0, True) for k, p in base.items()] + [Notice(k, p, e) for k, (p, e) in fuzzy.items()]


def _places(body: bytes, seed: bytes) -> list[int]:
    found, at = [], body.find(seed)
    while at >= 0:
        found.append(at)
        at = body.find(seed, at + 1)
    return found


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every integer of each range [low, high) and the range it is from."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


def word_runs(n: Notice, places: dict[bytes, np.ndarray], begin: np.ndarray, end: np.ndarray, words: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Candidates (first word, last word): runs that a piece stands in, near its place in the phrase, and of a length that the edits allow.

    ``begin`` and ``end`` are the words' places, ``words`` the first word of each document and the end, ``head`` the documents' places.
    """
    size, k, out = len(n.phrase.encode()), n.edits, [np.zeros((0, 2), np.int64)]
    for offset, seed in n.pieces:
        at = places[seed]
        if not len(at):
            continue
        doc = np.searchsorted(head, at, side="right") - 1  # a piece never crosses documents
        low = np.maximum(np.searchsorted(begin, at - offset - k), words[doc])
        high = np.minimum(np.searchsorted(begin, at - offset + k, side="right"), words[doc + 1])
        first, owner = _spread(low, high)
        low = np.maximum(np.searchsorted(end, begin[first] + size - k), first)
        high = np.minimum(np.searchsorted(end, begin[first] + size + k, side="right"), words[doc[owner] + 1])
        last, owner = _spread(low, high)
        out.append(np.stack([first[owner], last], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (edits, first word, last word), those that no better one overlaps, by place."""
    kept: list[tuple[int, int, int]] = []
    for x in sorted(found):
        i = bisect_left(kept, x[1], key=lambda y: y[1])
        if (i == 0 or kept[i - 1][2] < x[1]) and (i == len(kept) or x[2] < kept[i][1]):
            kept.insert(i, x)
    return kept


def scan_block(data: np.ndarray, offsets: np.ndarray, search: list[Notice]) -> tuple[np.ndarray, list[list[tuple]]]:
    """Words of each document, and its spans (label, start, end, word, edits, similarity, base).

    ``start`` and ``end`` are bytes of the document's own text.
    """
    n_docs = len(offsets) - 1
    low = LOWER[data]
    word = ALNUM[low]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = word[starts]
    at = np.flatnonzero(word)
    # words in order, each with one space before it; a document starts with a line feed and ends with a space
    begins = first[at]
    words_to = np.concatenate([[0], np.cumsum(first)])
    n_words = words_to[offsets[1:]] - words_to[offsets[:-1]]
    doc = np.searchsorted(offsets, at, side="right") - 1
    shift = np.cumsum(begins) + 2 * doc + 1
    place = np.arange(len(at)) + shift  # of the word bytes in the joined form
    joined = np.full(len(at) + int(first.sum()) + 2 * n_docs, 0x20, np.uint8)
    joined[place] = low[at]
    letters_to = np.concatenate([[0], np.cumsum(word)])
    head = letters_to[offsets[:-1]] + words_to[offsets[:-1]] + 2 * np.arange(n_docs)  # of each document's line feed
    joined[head] = 0x0A
    body = joined.tobytes()
    word_place = place[begins] if len(at) else at
    spans: list[list[tuple]] = [[] for _ in range(n_docs)]

    def report(n: Notice, d: int, a: int, b: int, edits: int) -> None:
        i = int(np.searchsorted(place, a))
        j = int(np.searchsorted(place, b)) - 1
        if j < i:
            return
        w = int(np.searchsorted(word_place, place[i], side="right")) - 1 - int(words_to[offsets[d]])
        spans[d].append((n.label, int(at[i] - offsets[d]), int(at[j] + 1 - offsets[d]), w, edits, max(0.0, 1.0 - edits / len(n.phrase)), n.base))

    first_word = words_to[offsets]
    word_end = place[np.append(first[at][1:], True)] + 1 if len(at) else at
    hits: dict[bytes, np.ndarray] = {}
    for n in search:
        if n.base:
            for p in _places(body, b" " + n.phrase.encode() + b" "):
                report(n, int(np.searchsorted(head, p, side="right")) - 1, p + 1, p + 1 + len(n.phrase), 0)
            continue
        raw = n.phrase.encode()
        for _, seed in n.pieces:
            if seed not in hits:
                hits[seed] = np.array(_places(body, seed), np.int64)
        found: list[tuple[int, int, int]] = []
        for i, j in word_runs(n, hits, word_place, word_end, first_word, head).tolist():
            a, b = int(word_place[i]), int(word_end[j])
            edits = 0 if body[a:b] == raw else n.distance(body, a, b)
            if edits is not None:
                found.append((edits, i, j))
        for edits, i, j in apart(found):
            report(n, int(np.searchsorted(first_word, i, side="right")) - 1, int(word_place[i]), int(word_end[j]), edits)
    return n_words, spans


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, fuzzy: dict[str, tuple[str, int]] = NOTICES) -> DataFrame:
    """Per row: the key, n_words and the spans found, in order of label table and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, kind = notices(base, fuzzy), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64()), ("base", pa.bool_())]))
        names = SPAN.fieldNames()
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in blocks(offsets):
                cut = offsets[i : j + 1]
                n_words, spans = scan_block(data[cut[0] : cut[-1]], cut - cut[0], search)
                rows = [[dict(zip(names, s, strict=True)) for s in x] for x in spans]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(rows, kind)], names=[key, "n_words", "spans"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))])
    return docs.select(key, text).mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    exact = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(exact).cast("long").alias("n_base"),
        F.array_min(F.transform(exact, lambda s: s["word"])).alias("first_word"),
        F.array_max(F.transform(exact, lambda s: s["word"])).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )
