"""Token counts of fields and sections from one encoding of the whole document.

A document is its fields joined by line feeds and is encoded once.  The byte
sizes of its tokens give each token's character span, and an interval join with
the sections' character ranges says whose a token is.  A token over a boundary
goes by an explicit rule:

* ``start``: to the section of its first character;
* ``most``: to the section that holds most of its characters (ties: the earliest);
* ``share``: to each section by its share of the token's characters.

A token of part of a character covers that character.  The line feed that ends a
section belongs to it, so sections cover the document without gaps.

Defined results: a null field is empty; an empty field has one section of no
characters and no tokens, and so has an empty document.  Sections of one document
add up to its token count.  Equal rows give equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orrery.llm.tokens import encoder

RULES = ("start", "most", "share")


def token_spans(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last of each token."""
    ends = np.cumsum(sizes)
    if len(ends) and ends[-1] != len(text):
        raise ValueError("the tokens don't cover the text")
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    return char[ends - sizes], char[ends - 1] + 1


def sections(fields: list[str | None], lines: bool) -> list[tuple[int, int, int]]:
    """(field, first character, character after the last) of the joined fields' sections."""
    out, at = [], 0
    for f, text in enumerate(fields):
        body = (text or "") + ("\n" if f < len(fields) - 1 else "")
        begin = at
        if lines:
            cut = body.find("\n")
            while 0 <= cut < len(body) - 1:
                out.append((f, begin, at + cut + 1))
                begin = at + cut + 1
                cut = body.find("\n", cut + 1)
        at += len(body)
        out.append((f, begin, at))
    return out


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and tokens that begin there and go over its end.

    ``first`` and ``last`` are the tokens' character spans, ``starts`` the
    sections' first characters, ascending; sections without gaps.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is none of {', '.join(RULES)}")
    # of sections that begin at the same place, all but the last are empty
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, last - 1, side="right") - 1
    over = a != b
    crossing = np.bincount(a[over], minlength=len(starts))
    if rule == "start" or not over.any():
        return np.bincount(a, minlength=len(starts)).astype(np.float64), crossing
    counts = np.bincount(a[~over], minlength=len(starts)).astype(np.float64)
    for i in np.flatnonzero(over):
        edges = np.append(np.maximum(starts[a[i] : b[i] + 1], first[i]), last[i])
        held = np.diff(edges)
        if rule == "most":
            counts[a[i] + int(held.argmax())] += 1
        else:
            counts[a[i] : b[i] + 1] += held / (last[i] - first[i])
    return counts, crossing


def token_counts(docs: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = ("text",), lines: bool = True, rule: str = "start", tokenizer: str | None = None) -> DataFrame:
    """Per section: the key, field, section (from 0), char_start, char_end, n_tokens, n_crossing.

    ``n_tokens`` is a double for the rule ``share``, else a long.  ``lines``: each
    line of a field is a section, else each field.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is none of {', '.join(RULES)}")
    number = pa.float64() if rule == "share" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        sizes = encode.token_bytes()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                columns = [rows.column(i + 1).to_pylist() for i in range(len(fields))]
                owner: list[np.ndarray] = []
                parts: list[list[np.ndarray]] = [[] for _ in range(6)]
                for i, values in enumerate(zip(*columns, strict=True)):
                    text = "\n".join(v or "" for v in values)
                    cut = np.array(sections(list(values), lines), np.int64)
                    ids = encode.encode([text])[0]
                    counts, crossing = np.zeros(len(cut)), np.zeros(len(cut), np.int64)
                    if len(ids):
                        counts, crossing = attribute(*token_spans(text.encode(), sizes[ids]), cut[:, 1], rule)
                    owner.append(np.full(len(cut), i))
                    for p, v in zip(parts, (cut[:, 0], np.arange(len(cut)), cut[:, 1], cut[:, 2], counts, crossing), strict=True):
                        p.append(v)
                field, section, start, end, counts, crossing = (np.concatenate(p) for p in parts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(np.concatenate(owner))), pa.array(fields).take(pa.array(field)), pa.array(section, pa.int32()), pa.array(start), pa.array(end), pa.array(counts).cast(number), pa.array(crossing, pa.int64())],
                    names=["key", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("field", T.StringType()),
            T.StructField("section", T.IntegerType()),
            T.StructField("char_start", T.LongType()),
            T.StructField("char_end", T.LongType()),
            T.StructField("n_tokens", T.DoubleType() if rule == "share" else T.LongType()),
            T.StructField("n_crossing", T.LongType()),
        ]
    )
    return docs.select(key, *fields).mapInArrow(run, schema).withColumnRenamed("key", key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each line of each whole document, boundary tokens by their first character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, fields=("text",), lines=True, rule="start").drop("field")
