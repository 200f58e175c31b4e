"""Media columns: byte payloads stored as lossless WebP images, and pixel features read back.

A payload is a text's UTF-8 bytes, filled with zero bytes to a positive multiple
of 64.  It is stored as images of 64 columns and at most 64 rows, a byte a
pixel, so that neither a very long text nor its decoding needs a large image; the
stored form is the sequence of WebP files.

Defined results: a null text counts as empty, an empty one has a payload of 64
zeros.  Equal texts have equal values.  A media value that is no lossless WebP
raises :class:`orrery.llm.webp.WebPError`.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.store import written
from orrery.llm.textops import blocks, text_bytes
from orrery.llm.webp import Decoder
from orrery.llm.webp_encoder import Encoder

UNIT = 64
BLOCK = 4 << 20


def padded(data: np.ndarray, offsets: np.ndarray, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of a positive multiple of ``unit`` bytes each, filled with zeros."""
    sizes = np.diff(offsets)
    full = np.maximum(-(-sizes // unit), 1) * unit
    to = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(to[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], sizes)] = data
    return out, to


def store_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_bytes and ``media``, the WebP files of its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(UNIT)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in blocks(offsets, BLOCK):
                cut = offsets[i : j + 1]
                media = encoder.encode(*padded(data[cut[0] : cut[-1]], cut - cut[0]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(cut)), pa.array(media, pa.list_(pa.binary()))], names=[key, "n_bytes", "media"])

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.ArrayType(T.BinaryType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def read_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds nothing but pixels: per row its other columns and ``pixels``, ARGB bytes (BGRA order in memory), ``widths`` and ``heights`` of its images."""
    kept = [c for c in media.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder()
        for b in batches:
            for rows, images in _decoded(b.column(len(kept)), decoder):
                cols = [b.column(i).take(pa.array(rows)) for i in range(len(kept))]
                pixels = pa.array([b"".join(x.tobytes() for x in g) for g in images], pa.binary())
                widths = pa.array([[x.shape[1] for x in g] for g in images], pa.list_(pa.int32()))
                heights = pa.array([[x.shape[0] for x in g] for g in images], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*cols, pixels, widths, heights], names=[*kept, "pixels", "widths", "heights"])

    fields = [media.schema[c] for c in kept] + [T.StructField("pixels", T.BinaryType()), T.StructField("widths", T.ArrayType(T.IntegerType())), T.StructField("heights", T.ArrayType(T.IntegerType()))]
    return media.select(*kept, column).mapInArrow(run, T.StructType(fields))


def _decoded(column: pa.Array, decoder: Decoder) -> Iterator[tuple[list[int], list[list[np.ndarray]]]]:
    """Images of the rows, a bounded number of stored bytes at a time (null: no images)."""
    rows: list[int] = []
    files: list[list[bytes]] = []
    size = 0
    for i in range(len(column)):
        files.append(column[i].as_py() or [])
        rows.append(i)
        size += sum(map(len, files[-1]))
        if size >= BLOCK // 2 or i == len(column) - 1:
            flat = decoder.decode([f for g in files for f in g])
            at, out = 0, []
            for g in files:
                out.append(flat[at : at + len(g)])
                at += len(g)
            yield rows, out
            rows, files, size = [], [], 0


def samples(images: list[np.ndarray]) -> np.ndarray:
    """The payload of a row's images: their green samples in order."""
    return np.concatenate([((x.ravel() >> 8) & 255).astype(np.uint8) for x in images]) if images else np.zeros(0, np.uint8)


def feature(payload: np.ndarray) -> str:
    """Distinct samples, their mean and their entropy in bits."""
    counts = np.bincount(payload, minlength=256)
    share = counts[counts > 0] / max(1, len(payload))
    return f"distinct={len(share)};mean={float(payload.mean()) if len(payload) else 0.0:.3f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f}"


def media_features(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Per row of :func:`store_media`: digests of the stored form and of the payload decoded from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder()
        for b in batches:
            for rows, images in _decoded(b.column(2), decoder):
                out: dict[str, list] = {c: [] for c in names}
                for i, g in zip(rows, images, strict=True):
                    payload, stored = samples(g), b"".join(b.column(2)[i].as_py() or [])
                    raw = payload.tobytes()
                    out["payload_bytes"].append(len(raw))
                    out["payload_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["tail_crc32"].append(zlib.crc32(raw[-UNIT:]))
                    out["media_bytes"].append(len(stored))
                    out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                    out["feature"].append(feature(payload))
                first, n = rows[0], len(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(1).slice(first, n), *(pa.array(out[c], t) for c, t in names.items())], names=[key, "n_bytes", *names])

    names = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([media.schema[key], media.schema["n_bytes"], *(T.StructField(c, k) for c, k in zip(names, kinds, strict=True))])
    return media.select(key, "n_bytes", column).mapInArrow(run, schema)


def op7_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = written(store_media(docs), "media")  # stored, so that what follows reads the stored bytes back
    return media_features(media).select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
