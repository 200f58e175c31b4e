"""Vectorised byte kernels shared by the text operators.

Everything works on one Arrow batch at a time: the texts of a batch are one
``uint8`` buffer plus document offsets, so that numpy passes replace per-row
Python.  Lengths are never limited; :func:`blocks` only groups documents so
that scratch arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: ASCII lower-casing as a byte table.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column (null: empty) and its int64 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string()).view(pa.large_binary())
    else:
        column = pc.fill_null(column, b"").cast(pa.large_binary())
    _, raw, body = column.buffers()
    offsets = np.frombuffer(raw, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of :func:`text_bytes`, as a binary Arrow array."""
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def blocks(offsets: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal true runs of ``mask`` that do not cross document offsets."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[offsets] = True
    first = mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, in wrapping arithmetic."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def words64(data: np.ndarray) -> np.ndarray:
    """A view whose item i holds the 8 bytes from i on (little-endian, zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes a step."""
    view, left = words64(data), ends - starts
    h = left.astype(np.uint64) * U64(0x9E3779B97F4A7C15)
    at, live = starts.copy(), np.arange(len(starts))
    while len(live):
        part = view[at] & _MASKS[np.minimum(left, 8)]
        h[live] = mix(h[live] ^ part) + U64(0x632BE59BD9B4E019)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def rank_in_group(groups: np.ndarray) -> np.ndarray:
    """For each row, how many earlier rows have the same group."""
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return out
