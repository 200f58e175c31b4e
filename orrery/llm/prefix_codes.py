"""Prefix codes of many images at once: lengths from counts, canonical codes, lookup tables, and lengths read from streams.

All functions take a row per image, so that one numpy step works on every image.
"""

from __future__ import annotations

import numpy as np

MAX_CODE = 15
# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]

#: Each 15-bit number with its bits in reverse.
_REVERSED = np.zeros(1 << MAX_CODE, np.int64)
for _bit in range(MAX_CODE):
    _REVERSED |= ((np.arange(1 << MAX_CODE) >> _bit) & 1) << (MAX_CODE - 1 - _bit)


def huffman_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths (rows, symbols) of positive counts, none over ``limit``; a lone symbol has length 1.

    Two queues, of leaves by count and of inner nodes in the order of their making, give
    the two least of each step.  Where a code gets too long its counts are flattened.
    """
    counts = counts.copy()
    out = np.zeros(counts.shape, np.int64)
    todo = np.arange(len(counts))
    while len(todo):
        some = _unlimited(counts[todo])
        out[todo] = some
        todo = todo[some.max(axis=1, initial=0) > limit]
        counts[todo] = (counts[todo] + 1) // 2
    return out


def _unlimited(counts: np.ndarray) -> np.ndarray:
    n, never = len(counts), np.int64(1) << 60
    order = np.argsort(np.where(counts > 0, counts, never), axis=1, kind="stable")
    used = (counts > 0).sum(axis=1)
    most = int(used.max(initial=0))
    rows = np.arange(n)
    leaf = np.full((n, most + 2), never)
    leaf[:, :most] = np.take_along_axis(np.where(counts > 0, counts, never), order[:, :most], axis=1)
    inner = np.full((n, most + 2), never)
    leaf_parent, inner_parent = np.zeros((n, most + 2), np.int64), np.zeros((n, most + 2), np.int64)
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for t in range(most - 1):
        live = rows[t < used - 1]
        total = np.zeros(len(live), np.int64)
        for _ in range(2):
            x, y = leaf[live, a[live]], inner[live, b[live]]
            first = x <= y
            total += np.where(first, x, y)
            of_leaf, of_inner = live[first], live[~first]
            leaf_parent[of_leaf, a[of_leaf]] = t
            a[of_leaf] += 1
            inner_parent[of_inner, b[of_inner]] = t
            b[of_inner] += 1
        inner[live, t] = total
    depth = np.zeros((n, most + 2), np.int64)
    for t in range(most - 3, -1, -1):
        live = rows[t < used - 2]
        depth[live, t] = depth[live, inner_parent[live, t]] + 1
    out = np.zeros(counts.shape, np.int64)
    sizes = np.where(np.arange(most) < used[:, None], np.take_along_axis(depth, leaf_parent[:, :most], axis=1) + 1, 0)
    np.put_along_axis(out, order[:, :most], sizes, axis=1)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes (rows, symbols)."""
    out = np.zeros(lengths.shape, np.int64)
    code = np.zeros(len(lengths), np.int64)
    for n in range(1, int(lengths.max(initial=0)) + 1):
        here = lengths == n
        rank = np.cumsum(here, axis=1) - 1
        full = (code[:, None] + rank)[here]
        out[here] = _REVERSED[full & ((1 << MAX_CODE) - 1)] >> (MAX_CODE - n)
        code = (code + here.sum(axis=1)) << 1
    return out


def tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each next bits, as many as its longest code has: symbol * 16 + bits used; and where each row's table begins.

    A code of one symbol uses no bits.  Raises ValueError where a code isn't complete.
    """
    used = (lengths > 0).sum(axis=1)
    full = np.where(used[:, None] > 1, lengths, 0)
    longest = full.max(axis=1, initial=0)
    if ((np.where(full > 0, np.int64(1) << (MAX_CODE - full), 0).sum(axis=1) != 1 << MAX_CODE) & (used > 1)).any():
        raise ValueError("a prefix code isn't complete")
    sizes = np.int64(1) << longest
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.int32)
    row, symbol = np.nonzero(full)
    n = full[row, symbol]
    copies = np.int64(1) << (longest[row] - n)
    owner = np.repeat(np.arange(len(row)), copies)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(copies) - copies, copies)
    out[(starts[row] + canonical_codes(full)[row, symbol])[owner] + (nth << n[owner])] = (symbol << 4 | n)[owner]
    lone = used == 1
    out[starts[:-1][lone]] = lengths[lone].argmax(axis=1) << 4
    return out, starts


class Lanes:
    """Streams read side by side, least significant bit first."""

    def __init__(self, streams: list[bytes]):
        sizes = np.array([len(s) for s in streams], np.int64)
        self.body = np.frombuffer(b"".join([*streams, bytes(16)]), np.uint8)
        self.view = np.ndarray((len(self.body) - 8,), dtype="<u8", buffer=self.body, strides=(1,))
        self.end = 8 * np.cumsum(sizes)
        self.begin = self.end - 8 * sizes
        self.at = self.begin.copy()

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        at = np.minimum(self.at[lanes], self.end[-1])
        return self.view[at >> 3] >> (at & 7).astype(np.uint64)

    def read(self, lanes: np.ndarray, n) -> np.ndarray:
        """The next n bits (a number, or one for each lane) of some lanes."""
        value = self.peek(lanes) & ((np.uint64(1) << np.asarray(n).astype(np.uint64)) - np.uint64(1))
        self.at[lanes] += n
        return value.astype(np.int64)

    def late(self) -> bool:
        return bool((self.at > self.end).any())


def read_lengths(lanes: Lanes, size: int) -> np.ndarray:
    """The lengths (lanes, size) of one prefix code of each lane.  Raises ValueError for codes that can't be."""
    n = len(lanes.at)
    every = np.arange(n)
    out = np.zeros((n, size), np.int64)
    simple = lanes.read(every, 1) > 0
    few = every[simple]
    if len(few):
        two, wide = lanes.read(few, 1), lanes.read(few, 1)
        symbol = lanes.read(few, np.where(wide > 0, 8, 1))
        both = few[two > 0]
        second = lanes.read(both, 8)
        if max(symbol.max(initial=0), second.max(initial=0)) >= size:
            raise ValueError("a symbol is outside its alphabet")
        out[few, symbol] = 1
        out[both, second] = 1
    rest = every[~simple]
    if not len(rest):
        return out
    given = 4 + lanes.read(rest, 4)
    meta = np.zeros((n, 19), np.int64)
    for i in range(19):
        some = rest[given > i]
        meta[some, CODE_LENGTH_ORDER[i]] = lanes.read(some, 3)
    left = np.full(n, size)
    capped = rest[lanes.read(rest, 1) > 0]
    bits = 2 + 2 * lanes.read(capped, 3)
    left[capped] = 2 + lanes.read(capped, bits)
    table, starts = tables(meta[rest])
    first, mask = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first[rest], mask[rest] = starts[:-1], np.diff(starts) - 1
    at, previous = np.zeros(n, np.int64), np.full(n, 8)
    live = rest
    while len(live):
        e = table[first[live] + (lanes.peek(live).astype(np.int64) & mask[live])]
        lanes.at[live] += e & 15
        token = (e >> 4).astype(np.int64)
        left[live] -= 1
        plain = token < 16
        x = live[plain]
        out[x, at[x]] = token[plain]
        at[x] += 1
        previous[x] = np.where(token[plain] > 0, token[plain], previous[x])
        for code, base, extra in ((16, 3, 2), (17, 3, 3), (18, 11, 7)):
            x = live[token == code]
            if len(x):
                times = base + lanes.read(x, extra)
                if (at[x] + times > size).any():
                    raise ValueError("code lengths run over")
                if code == 16:
                    owner = np.repeat(np.arange(len(x)), times)
                    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
                    out[x[owner], at[x][owner] + nth] = previous[x][owner]
                at[x] += times
        live = live[(at[live] < size) & (left[live] > 0)]
        if lanes.late():
            raise ValueError("a stream ends early")
    return out


def length_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, extra bits, their number) that write each row's lengths, runs of zeros shortened."""
    n, size = lengths.shape
    flat = lengths.ravel()
    zero = flat == 0
    new = ~zero
    new |= zero & (np.append(True, ~zero[:-1]) | (np.arange(n * size) % size == 0))
    unit = np.flatnonzero(new)
    run = np.diff(np.append(unit, n * size))
    blank = zero[unit]
    whole = np.where(blank, run // 138, 0)
    rest = np.where(blank, run - 138 * whole, 0)
    times = np.where(blank, whole + np.where(rest >= 3, 1, rest), 1)
    owner = np.repeat(np.arange(len(unit)), times)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    full, r = nth < whole[owner], rest[owner]
    token = np.where(~blank[owner], flat[unit[owner]], np.where(full | (r >= 11), 18, np.where(r >= 3, 17, 0)))
    extra = np.where(token == 18, np.where(full, 127, r - 11), np.where(token == 17, r - 3, 0))
    return unit[owner] // size, token, np.where(blank[owner], extra, 0), np.where(token == 18, 7, np.where(token == 17, 3, 0))
