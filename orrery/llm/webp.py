"""Lossless WebP: a decoder of whole VP8L streams.

Decoding reads prefix codes, back-references, the colour cache and meta prefix
images, and inverts the predictor, cross-colour, subtract-green and palette
transforms.  Images of a batch are decoded side by side: one numpy step reads the
next symbol of every image whose stream has one code group and no colour cache, and
likewise the codes of those without transforms; other streams take the scalar reader.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from orrery.llm.prefix_codes import CODE_LENGTH_ORDER, MAX_CODE, Lanes, read_lengths, tables

# Fixed values of the format.
#: Offsets (x, y) of the first 120 distance codes.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1),
    (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
N_LENGTHS, N_DISTANCES, MAX_COPY, MAX_SIDE = 24, 40, 4096, 1 << 14
CACHE_MULTIPLIER = 0x1E35A7BD


class WebPError(ValueError):
    """The bytes are no lossless WebP image."""


# ---------------------------------------------------------------- prefix codes


def canonical(lengths: list[int] | np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes of the given lengths (0: unused)."""
    lengths = np.asarray(lengths)
    out, code = np.zeros(len(lengths), np.int64), 0
    for n in range(1, MAX_CODE + 1):
        for s in np.flatnonzero(lengths == n):
            out[s] = int(format(code, f"0{n}b")[::-1], 2)
            code += 1
        code <<= 1
    return out


def lookup(lengths: list[int] | np.ndarray) -> np.ndarray:
    """For each next bits, as many as the longest code has: symbol * 16 + bits used.  A code of one symbol uses none."""
    try:
        return tables(np.asarray(lengths)[None])[0]
    except ValueError as e:
        raise WebPError(str(e)) from e


def code_lengths(weights: list[int]) -> list[int]:
    """Huffman lengths of positive weights, none over 15: weights are flattened until that holds."""
    while True:
        heap = [(w, i, (i,)) for i, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        out, serial = [0] * len(weights), len(weights)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if max(out) <= MAX_CODE:
            return out
        weights = [(w + 1) // 2 for w in weights]


def prefix_value(symbol: int, read) -> int:
    """A length or distance from its prefix symbol; ``read`` gives extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + read(extra) + 1


def prefix_symbol(value: int) -> tuple[int, int, int]:
    """(symbol, number of extra bits, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = (v >> (top - 1)) & 1
    return 2 * top + half, top - 1, v & ((1 << (top - 1)) - 1)


def near_distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --------------------------------------------------------------------- reading


class Bits:
    """Least significant bit first."""

    def __init__(self, body: bytes, at: int = 0):
        self.body, self.at, self.end = body, at, 8 * len(body)

    def peek(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.body[i : i + 8], "little") >> (self.at & 7)) & 0xFFFFFFFF

    def read(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise WebPError("the stream ends early")
        return v

    def symbol(self, table: np.ndarray) -> int:
        e = int(table[self.peek() & (len(table) - 1)])
        self.at += e & 15
        return e >> 4


def read_code(bits: Bits, size: int) -> np.ndarray:
    """The lengths of one prefix code over ``size`` symbols."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise WebPError("a symbol is outside its alphabet")
        lengths[symbols] = 1
        return lengths
    meta = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        meta[CODE_LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, at, previous = lookup(meta), 0, 8
    while at < size and left > 0:
        left -= 1
        s = bits.symbol(table)
        if s < 16:
            lengths[at] = s
            at, previous = at + 1, s or previous
            continue
        value, n = (previous, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise WebPError("code lengths run over")
        lengths[at : at + n] = value
        at += n
    return lengths


def read_group(bits: Bits, cache_bits: int) -> list[np.ndarray]:
    green = 256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0)
    return [lookup(read_code(bits, n)) for n in (green, 256, 256, 256, N_DISTANCES)]


def read_cache_bits(bits: Bits) -> int:
    n = bits.read(4) if bits.read(1) else 0
    if n > 11:
        raise WebPError("the colour cache is too large")
    return n


def read_pixels(bits: Bits, width: int, height: int, cache_bits: int, groups: list, meta: np.ndarray | None = None, meta_bits: int = 0) -> np.ndarray:
    """The scalar reader of entropy-coded pixels (ARGB as uint32)."""
    n, at = width * height, 0
    out, cache = [0] * n, [0] * (1 << cache_bits if cache_bits else 0)
    across = -(-width >> meta_bits)

    def keep(p: int) -> None:
        nonlocal at
        out[at] = p
        at += 1
        if cache_bits:
            cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while at < n:
        g = groups[0] if meta is None else groups[meta[(at // width >> meta_bits) * across + (at % width >> meta_bits)]]
        s = bits.symbol(g[GREEN])
        if s < 256:
            r, b, a = bits.symbol(g[RED]), bits.symbol(g[BLUE]), bits.symbol(g[ALPHA])
            keep(a << 24 | r << 16 | s << 8 | b)
        elif s < 256 + N_LENGTHS:
            length = prefix_value(s - 256, bits.read)
            back = near_distance(prefix_value(bits.symbol(g[DISTANCE]), bits.read), width)
            if back > at or at + length > n:
                raise WebPError("a back-reference leaves the image")
            for _ in range(length):
                keep(out[at - back])
        else:
            keep(cache[s - 256 - N_LENGTHS])
        if bits.at > bits.end:
            raise WebPError("the stream ends early")
    return np.array(out, np.uint32)


def read_sub_image(bits: Bits, width: int, height: int) -> np.ndarray:
    cache_bits = read_cache_bits(bits)
    return read_pixels(bits, width, height, cache_bits, [read_group(bits, cache_bits)])


@dataclass
class Head:
    """What stands before an image's pixels."""

    width: int
    height: int
    coded_width: int = 0
    transforms: list = field(default_factory=list)
    cache_bits: int = 0
    groups: list = field(default_factory=list)
    meta: np.ndarray | None = None
    meta_bits: int = 0
    at: int = 0  # first bit of the pixels


def stream_of(file: bytes) -> bytes:
    """The VP8L chunk of a RIFF file."""
    if len(file) < 20 or file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise WebPError("no WebP file")
    at = 12
    while at + 8 <= len(file):
        name, size = file[at : at + 4], int.from_bytes(file[at + 4 : at + 8], "little")
        if name == b"VP8L":
            if at + 8 + size > len(file) or not size or file[at + 8] != 0x2F:
                break
            return file[at + 9 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebPError("no lossless image in the file")


def read_head(bits: Bits) -> Head:
    head = Head(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)  # whether alpha is used: a hint
    if bits.read(3):
        raise WebPError("unknown version")
    width, seen = head.width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            n = bits.read(3) + 2
            head.transforms.append((kind, width, n, read_sub_image(bits, -(-width >> n), -(-head.height >> n))))
        elif kind == 2:
            head.transforms.append((kind, width, 0, None))
        else:
            size = bits.read(8) + 1
            table = read_sub_image(bits, size, 1).view(np.uint8).reshape(size, 4)
            table = np.cumsum(table, axis=0, dtype=np.uint8)
            n = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            head.transforms.append((kind, width, n, np.ascontiguousarray(table).view(np.uint32).ravel()))
            width = -(-width >> n)
    head.coded_width, head.cache_bits, n_groups = width, read_cache_bits(bits), 1
    if bits.read(1):
        head.meta_bits = bits.read(3) + 2
        image = read_sub_image(bits, -(-width >> head.meta_bits), -(-head.height >> head.meta_bits))
        head.meta = (image >> 8) & 0xFFFF
        n_groups = int(head.meta.max()) + 1
    head.groups = [read_group(bits, head.cache_bits) for _ in range(n_groups)]
    head.at = bits.at
    return head


# ------------------------------------------------------------------ transforms


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, top, right_top, left_top):
    """One pixel's prediction from its neighbours (int channels)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right_top
    if mode == 4:
        return left_top
    if mode == 5:
        return _average(_average(left, right_top), top)
    if mode == 6:
        return _average(left, left_top)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(left_top, top)
    if mode == 9:
        return _average(top, right_top)
    if mode == 10:
        return _average(_average(left, left_top), _average(top, right_top))
    if mode == 11:
        to_left, to_top = np.abs(top - left_top).sum(), np.abs(left - left_top).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + np.fix((mean - left_top) / 2).astype(np.int64), 0, 255)
    return np.array([0, 0, 0, 255])


def undo_predictor(pixels: np.ndarray, width: int, bits: int, modes: np.ndarray) -> np.ndarray:
    c = pixels.view(np.uint8).reshape(-1, width, 4).astype(np.int64)
    modes = ((modes >> 8) & 15).reshape(-1, -(-width >> bits))
    if (modes == 1).all() or (modes == 2).all():  # the left or the upper pixel throughout: running sums
        c[0, 0, 3] += 255
        c[0] = np.cumsum(c[0], axis=0)
        if modes[0, 0] == 1:
            c[:, 0] = np.cumsum(c[:, 0], axis=0)
            c[1:] = np.cumsum(c[1:], axis=1)
        else:
            c = np.cumsum(c, axis=0)
        return np.ascontiguousarray((c & 255).astype(np.uint8)).view(np.uint32).ravel()
    for y in range(len(c)):
        for x in range(width):
            if y == 0:
                guess = c[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                corner = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = _predict(int(modes[y >> bits, x >> bits]), c[y, x - 1], c[y - 1, x], corner, c[y - 1, x - 1])
            c[y, x] = (c[y, x] + guess) & 255
    return np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32).ravel()


def undo_cross_colour(pixels: np.ndarray, width: int, bits: int, elements: np.ndarray) -> np.ndarray:
    y, x = np.divmod(np.arange(len(pixels)), width)
    e = elements[(y >> bits) * -(-width >> bits) + (x >> bits)]
    signed = lambda v, n: ((v >> n) & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(pixels, 8), (pixels >> 16).astype(np.int32) & 255, pixels.astype(np.int64).astype(np.int32) & 255
    red = (red + (signed(e, 0) * green >> 5)) & 255
    blue = blue + (signed(e, 8) * green >> 5) + (signed(e, 16) * red.astype(np.uint8).view(np.int8) >> 5)
    return (pixels & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << 16) | (blue & 255).astype(np.uint32)


def undo_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> 8) & 255
    return (pixels & np.uint32(0xFF00FF00)) | ((pixels & np.uint32(0xFF00FF)) + (green << 16) + green) & np.uint32(0xFF00FF)


def undo_palette(pixels: np.ndarray, width: int, bits: int, table: np.ndarray) -> np.ndarray:
    index = ((pixels >> 8) & 255).reshape(-1, -(-width >> bits))
    if bits:
        x, depth = np.arange(width), 8 >> bits
        index = (index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * depth)) & ((1 << depth) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


def undo(head: Head, pixels: np.ndarray) -> np.ndarray:
    for kind, width, bits, data in reversed(head.transforms):
        if kind == 0:
            pixels = undo_predictor(pixels, width, bits, data)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, width, bits, data)
        elif kind == 2:
            pixels = undo_green(pixels)
        else:
            pixels = undo_palette(pixels, width, bits, data)
    return pixels.reshape(head.height, head.width)


# -------------------------------------------------------------------- decoding


def plain(stream: bytes) -> bool:
    """Whether the stream has no transform, no colour cache and no meta prefix image."""
    return len(stream) > 4 and not stream[4] & 7 and not stream[3] >> 5


def read_plain_heads(streams: list[bytes]) -> list[Head]:
    """Heads of plain streams, side by side."""
    lanes = Lanes(streams)
    every = np.arange(len(streams))
    width, height = lanes.read(every, 14) + 1, lanes.read(every, 14) + 1
    lanes.read(every, 7)
    codes = []
    try:
        for size in (256 + N_LENGTHS, 256, 256, 256, N_DISTANCES):
            codes.append(tables(read_lengths(lanes, size)))
    except ValueError as e:
        raise WebPError(str(e)) from e
    at = (lanes.at - lanes.begin).tolist()
    out = []
    for i, (w, h, p) in enumerate(zip(width.tolist(), height.tolist(), at, strict=True)):
        out.append(Head(w, h, w, groups=[[t[starts[i] : starts[i + 1]] for t, starts in codes]], at=p))
    return out


class Decoder:
    """Decodes many files."""

    def decode(self, files: list[bytes]) -> list[np.ndarray]:
        """ARGB pixels (uint32, height x width) of each file."""
        streams = [stream_of(f) for f in files]
        easy = [i for i, s in enumerate(streams) if plain(s)]
        heads: list = [None] * len(files)
        for i, head in zip(easy, read_plain_heads([streams[i] for i in easy]) if easy else (), strict=True):
            heads[i] = head
        heads = [h or read_head(Bits(s)) for h, s in zip(heads, streams, strict=True)]
        out: list = [None] * len(files)
        side = [i for i, h in enumerate(heads) if h.meta is None and not h.cache_bits]
        for i, pixels in zip(side, side_by_side([streams[i] for i in side], [heads[i] for i in side]), strict=True):
            out[i] = undo(heads[i], pixels)
        for i, h in enumerate(heads):
            if out[i] is None:
                out[i] = undo(h, read_pixels(Bits(streams[i], h.at), h.coded_width, h.height, h.cache_bits, h.groups, h.meta, h.meta_bits))
        return out


def side_by_side(streams: list[bytes], heads: list[Head]) -> list[np.ndarray]:
    """Pixels of streams with one code group and no colour cache; each step reads a symbol of every stream."""
    if not streams:
        return []
    order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
    found = [[heads[i].groups[0][k] for i in order] for k in range(5)]
    table = [np.concatenate(x) for x in found]
    sizes_of = [np.array([len(t) for t in x]) for x in found]
    first = [np.cumsum(x) - x for x in sizes_of]
    mask = [x - 1 for x in sizes_of]
    silent = [bool((x == 1).all()) for x in sizes_of]
    body = np.frombuffer(b"".join([streams[i] for i in order] + [bytes(16)]), np.uint8)
    view = np.ndarray((len(body) - 8,), dtype="<u8", buffer=body, strides=(1,))
    sizes = np.array([heads[i].coded_width * heads[i].height for i in order])
    base = np.concatenate([[0], np.cumsum(sizes)])
    begins = 8 * np.concatenate([[0], np.cumsum([len(streams[i]) for i in order])])
    pos = begins[:-1] + np.array([heads[i].at for i in order])
    limit, to, end = begins[1:].copy(), base[:-1].copy(), base[1:].copy()
    origin = base[:-1].copy()
    wide = np.array([heads[i].coded_width for i in order])
    out = np.zeros(base[-1] + 1, np.uint32)
    last = len(view) - 1

    def step(k: int, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ahead = view[np.minimum(pos >> 3, last)] >> (pos & 7).astype(np.uint64)
        e = table[k][first[k] + (ahead.astype(np.int64) & mask[k])]
        return e >> 4, pos + (e & 15)

    # channels without bits are the same for all of an image's literals
    channels = ((RED, 16), (BLUE, 0), (ALPHA, 24))
    fixed = np.zeros(len(order), np.uint32)
    for k, shift in channels:
        if silent[k]:
            fixed |= (table[k][first[k]] >> 4).astype(np.uint32) << np.uint32(shift)
    spoken = [(k, shift) for k, shift in channels if not silent[k]]
    rounds = 0
    while len(pos):
        green, after = step(GREEN, pos)
        copies = np.flatnonzero(green >= 256)
        rest = fixed
        for k, shift in spoken:
            v, later = step(k, after)
            if len(copies):
                later[copies] = after[copies]
            after, rest = later, rest | (v.astype(np.uint32) << np.uint32(shift))
        out[to] = rest | (green.astype(np.uint32) << np.uint32(8))
        to, pos = to + 1, after
        for c in copies.tolist():
            at = int(pos[c])

            def read(n: int) -> int:
                nonlocal at
                v = int(view[at >> 3]) >> (at & 7) & ((1 << n) - 1)
                at += n
                return v

            length = prefix_value(int(green[c]) - 256, read)
            e = int(table[DISTANCE][int(first[DISTANCE][c]) + (int(view[at >> 3]) >> (at & 7) & int(mask[DISTANCE][c]))])
            at += e & 15
            back = near_distance(prefix_value(e >> 4, read), int(wide[c]))
            a = int(to[c]) - 1
            if a - back < origin[c] or a + length > end[c]:
                raise WebPError("a back-reference leaves the image")
            if back >= length:
                out[a : a + length] = out[a - back : a - back + length]
            else:
                out[a : a + length] = np.resize(out[a - back : a], length)
            to[c], pos[c] = a + length, at
        rounds += 1
        live = to < end
        if not live.all():
            if (pos > limit).any():
                raise WebPError("a stream ends early")
            pos, to, end, origin, wide, limit = pos[live], to[live], end[live], origin[live], wide[live], limit[live]
            fixed, first, mask = fixed[live], [x[live] for x in first], [x[live] for x in mask]
        elif not rounds & 255 and (pos > limit).any():
            raise WebPError("a stream ends early")
    images: list = [None] * len(streams)
    for k, i in enumerate(order):
        images[i] = out[base[k] : base[k + 1]]
    return images


# -------------------------------------------------------------------- writing


def write_code(lengths: list[int]) -> list[tuple[int, int]]:
    """A prefix code as (value, bits) fields: simple for one or two symbols, else normal."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        symbols = used or [0]
        wide = symbols[0] > 1
        out = [(1, 1), (len(symbols) - 1, 1), (int(wide), 1), (symbols[0], 8 if wide else 1)]
        return out + [(s, 8) for s in symbols[1:]]
    tokens: list[tuple[int, int, int]] = []
    at = 0
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at] and n < 138:
            n += 1
        if lengths[at] == 0 and n >= 3:
            tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
        else:
            n = 1
            tokens.append((lengths[at], 0, 0))
        at += n
    counts = [0] * 19
    for t in tokens:
        counts[t[0]] += 1
    meta = [0] * 19
    while True:  # these lengths have 3 bits
        meta = code_lengths(counts)
        if max(meta) <= 7:
            break
        counts = [(c + 1) // 2 for c in counts]
    if sum(1 for m in meta if m) == 1:
        meta = [1 if m or i == meta.index(0) else 0 for i, m in enumerate(meta)]
    codes, n = canonical(meta), 19
    while n > 4 and not meta[CODE_LENGTH_ORDER[n - 1]]:
        n -= 1
    out = [(0, 1), (n - 4, 4)] + [(meta[s], 3) for s in CODE_LENGTH_ORDER[:n]] + [(0, 1)]
    for s, extra, k in tokens:
        out += [(int(codes[s]), meta[s]), (extra, k)]
    return out


def riff(stream: bytes) -> bytes:
    """A file of one VP8L stream."""
    size = len(stream) + 1
    pad = size & 1
    return b"RIFF" + (12 + size + pad).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + b"\x2f" + stream + bytes(pad)
