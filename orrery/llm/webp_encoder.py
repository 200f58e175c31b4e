"""Writes byte payloads as lossless WebP images: a sample is a pixel's green, red and blue are 0, alpha 255.

Each image has its own prefix codes and back-references, to runs of one byte and to
earlier places with the same bytes.  It is written plainly, with a palette (at most 16
different bytes, several of which then share a pixel) or with the predictor transform
(differences to the left or the upper pixel), whichever is shortest.  Cross-colour and
the colour cache can't shorten images of one sample a pixel: red and blue are 0
and cost no bits.  All images of a block are coded side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from orrery.llm.prefix_codes import CODE_LENGTH_ORDER, canonical_codes, huffman_lengths, length_tokens
from orrery.llm.textops import mix, words64
from orrery.llm.webp import MAX_COPY, MAX_SIDE, N_DISTANCES, N_LENGTHS, NEAR, near_distance, prefix_symbol, riff, write_code

LIMIT = 12  # bits of a code
#: Bytes of the shortest run and the shortest other repeat that become back-references.
LEAST_RUN, LEAST_REPEAT = 8, 10
LEFT, UP = 1, 2  # predictor modes

#: The code that code lengths are written in, by how often lengths occur in prose.
_LENGTH_WEIGHTS = [20, 2, 3, 5, 15, 25, 30, 35, 40, 30, 20, 15, 12, 0, 0, 0, 0, 25, 15]
META = huffman_lengths(np.array([_LENGTH_WEIGHTS]), 7)
META_CODES = canonical_codes(META)[0]
META = META[0]


def _fields(parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(value, bits) pairs of at most 24 bits each."""
    value = n = 0
    for v, k in parts:
        value, n = value | v << n, n + k
    cut = range(0, n, 24)
    return np.array([value >> i & 0xFFFFFF for i in cut], np.int64), np.array([min(24, n - i) for i in cut], np.int64)


_single = lambda s: write_code([int(i == s) for i in range(256)])
_normal = [(0, 1), (15, 4), *((int(META[s]), 3) for s in CODE_LENGTH_ORDER), (0, 1)]
#: Red and blue are always 0; alpha is 255, or 0 where a predictor or bundled samples leave it so.
_CHANNELS = {a: _fields(_single(0) + _single(0) + _single(a)) for a in (0, 255)}


@dataclass
class Coded:
    """Fields of some images: values, their bits and images, in order for each image."""

    value: np.ndarray
    bits: np.ndarray
    image: np.ndarray
    cost: np.ndarray  # bits of each image


def repeats(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of runs and of repeats that begin at words, none over another or over an image's end."""
    new = np.ones(len(data), bool)
    new[1:] = data[1:] != data[:-1]
    new[cuts[:-1]] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(data)))
    long = length >= LEAST_RUN
    begin, size = first[long] + 1, length[long] - 1
    pieces = -(-size // MAX_COPY)
    owner = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    runs = (begin[owner] + MAX_COPY * nth, np.minimum(MAX_COPY, size[owner] - MAX_COPY * nth), np.ones(len(owner), np.int64))

    view = words64(data)
    letter = (data >= 0x30) & (data != 0x7F)
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    image = np.searchsorted(cuts, start, side="right") - 1
    end = cuts[image + 1]
    room = end - start >= LEAST_REPEAT
    start, image, end = start[room], image[room], end[room]
    key = mix(view[start] ^ mix(image.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    here, before = start[order][1:][same], start[order][:-1][same]
    limit = np.minimum(end[order][1:][same] - here, MAX_COPY)
    equal = np.zeros(len(here), np.int64)
    live = np.flatnonzero((image[order][1:] == image[order][:-1])[same])
    while len(live):
        x = view[here[live] + equal[live]] ^ view[before[live] + equal[live]]
        n = np.full(len(live), 8)
        for k in range(7, -1, -1):
            n[(x >> np.uint64(8 * k)) & np.uint64(255) != 0] = k
        equal[live] += n
        live = live[(n == 8) & (equal[live] < limit[live])]
    equal = np.minimum(equal, limit)
    far = equal >= LEAST_REPEAT
    at = np.concatenate([runs[0], here[far]])
    length, back = np.concatenate([runs[1], equal[far]]), np.concatenate([runs[2], (here - before)[far]])
    order = np.argsort(at, kind="stable")
    at, length, back = at[order], length[order], back[order]
    # from each, the next that begins behind its end
    after, chosen, k = np.searchsorted(at, at + length).tolist(), [], 0
    while k < len(after):
        chosen.append(k)
        k = after[k]
    return at[chosen], length[chosen], back[chosen]


class Encoder:
    def __init__(self, width: int = 64, most_rows: int = 64):
        if not (0 < width <= MAX_SIDE and 0 < most_rows <= MAX_SIDE):
            raise ValueError("an image has 1 to 16384 columns and rows")
        self.width, self.most_rows = width, most_rows
        most = width * most_rows + len(NEAR)
        self.prefix = np.array([prefix_symbol(max(1, v)) for v in range(max(most, MAX_COPY) + 1)])
        self.near = {w: self._near(w) for w in {width, *(-(-width >> b) for b in (1, 2, 3))}}

    def _near(self, width: int) -> np.ndarray:
        """The code of each distance."""
        code = np.arange(self.width * self.most_rows + 1) + len(NEAR)
        for c in range(len(NEAR), 0, -1):
            d = near_distance(c, width)
            if d < len(code):
                code[d] = c
        return code

    def _code(self, data: np.ndarray, cuts: np.ndarray, width: int, alpha: int, rows: np.ndarray, heads: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Coded:
        """The images' fields: size, each head's fields (transforms; None: no transform), codes and pixels."""
        n = len(cuts) - 1
        at, length, back = repeats(data, cuts)
        covered = np.zeros(len(data) + 1, np.int64)
        covered[at] += 1
        covered[at + length] -= 1
        token = np.cumsum(covered[:-1]) == 0
        token[at] = True
        place = np.flatnonzero(token)
        symbol, extra, more = data[place].astype(np.int64), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        mine = np.searchsorted(place, at)
        p = self.prefix[length]
        symbol[mine], more[mine], extra[mine] = 256 + p[:, 0], p[:, 1], p[:, 2]
        d = self.prefix[self.near[width][back]]
        image = np.searchsorted(cuts, place, side="right") - 1
        size = 256 + N_LENGTHS
        cell = image * size + symbol
        green = np.bincount(cell, minlength=n * size).reshape(n, size)
        green[(green > 0).sum(axis=1) < 2, 255] += 1  # a second symbol, so that the code is complete
        lengths = huffman_lengths(green, LIMIT)
        codes = canonical_codes(lengths)
        distance = np.bincount(image[mine] * N_DISTANCES + d[:, 0], minlength=n * N_DISTANCES).reshape(n, N_DISTANCES)
        several = (distance > 0).sum(axis=1) > 1
        d_lengths = np.zeros(distance.shape, np.int64)
        d_lengths[several] = huffman_lengths(distance[several], LIMIT)
        d_codes = canonical_codes(d_lengths)

        sections: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def each(images: np.ndarray, fields: tuple[np.ndarray, np.ndarray]) -> None:
            value, bits = fields
            sections.append((np.tile(value, len(images)), np.tile(bits, len(images)), np.repeat(images, len(value))))

        def written(images: np.ndarray, table: np.ndarray) -> None:
            each(images, _fields(_normal))
            row, t, x, k = length_tokens(table)
            sections.append((META_CODES[t] | x << META[t], META[t] + k, images[row]))

        every = np.arange(n)
        # 14 bits for columns and rows each, less 1, alpha and version
        sections.append((np.stack([(self.width - 1) | ((rows - 1) & 3) << 14, (rows - 1) >> 2], axis=1).ravel(), np.full(2 * n, 16), np.repeat(every, 2)))
        for i, fields in enumerate(heads or ()):
            each(every[i : i + 1], fields)
        each(every, _fields([(0, 1)]))  # no further transform
        each(every, _fields([(0, 1), (0, 1)]))  # no colour cache, no meta prefix image
        written(every, lengths)
        each(every, _CHANNELS[alpha])
        written(np.flatnonzero(several), d_lengths[several])
        for i in np.flatnonzero(~several):
            each(every[i : i + 1], _fields(write_code([int(s == distance[i].argmax()) for s in range(N_DISTANCES)])))
        value, bits, owner = (np.concatenate(c) for c in zip(*sections, strict=True))
        order = np.argsort(owner.astype(np.uint16) if n < 1 << 16 else owner, kind="stable")
        value, bits, owner = value[order], bits[order], owner[order]
        # a copy has two fields: its length and its distance
        twice = np.ones(len(place), np.int64)
        twice[mine] = 2
        before = np.bincount(owner, minlength=n)
        to = np.cumsum(twice) - twice + np.cumsum(before)[image]
        total = len(value) + len(place) + len(mine)
        all_value, all_bits, all_image = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
        tokens = np.bincount(image, twice, n).astype(np.int64)
        head = np.arange(len(value)) + (np.cumsum(tokens) - tokens)[owner]
        all_value[head], all_bits[head], all_image[head] = value, bits, owner
        n_bits = lengths.ravel()[cell]
        all_value[to], all_bits[to], all_image[to] = codes.ravel()[cell] | extra << n_bits, n_bits + more, image
        d_bits = d_lengths[image[mine], d[:, 0]]
        second = to[mine] + 1
        all_value[second], all_bits[second], all_image[second] = d_codes[image[mine], d[:, 0]] | d[:, 2] << d_bits, d_bits + d[:, 1], image[mine]
        return Coded(all_value, all_bits, all_image, np.bincount(all_image, all_bits, n).astype(np.int64))

    def _with_palette(self, data: np.ndarray, cuts: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, Coded]]:
        """Images of at most 16 different bytes, several samples a pixel: (their numbers, fields)."""
        distinct = (counts > 0).sum(axis=1)
        out = []
        for bits, low, high in ((3, 1, 2), (2, 3, 4), (1, 5, 16)):
            some = np.flatnonzero((distinct >= low) & (distinct <= high))
            if not len(some):
                continue
            each, heads, bodies = 1 << bits, [], []
            for i in some.tolist():
                colours = np.flatnonzero(counts[i])
                index = np.zeros(256, np.int64)
                index[colours] = np.arange(len(colours))
                pixels = index[data[cuts[i] : cuts[i + 1]]].reshape(-1, self.width)
                pixels = np.pad(pixels, ((0, 0), (0, -self.width % each))).reshape(-1, each)
                bodies.append((pixels << np.arange(each) * (8 >> bits)).sum(axis=1).astype(np.uint8))
                steps = np.diff(colours, prepend=0)
                codes = [np.bincount(steps, minlength=256 + N_LENGTHS), np.bincount([255] + [0] * (len(colours) - 1), minlength=256)]
                table = [self._few(c) for c in codes]
                parts = [(1, 1), (3, 2), (len(colours) - 1, 8), (0, 1), *table[0][0], *_single(0), *_single(0), *table[1][0], *write_code([1] + [0] * (N_DISTANCES - 1))]
                for k, g in enumerate(steps.tolist()):
                    parts += [table[0][1][g], table[1][1][255 if k == 0 else 0]]
                heads.append(_fields(parts))
            sizes = [len(x) for x in bodies]
            out.append((some, self._code(np.concatenate(bodies), np.concatenate([[0], np.cumsum(sizes)]), -(-self.width >> bits), 255, rows[some], heads)))
        return out

    @staticmethod
    def _few(counts: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int]]]:
        """How a small alphabet's code is written, and the (code, bits) of its symbols."""
        used = np.flatnonzero(counts).tolist()
        if len(used) == 1:
            return write_code(np.minimum(counts, 1).tolist()), {used[0]: (0, 0)}
        n = huffman_lengths(counts[None], 15)
        codes = canonical_codes(n)[0]
        return write_code(n[0].tolist()), {s: (int(codes[s]), int(n[0, s])) for s in used}

    def _with_predictor(self, data: np.ndarray, cuts: np.ndarray, rows: np.ndarray, cost: np.ndarray) -> list[tuple[np.ndarray, Coded]]:
        """Images whose differences are worth a try, by their entropy."""
        n, column = len(cuts) - 1, (np.arange(len(data)) - np.repeat(cuts[:-1], np.diff(cuts))) % self.width
        top = np.arange(len(data)) - np.repeat(cuts[:-1], np.diff(cuts)) < self.width
        before = np.concatenate([[0], data[:-1]]).astype(np.uint8)
        above = np.concatenate([np.zeros(self.width, np.uint8), data[: max(0, len(data) - self.width)]])[: len(data)]
        before[cuts[:-1]] = 0
        owner = np.repeat(np.arange(n), np.diff(cuts))
        out = []
        for mode in (LEFT, UP):
            guess = np.where(top, before, np.where(column == 0, above, before if mode == LEFT else above))
            rest = data - guess
            counts = np.bincount(owner * 256 + rest, minlength=256 * n).reshape(n, 256)
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) * np.diff(cuts)
            some = np.flatnonzero(entropy < 0.9 * cost)
            if len(some):
                body = [rest[cuts[i] : cuts[i + 1]] for i in some.tolist()]
                sub = write_code([int(s == mode) for s in range(256 + N_LENGTHS)])
                head = _fields([(1, 1), (0, 2), (7, 3), (0, 1), *sub, *_single(0), *_single(0), *_single(0), *write_code([1] + [0] * (N_DISTANCES - 1))])
                if self.width <= 512 and self.most_rows <= 512:  # one block of the transform
                    out.append((some, self._code(np.concatenate(body), np.concatenate([[0], np.cumsum([len(x) for x in body])]), self.width, 0, rows[some], [head] * len(some))))
        return out

    def encode(self, payloads: np.ndarray, offsets: np.ndarray) -> list[list[bytes]]:
        """Images of each payload, whose bytes are a positive multiple of the width."""
        sizes = np.diff(offsets)
        if (sizes % self.width).any() or not (sizes > 0).all():
            raise ValueError("payloads must fill whole rows")
        if not len(sizes):
            return []
        most = self.width * self.most_rows
        per = -(-sizes // most)
        owner = np.repeat(np.arange(len(sizes)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        cuts = np.append(offsets[:-1][owner] + nth * most, offsets[-1])
        n, rows = len(owner), np.diff(cuts) // self.width
        counts = np.bincount(np.repeat(np.arange(n), np.diff(cuts)) * 256 + payloads, minlength=256 * n).reshape(n, 256)
        plain = self._code(payloads, cuts, self.width, 255, rows)
        streams, best = pack(plain), plain.cost.copy()
        for some, coded in [*self._with_palette(payloads, cuts, rows, counts), *self._with_predictor(payloads, cuts, rows, plain.cost)]:
            if (coded.cost < best[some]).any():
                for i, cost, stream in zip(some.tolist(), coded.cost.tolist(), pack(coded), strict=True):
                    if cost < best[i]:
                        best[i], streams[i] = cost, stream
        out: list[list[bytes]] = [[] for _ in sizes]
        for o, stream in zip(owner.tolist(), streams, strict=True):
            out[o].append(riff(stream))
        return out


def pack(coded: Coded) -> list[bytes]:
    """The bytes of each image's fields, which have at most 32 bits each."""
    bits, image, n = coded.bits, coded.image, len(coded.cost)
    ends = np.cumsum(bits)
    begin = ends - bits
    words = -(-coded.cost // 32)
    start = np.concatenate([[0], np.cumsum(words)])
    offset = begin + (32 * start[:-1] - np.cumsum(coded.cost) + coded.cost)[image]
    word = offset >> 5
    parts = coded.value.astype(np.uint64) << (offset & 31).astype(np.uint64)
    new = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    filled = np.zeros(int(start[-1]) + 2, np.uint64)
    filled[word[new]] = np.add.reduceat(parts, new)
    packed = filled & np.uint64(0xFFFFFFFF)
    packed[1:] |= filled[:-1] >> np.uint64(32)
    raw = packed.astype("<u4").tobytes()
    return [raw[4 * s : 4 * s + (k + 7) // 8] for s, k in zip(start[:n].tolist(), coded.cost.tolist(), strict=True)]
