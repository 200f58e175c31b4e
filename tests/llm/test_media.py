import hashlib
import random
import zlib

import numpy as np
import pytest

from orrery.llm import webp
from orrery.llm.prefix_codes import Lanes, canonical_codes, huffman_lengths, length_tokens, read_lengths, tables
from orrery.llm.media import media_features, op7_webp_media, read_media, store_media
from orrery.llm.webp_encoder import META, META_CODES, Encoder, repeats


class Writer:
    def __init__(self):
        self.value = self.n = 0

    def put(self, v, n):
        self.value |= v << self.n
        self.n += n

    def fields(self, fields):
        for v, n in fields:
            self.put(v, n)

    def file(self):
        return webp.riff(self.value.to_bytes(-(-self.n // 8), "little"))


def write_pixels(w, pixels, width, cache_bits=0, main=True, copies=True, meta=None):
    """Literals, cache hits and copies of the pixels (uint32), coded by their own counts."""
    tokens, cache, at = [], [None] * (1 << cache_bits), 0
    while at < len(pixels):
        n = 1 if at == 0 or not copies else 0
        best = (0, 0)
        for back in (1, width, 3, 200) if copies else ():
            n = 0
            while back <= at and at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - back]:
                n += 1
            best = max(best, (n, back))
        step = 1
        key = (webp.CACHE_MULTIPLIER * int(pixels[at]) & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if best[0] >= 3:
            code = next((i + 1 for i in range(120) if webp.near_distance(i + 1, width) == best[1]), best[1] + 120)
            tokens.append(("copy", webp.prefix_symbol(best[0]), webp.prefix_symbol(code)))
            step = best[0]
        elif cache_bits and cache[key] == pixels[at]:
            tokens.append(("cache", key))
        else:
            tokens.append(("pixel", int(pixels[at])))
        for p in pixels[at : at + step]:
            if cache_bits:
                cache[(webp.CACHE_MULTIPLIER * int(p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += step
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    counts = [np.zeros(280 + (1 << cache_bits if cache_bits else 0), int), *(np.zeros(256, int) for _ in range(3)), np.zeros(40, int)]
    for t in tokens:
        if t[0] == "pixel":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                counts[k][t[1] >> shift & 255] += 1
        elif t[0] == "cache":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + t[1][0]] += 1
            counts[4][t[2][0]] += 1
    lengths, codes = [], []
    for c in counts:
        if (c > 0).sum() == 1 and c.argmax() > 255:
            c[0] += 1
        n = webp.code_lengths(c.tolist()) if (c > 0).sum() > 1 else [int(i == c.argmax()) for i in range(len(c))]
        w.fields(webp.write_code(n))
        lengths.append(n if (c > 0).sum() > 1 else [0] * len(c))
        codes.append(webp.canonical(n) if (c > 0).sum() > 1 else np.zeros(len(c), int))
    put = lambda k, s: w.put(int(codes[k][s]), lengths[k][s])
    for t in tokens:
        if t[0] == "pixel":
            for k, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                put(k, t[1] >> shift & 255)
        elif t[0] == "cache":
            put(0, 280 + t[1])
        else:
            put(0, 256 + t[1][0])
            w.put(t[1][2], t[1][1])
            put(4, t[2][0])
            w.put(t[2][2], t[2][1])


def start(width, height):
    w = Writer()
    w.fields([(width - 1, 14), (height - 1, 14), (1, 1), (0, 3)])
    return w


def picture(rng, width, height, colours=None):
    if colours:
        return rng.choice(np.array(colours, np.uint32), width * height)
    smooth = np.cumsum(rng.integers(-3, 4, (width * height, 4)), axis=0).astype(np.uint8)
    out = np.ascontiguousarray(smooth).view(np.uint32).ravel().copy()
    out[width * 3 : width * 4] = out[width * 2 : width * 3]
    return out


def decode(w):
    return webp.Decoder().decode([w.file()])[0].ravel()


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
def test_codes_copies_and_colour_cache(cache_bits):
    rng = np.random.default_rng(cache_bits)
    for colours in (None, [0xFF0000FF], list(range(0xFF102030, 0xFF102040))):
        p = picture(rng, 37, 23, colours)
        w = start(37, 23)
        w.put(0, 1)
        write_pixels(w, p, 37, cache_bits)
        assert (decode(w) == p).all()


def channels(p):
    return np.array([p & 255, p >> 8 & 255, p >> 16 & 255, p >> 24], dtype=np.int64)


def predict_slow(mode, l, t, tr, tl):  # noqa: E741
    avg = lambda a, b: (a + b) // 2
    if mode == 11:
        p = l + t - tl
        return l if abs(p - l).sum() < abs(p - t).sum() else t
    if mode == 13:
        m = avg(l, t)
        return np.array([min(255, max(0, int(a) + int((int(a) - int(b)) / 2))) for a, b in zip(m, tl, strict=True)])
    table = {0: np.array([0, 0, 0, 255]), 1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr)), 12: np.clip(l + t - tl, 0, 255)}
    return table[mode]


def test_predictor_modes():
    rng, width, height, bits = np.random.default_rng(3), 29, 17, 2
    p = picture(rng, width, height)
    across, down = -(-width >> bits), -(-height >> bits)
    modes = np.arange(across * down) % 14
    px, res = np.array([channels(int(x)) for x in p]), []
    for i in range(len(p)):
        y, x = divmod(i, width)
        black = np.array([0, 0, 0, 255])
        if y == 0:
            guess = px[i - 1] if x else black
        elif x == 0:
            guess = px[i - width]
        else:
            guess = predict_slow(int(modes[(y >> bits) * across + (x >> bits)]), px[i - 1], px[i - width], px[i - width + 1], px[i - width - 1])
        res.append((px[i] - guess) & 255)
    res = np.ascontiguousarray(np.array(res, np.uint8)).view(np.uint32).ravel()
    w = start(width, height)
    w.fields([(1, 1), (0, 2), (bits - 2, 3)])
    write_pixels(w, (modes << 8).astype(np.uint32), across, main=False)
    w.put(0, 1)
    write_pixels(w, res, width)
    assert (decode(w) == p).all()


def test_cross_colour_green_and_palette():
    rng, width, height, bits = np.random.default_rng(4), 21, 19, 3
    p = picture(rng, width, height)
    across, down = -(-width >> bits), -(-height >> bits)
    elements = rng.integers(0, 1 << 24, across * down).astype(np.uint32)
    signed = lambda v: v - 256 if v > 127 else v
    coded = []
    for i, c in enumerate(int(x) for x in p):
        y, x = divmod(i, width)
        e = int(elements[(y >> bits) * across + (x >> bits)])
        a, r, g, b = c >> 24, c >> 16 & 255, c >> 8 & 255, c & 255
        nr = (r - (signed(e & 255) * signed(g) >> 5)) & 255
        nb = (b - (signed(e >> 8 & 255) * signed(g) >> 5) - (signed(e >> 16 & 255) * signed(r) >> 5)) & 255
        coded.append(a << 24 | ((nr - g) & 255) << 16 | g << 8 | (nb - g) & 255)
    w = start(width, height)
    w.fields([(1, 1), (1, 2), (bits - 2, 3)])
    write_pixels(w, elements, across, main=False)
    w.fields([(1, 1), (2, 2), (0, 1)])
    write_pixels(w, np.array(coded, np.uint32), width)
    assert (decode(w) == p).all()
    for size in (1, 2, 3, 4, 9, 16, 17, 200):
        table = rng.integers(0, 1 << 32, size).astype(np.uint32)
        index = rng.integers(0, size, width * height)
        n = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
        packed_width = -(-width >> n)
        packed = np.zeros((height, packed_width), np.uint32)
        for i, v in enumerate(index):
            y, x = divmod(i, width)
            packed[y, x >> n] |= np.uint32(int(v) << ((x & ((1 << n) - 1)) * (8 >> n)))
        t = table.view(np.uint8).reshape(-1, 4)
        delta = np.diff(t, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        w = start(width, height)
        w.fields([(1, 1), (3, 2), (size - 1, 8)])
        write_pixels(w, np.ascontiguousarray(delta).view(np.uint32).ravel(), size, main=False)
        w.put(0, 1)
        write_pixels(w, (packed.ravel() << 8 | 0xFF000000).astype(np.uint32), packed_width)
        assert (decode(w) == table[index]).all(), size


def test_damaged_files_raise():
    e = Encoder()
    good = e.encode(np.random.default_rng(0).integers(0, 256, 704).astype(np.uint8), np.array([0, 704]))[0][0]
    short = good[:-300]
    short = short[:4] + (len(short) - 8).to_bytes(4, "little") + short[8:16] + (len(short) - 20).to_bytes(4, "little") + short[20:]
    for bad in (b"", good[:30], b"RIFX" + good[4:], good[:60], short):
        with pytest.raises(webp.WebPError):
            webp.Decoder().decode([bad])


TEXTS = [None, "", "a", "x" * 64, "é" * 33, "y" * 70000, "\x00\x00", "".join(chr(random.Random(i).randrange(32, 1200)) for i in range(9000)), "\U0001f600" * 5]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, b"other") for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, media binary")
    media = store_media(docs)
    got = {r.doc_id: r for r in media_features(media).collect()}
    pixels = {r.doc_id: r for r in read_media(media).collect()}
    assert len(got) == len(pixels) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS * 2):
        raw = (t or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == got[i % len(TEXTS)].media_sha256
        assert bytes(pixels[i].pixels[1::4]) == payload and set(pixels[i].pixels[3::4]) == {255}
    assert got[5].media_bytes < 5000
    assert media_features(store_media(docs.limit(0))).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = op7_webp_media(spark, d).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id]
        assert r.payload_sha256 == hashlib.sha256(raw + bytes((-len(raw)) % 64 or (0 if raw else 64))).hexdigest() and r.n_bytes == len(raw)


def form(file):
    """Which transform a file has."""
    first = file[25]
    return ("predictor", "cross-colour", "green", "palette")[first >> 1 & 3] if first & 1 else "none"


def test_forms_are_the_shortest_and_read_back():
    rng = random.Random(6)
    cases = {
        "none": "".join(rng.choices("etaoin shrdlu.", k=3000)) + "Zq#é",
        "palette": "".join(rng.choices("01", k=4000)),
        "palette 4": "".join(rng.choices("acgt", k=4000)),
        "palette 16": "".join(rng.choices(["ab", "cd", "ef", "gh", "ij", "kl"], k=2000)),
        "predictor": "".join(chr(33 + (i // 64 * 7 + i % 64 * 3 + rng.randrange(2)) % 90) for i in range(4096)),
    }
    for name, text in cases.items():
        raw = text.encode() + bytes(-len(text.encode()) % 64)
        files = Encoder().encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert {form(f) for f in files} == {name.split()[0]}, name
        assert b"".join(((x.ravel() >> 8) & 255).astype(np.uint8).tobytes() for x in webp.Decoder().decode(files)) == raw
    # all in one call, each many times, in any order: the same files
    texts = [cases[k] for k in rng.choices(list(cases), k=40)] + [""]
    raws = [t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64)) for t in texts]
    e = Encoder()
    many = e.encode(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]))
    for raw, files in zip(raws, many, strict=True):
        assert files == e.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    flat = [f for g in many for f in g]
    back = [((x.ravel() >> 8) & 255).astype(np.uint8).tobytes() for x in webp.Decoder().decode(flat)]
    assert b"".join(back) == b"".join(raws)


def test_repeats_are_equal_and_apart():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 103, 9).astype(np.uint8)) for _ in range(30)]
    data = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 30, 2000)) + b"z" * 9000, np.uint8)
    cuts = np.append(np.arange(0, len(data), 4096), len(data))
    at, length, back = repeats(data, cuts)
    assert len(at) > 50 and (at[1:] >= at[:-1] + length[:-1]).all() and length.max() == 4095 and (back > 1).any()
    for a, n, d in zip(at.tolist(), length.tolist(), back.tolist(), strict=True):
        image = int(np.searchsorted(cuts, a, side="right")) - 1
        assert a - d >= cuts[image] and a + n <= cuts[image + 1] and all(data[a + k] == data[a + k - d] for k in range(n))


def test_prefix_codes_equal_the_scalar_ones():
    rng = np.random.default_rng(5)
    counts = np.where(rng.random((60, 280)) < 0.2, rng.integers(1, 5000, (60, 280)), 0)
    counts[0] = 0
    counts[0, 7], counts[1] = 3, 1
    counts[2] = np.where(np.arange(280) < 30, 2 ** np.minimum(np.arange(280), 40), 0)  # needs a limit
    counts[3] = 0
    counts[3, [1, 279]] = 5
    got = huffman_lengths(counts, 12)
    assert got.max() <= 12 and ((got > 0) == (counts > 0)).all()
    for row, c in zip(got, counts, strict=True):
        if (c > 0).sum() > 1:
            assert sum(2.0 ** -int(n) for n in row[row > 0]) == 1.0
            if c.max() < 5000 and (c > 0).sum() > 2:
                slow = np.array(webp.code_lengths(c.tolist()))
                assert (slow * c).sum() == (row * c).sum() or slow.max() > 12
    codes = canonical_codes(got)
    assert all((codes[i] == webp.canonical(got[i])).all() for i in range(60))
    flat, starts = tables(got)
    for i in range(60):
        table = flat[starts[i] : starts[i + 1]]
        for s in np.flatnonzero(got[i]):
            n = int(got[i, s]) if (got[i] > 0).sum() > 1 else 0
            assert (table[int(codes[i, s]) :: 1 << n] == s << 4 | n).all() or n == 0 and table.tolist() == [s << 4]
    row, token, extra, bits = length_tokens(got)
    streams = []
    for i in range(60):
        w = Writer()
        w.fields([(0, 1), (15, 4), *((int(META[s]), 3) for s in webp.CODE_LENGTH_ORDER), (0, 1)])
        for t, x, k in zip(token[row == i], extra[row == i], bits[row == i], strict=True):
            w.put(int(META_CODES[t]), int(META[t]))
            w.put(int(x), int(k))
        streams.append(w.value.to_bytes(-(-w.n // 8), "little"))
    assert (read_lengths(Lanes(streams), 280) == got).all()


def test_the_query_reads_stored_files_with_their_own_codes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = [bytes(f) for r in store_media(docs).collect() for f in r.media]
    heads = webp.read_plain_heads([webp.stream_of(f) for f in files if form(f) == "none"])
    assert len({h.groups[0][0].tobytes() for h in heads}) > 0.9 * len(set(files)) and sum(len(h.groups[0][4]) > 1 for h in heads) > 0.2 * len(heads)
    plan = op7_webp_media(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "media" in plan
