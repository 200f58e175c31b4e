"""Removal of repeated byte strings, by suffix order.

A byte goes if a string of ``length`` bytes over it also starts earlier: in a
document with a smaller key, or in the same document further left.  Every window
of that length is judged, but only few are handled one by one:

1. Each window has a minimiser, the ``gram``-byte string in it with the least hash.
   Neighbouring windows with the same minimiser make a *stretch*; equal windows
   lie in stretches with equal minimisers at equal distances.
2. Stretches with one minimiser are compared by their bytes.  Suffixes from the
   minimiser on, and prefixes before it read backwards, are put in order by
   deep-shallow sorting; two windows are equal if their suffix and prefix have long
   enough common parts with all rows between them.  The first of equal windows stays.
3. A task does that for the stretches that it holds at once and drops those without a
   first window, so that a passage that all documents share leaves a task but once.
   The others, without bytes, are shuffled by minimiser: about one for forty bytes.
4. Where a minimiser still has several stretches, their bytes are fetched and step 2
   is done for all of them.  The stretches of a very frequent minimiser are cut in two,
   into windows that start near it and further from it, and dealt out by the bytes
   that such windows share beside it.  Groups that are still too large for a task are
   compared in parts of bounded size, whose first windows are compared once more,
   by their bytes.

Hashes only choose what is compared: no byte goes because hashes are equal.

Defined results: null and short texts lose nothing; rows with a null key lose
nothing and repeat nothing.  A key names a document: rows of one key and text
are the same document and don't repeat each other.  Empty tables give no rows.
Further columns are ignored.  Keys are integers, as they say which of equal strings
is first; a key of another type is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.deep_shallow import neighbour_lcp, sort_strings, words_of
from orrery.llm.store import Table, fresh, gathered, integral, near, release, split
from orrery.llm.textops import U64, blocks, hash_spans, mix, text_bytes, words64

STRETCH, MARK, BEACON = 0, 1, 2

@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 24
    flush: int = 60_000  # stretches that a task holds at once
    hot: int = 256  # stretches of one minimiser in a flush from which on they are dealt out
    unit: int = 4 << 20  # bytes of a long document that are looked at together
    part: int = 4_000  # stretches of one minimiser from which on they are dealt out by more bytes
    held: int = 10_000  # stretches of a group that are sorted together
    spread: int = 250_000  # stretches of one minimiser for each random part

    def __post_init__(self):
        if not 8 <= self.gram <= self.length:
            raise ValueError("a gram has at least 8 bytes and at most the length")
        if not 0 < self.unit <= (1 << 23) - self.length:
            raise ValueError("places in a unit have 23 bits")


def stretches(data: np.ndarray, offsets: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, minimiser) of each stretch; places count from the buffer's start."""
    none = np.zeros(0, np.int64)
    n = len(data) - s.length + 1
    if n <= 0:
        return none, none, none, none
    view, grams, h = words64(data), len(data) - s.gram + 1, None
    for k in sorted({*range(0, s.gram - 7, 8), s.gram - 8}):
        part = view[k : k + grams]
        h = mix(part + U64(k)) if h is None else (h * U64(0x9E3779B97F4A7C15)) ^ (part * U64(0xC2B2AE3D27D4EB4F))
    h = mix(h)
    m = (h & ~U64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, s.length - s.gram + 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    sizes = np.diff(offsets)
    valid = np.zeros(n + 1, np.int8)
    long = sizes >= s.length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - s.length + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    new[offsets[:-1][long]] = True
    end = valid.copy()
    end[:-1] &= new[1:] | ~valid[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    return np.searchsorted(offsets, first, side="right") - 1, first, last, (m[first] & U64((1 << 23) - 1)).astype(np.int64)


def spans_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans per document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    lift = int(end.max()) + 1
    if lift * (int(group[-1]) + 1) >= 1 << 62:
        raise ValueError("too many bytes in one batch")
    reach = np.maximum.accumulate(end + group * lift) - group * lift
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


#: Rows of tasks.  A mark has its span in ``lo`` and ``hi``; a stretch has there how far its minimiser ``at`` is behind its first and last window's start.
COLUMNS = T.StructType([T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("salt", "gram", "doc", "lo", "hi", "at"))])


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = next(len(c) for c in columns if not np.isscalar(c))
    full = [pa.array(np.full(n, c, np.int64) if np.isscalar(c) else c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *full], names=COLUMNS.names)


def _marks(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Removed spans, dealt out by document."""
    doc, start, end = spans_of(doc, start, end)
    return _rows(MARK, 0, mix(doc.view(np.uint64)).view(np.int64), doc, start, end, 0)


@dataclass
class Stretches:
    """Stretches in order of (group, document, place), with their suffixes and prefixes as words."""

    group: np.ndarray
    doc: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    right: np.ndarray
    left: np.ndarray


def stretches_of(data: np.ndarray, middle: np.ndarray, group, doc, lo, hi, at, s: Settings) -> Stretches:
    """``middle``: the minimisers' places in ``data``."""
    width = -(-s.length // 8)
    right = words_of(data, middle, np.minimum(hi + s.length - at, s.length), width)
    return Stretches(group, doc, lo, hi, at, right, words_of(data, middle, at - lo, width, True))


def equal_windows(x: Stretches, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first starts, last starts, fresh, repeated): for each row, whether its windows that start there are the first of their kind, or repeat an earlier place.

    Copies of a whole stretch come first, then, for each distance of a window's start
    before its minimiser, the windows of all other rows.
    """
    n = len(x.group)
    ranks = []
    for words in (x.right, x.left):
        order = sort_strings(words, x.group)
        ranks.append((order, neighbour_lcp(words, order, x.group)))
    cls = [np.empty(n, np.int64), np.empty(n, np.int64)]

    def heads(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row is the first with its key, and the row that is."""
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        first = np.empty(len(key), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        return first == np.arange(len(key)), first

    def classes(depths: tuple[int, int]) -> np.ndarray:
        for side, depth in enumerate(depths):
            order, lcp = ranks[side]
            cls[side][order] = np.cumsum(lcp < depth)
        return cls[0] * (n + 1) + cls[1]

    least, most = x.at - x.hi, x.at - x.lo
    fresh, first = heads((classes((length, length)) * (length + 1) + least) * (length + 1) + most)
    copies = np.flatnonzero(~fresh)
    if len(copies):
        of = first[copies]
        yield copies, x.lo[copies], x.hi[copies], np.zeros(len(copies), bool), (x.doc[copies] != x.doc[of]) | (x.at[copies] != x.at[of])
    rest = np.flatnonzero(fresh)
    for d in range(int(least.min()), int(most.max()) + 1):
        rows = rest[(least[rest] <= d) & (d <= most[rest])]
        if len(rows):
            new, first = heads(classes((length - d, d))[rows])
            of = rows[first]
            yield rows, x.at[rows] - d, x.at[rows] - d, new, ~new & ((x.doc[rows] != x.doc[of]) | (x.at[rows] != x.at[of]))


class Spans:
    """Spans of documents; those gathered are joined before they get many, as a repeat of n windows gives n spans that overlap."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.size, self.parts = most, 0, []

    def add(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(doc):
            self.parts.append((doc, start, end))
            self.size += len(doc)
            if self.size > self.most:
                self.parts = [self.joined()]
                self.size = len(self.parts[0][0])
                self.most = max(self.most, 2 * self.size)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return spans_of(*(np.concatenate(c) for c in zip(*self.parts, strict=True))) if self.parts else (none, none, none)


def _scan(s: Settings):
    def flush(held: list[tuple], units: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, doc, lo, hi, at, middle = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((at, doc, gram))
        gram, doc, lo, hi, at, middle = (c[order] for c in (gram, doc, lo, hi, at, middle))
        group = np.cumsum(np.append(0, gram[1:] != gram[:-1]))
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        left = np.ones(len(gram), bool)
        if len(several):
            left[several] = False
            x, marks = stretches_of(np.concatenate(units), middle[several], *(c[several] for c in (group, doc, lo, hi, at)), s), Spans()
            for rows, a, b, fresh, repeated in equal_windows(x, s.length):
                left[several[rows[fresh]]] = True
                marks.add(x.doc[rows[repeated]], a[repeated], b[repeated] + s.length)
            if marks.size:
                yield _marks(*marks.joined())
        gram, group, doc, lo, hi, at = (c[left] for c in (gram, group, doc, lo, hi, at))
        hot = np.bincount(group)[group] > s.hot
        salt = np.where(hot, 1 + (mix((doc + 31 * at).view(np.uint64)) & U64(1023)).astype(np.int64), 0)
        for i in range(0, len(gram), 20_000):
            yield _rows(STRETCH, *(c[i : i + 20_000] for c in (salt, gram, doc, at - lo, at - hi, at)))
        if hot.any():
            beacons = np.unique(gram[hot])
            yield _rows(BEACON, 0, beacons, np.iinfo(np.int64).min, 0, 0, np.zeros(len(beacons)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, units, size, room = [], [], 0, 0
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in blocks(offsets, min(1 << 19, s.unit)):
                begin, stop = int(offsets[i]), int(offsets[j])
                for a in range(begin, max(begin + 1, stop), s.unit):  # only a document that stands alone can be longer
                    unit = data[a : min(stop, a + s.unit + s.length - 1)]
                    cut = offsets[i : j + 1] - a if stop - begin <= s.unit else np.array([0, len(unit)])
                    d, lo, hi, at = stretches(unit, cut, s)
                    if not len(d):
                        continue
                    gram = hash_spans(unit, at, at + s.gram).view(np.int64)
                    base = cut[d] if stop - begin <= s.unit else begin - a
                    held.append((gram, keys[i + d], lo - base, hi - base, at - base, at + room))
                    units.append(unit.copy())
                    size, room = size + len(d), room + len(unit)
                    if size >= s.flush:
                        yield from flush(held, units)
                        held, units, size, room = [], [], 0, 0
        if held:
            yield from flush(held, units)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (salt, gram): marks, and stretches whose minimiser has others."""
    waiting, known = None, None  # the last group: its only row so far, or its name if it has several
    for b in batches:
        kind = b.column(0).to_numpy()
        yield b.filter(pa.array(kind == MARK))
        rows = [b.column(c).to_numpy()[kind != MARK] for c in range(len(COLUMNS))]
        if not len(rows[0]):
            continue
        if waiting is not None:
            rows = [np.concatenate([x, c]) for x, c in zip(waiting, rows, strict=True)]
        kind, salt, gram = rows[:3]
        new = np.append(True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group] | (salt > 0)
        if known == (salt[0], gram[0]):
            several |= group == 0
        last = len(gram) - 1
        waiting, known = ([c[last:].copy() for c in rows], None) if not several[last] else (None, (salt[last], gram[last]))
        take = several & (kind == STRETCH)
        if take.any():
            yield _rows(STRETCH, 0, *(c[take] for c in rows[2:]))


def _compare(s: Settings):
    """Groups of (gram, part) in a sorted partition: marks, and for groups in parts each first window with its bytes."""
    names = ["kind", "gram", "window", "doc", "lo", "hi", "content"]

    def batch(kind, gram, window, doc, lo, hi, content: pa.Array) -> pa.RecordBatch:
        cols = [np.full(len(doc), kind), gram, window, doc, lo, hi]
        return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), content], names=names)

    def handle(rows: pa.Table, large: tuple | None) -> Iterator[pa.RecordBatch]:
        """``large``: the group of which only some rows are here."""
        gram, part, parts, doc, lo, hi, at = (rows.column(c).to_numpy() for c in range(7))
        lo, hi = at - lo, at - hi
        if large:
            parts = np.where((gram == large[0]) & (part == large[1]), 2, parts)
        data, offsets = text_bytes(rows.column(7))
        order = np.lexsort((at, doc, part, gram))
        group = np.cumsum(np.append(0, (gram[order][1:] != gram[order][:-1]) | (part[order][1:] != part[order][:-1])))
        gram, parts, doc, lo, hi, at = (c[order] for c in (gram, parts, doc, lo, hi, at))
        middle = offsets[:-1][order] + (at - lo)
        marks = Spans()
        for i, a, b, fresh, repeated in equal_windows(stretches_of(data, middle, group, doc, lo, hi, at, s), s.length):
            marks.add(doc[i[repeated]], a[repeated], b[repeated] + s.length)
            open_ = fresh & (parts[i] > 1)
            k, first = i[open_], a[open_]
            for x in range(0, len(k), 1 << 14):
                some, begin = k[x : x + (1 << 14)], first[x : x + (1 << 14)]
                start = middle[some] - (at[some] - begin)
                window = mix(hash_spans(data, start, start + s.length) ^ (at[some] - begin).astype(np.uint64)).view(np.int64)
                body = np.ascontiguousarray(data[start[:, None] + np.arange(s.length)])
                yield batch(STRETCH, gram[some], window, doc[some], begin, begin + s.length, pa.FixedSizeBinaryArray.from_buffers(pa.binary(s.length), len(some), [None, pa.py_buffer(body)]).cast(pa.binary()))
        d, a, b = marks.joined()
        yield batch(MARK, d, d, d, a, b, pa.nulls(len(d), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, large = 0, None
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= s.held:
                rows = pa.Table.from_batches(held).combine_chunks()
                gram, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                edge = np.flatnonzero((gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))
                cut = int(edge[-1]) + 1 if len(edge) else rows.num_rows
                if not len(edge):
                    large = (gram[0], part[0])
                yield from handle(rows.slice(0, cut).combine_chunks(), large)
                held = rows.slice(cut).to_batches()
                size = rows.num_rows - cut
        if size:
            yield from handle(pa.Table.from_batches(held).combine_chunks(), large)

    return run, "kind long, gram long, window long, doc long, lo long, hi long, content binary"


def dealt_out(cols: dict[str, np.ndarray], place: np.ndarray, data: np.ndarray, begin: np.ndarray, s: Settings) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Stretches of very frequent minimisers (``hot``) in two, by the distance of their windows' starts, named by the bytes that all windows there share."""
    hot, middle = cols["hot"].astype(bool), (s.length - s.gram) // 2
    cold = {c: v[~hot] for c, v in cols.items()}
    out, places = [cold], [place[~hot]]
    some, at = {c: v[hot] for c, v in cols.items()}, place[hot]
    for far in (False, True):
        border = some["at"] - middle  # windows that start here or later are near
        half = some | ({"hi": np.minimum(some["hi"], border - 1)} if far else {"lo": np.maximum(some["lo"], border)})
        have = half["lo"] <= half["hi"]
        half, where = {c: v[have] for c, v in half.items()}, at[have]
        text = begin[where] + half["at"]
        shared = hash_spans(data, text - middle - 1, text + s.gram) if far else hash_spans(data, text, text + s.length - middle)
        half["gram"] = mix(half["gram"].view(np.uint64) ^ shared ^ U64(far)).view(np.int64)
        out.append(half)
        places.append(where)
    return {c: np.concatenate([x[c] for x in out]) for c in cols}, np.concatenate(places)


def _contents(s: Settings):
    """Each wanted stretch of a document with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            wanted = b.column(2)
            flat, sizes = wanted.flatten(), wanted.value_lengths().to_numpy()
            cols = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
            cols |= {c: cols["at"] - cols[c] for c in ("lo", "hi")}
            place = np.repeat(np.arange(b.num_rows), sizes)
            cols, place = dealt_out(cols, place, data, offsets[:-1], s)
            at = offsets[:-1][place]
            starts = at + cols["lo"]
            lengths = cols["hi"] - cols["lo"] + s.length
            to = np.concatenate([[0], np.cumsum(lengths)])
            for i, j in blocks(to, 4 << 20):
                take = np.arange(to[j] - to[i]) + np.repeat(starts[i:j] - (to[i:j] - to[i]), lengths[i:j])
                content = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(to[i : j + 1] - to[i]), pa.py_buffer(data[take])]).cast(pa.binary())
                doc = b.column(0).to_numpy()[place[i:j]]
                places = (cols["at"] - cols["lo"], cols["at"] - cols["hi"], cols["at"])
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[c][i:j]) for c in ("gram", "part", "parts")), pa.array(doc), *(pa.array(c[i:j]) for c in places), content], names=["gram", "part", "parts", "doc", "lo", "hi", "at", "content"])

    return run, "gram long, part long, parts long, doc long, lo long, hi long, at long, content binary"


def _windows_settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (gram, window, doc, lo), those whose bytes an earlier one has, as spans."""
    name, firsts = None, {}  # the group at hand, and its contents' first places
    for b in batches:
        gram, window, doc, lo, hi = (b.column(c).to_numpy() for c in range(5))
        contents = b.column(5).to_pylist()
        repeat = np.zeros(len(gram), bool)
        for i, (group, place, content) in enumerate(zip(zip(gram.tolist(), window.tolist(), strict=True), zip(doc.tolist(), lo.tolist(), strict=True), contents, strict=True)):
            if group != name:
                name, firsts = group, {}
            repeat[i] = firsts.setdefault(content, place) != place
        d, a, e = spans_of(doc[repeat], lo[repeat], hi[repeat])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(e)], names=["doc", "lo", "hi"])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), passing: list[Table] | None = None) -> DataFrame:
    """(doc, lo, hi): byte spans to remove, possibly overlapping.  ``passing`` gets the tables that the result is read from."""
    s = settings
    texts = docs.select(integral(docs, key).alias("doc"), F.col(text).cast("binary").alias("text")).filter(F.col("doc").isNotNull() & (F.octet_length("text") >= s.length))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(_scan(s), COLUMNS).repartition(n, "salt", "gram").sortWithinPartitions("salt", "gram")
    settled = Table(gathered(dealt.mapInArrow(_settle, COLUMNS)), "stretches")
    marks = settled.frame().filter(F.col("kind") == MARK).select("doc", "lo", "hi")
    open_ = settled.frame().filter(F.col("kind") == STRETCH).select("gram", "doc", "lo", "hi", "at")
    release(docs.sparkSession)
    # written, so that the join has an exchange on either side, whose hot partitions can be split
    many = Table(gathered(open_.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > s.part)), "many")
    parts = F.coalesce(F.ceil(F.col("n") / s.spread), F.lit(1)).cast("long")
    numbered = open_.join(many.frame(), "gram", "left").select("doc", "gram", "lo", "hi", "at", F.col("n").isNotNull().alias("hot"), F.pmod(F.xxhash64("doc", "at"), parts).alias("part"), parts.alias("parts"))
    wanted = Table(gathered(numbered.groupBy("doc").agg(F.collect_list(F.struct("gram", "part", "parts", "hot", "lo", "hi", "at")).alias("wanted"))), "wanted")
    release(docs.sparkSession)
    fetched = near(texts, "doc", wanted.frame().select("doc")).join(wanted.frame(), "doc").select("doc", "text", "wanted").mapInArrow(*_contents(s))
    compared = Table(gathered(fetched.repartition(n, "gram", "part").sortWithinPartitions("gram", "part").mapInArrow(*_compare(s))), "windows")
    release(docs.sparkSession)
    many.drop()
    wanted.drop()
    if passing is not None:
        passing += [settled, compared]
    windows = compared.frame().filter(F.col("kind") == STRETCH).select("gram", "window", "doc", "lo", "hi", "content")
    late = windows.repartition(n, "gram", "window").sortWithinPartitions("gram", "window", "doc", "lo").mapInArrow(_windows_settle, "doc long, lo long, hi long")
    return marks.union(compared.frame().filter(F.col("kind") == MARK).select("doc", "lo", "hi")).union(late)


OUT = ("n_bytes", "n_removed", "n_spans", "kept")


def _cut(names: list[str], whole_characters: bool, out: tuple[str, ...]):
    """Applies spans to texts: (other columns, text, spans) to (other columns, n_bytes, n_removed, n_spans, kept)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in blocks(text_bytes(b.column(len(names)))[1]):
                yield from cut([b.slice(i, j - i)])

    def cut(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = len(names)
            data, offsets = text_bytes(b.column(k))
            spans = b.column(k + 1)
            flat, sizes = spans.flatten(), np.nan_to_num(np.asarray(spans.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
            lo, hi = (flat.field(c).to_numpy() for c in (0, 1))
            row, lo, hi = spans_of(np.repeat(np.arange(len(sizes)), sizes), lo, hi)
            base = offsets[row]
            lo, hi = np.minimum(base + lo, offsets[row + 1]), np.minimum(base + hi, offsets[row + 1])
            if whole_characters and len(row):
                inside = np.append((data & 0xC0) == 0x80, False)
                for _ in range(3):
                    lo, hi = lo + (inside[lo] & (lo < hi)), hi - (inside[hi] & (lo < hi))
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, lo, 1)
            np.add.at(gone, hi, -1)
            gone = np.cumsum(gone[:-1]) > 0
            to = np.concatenate([[0], np.cumsum(gone)])
            removed = to[offsets[1:]] - to[offsets[:-1]]
            n_spans = np.bincount(row[hi > lo], minlength=len(sizes))
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets - to[offsets]), pa.py_buffer(data[~gone])])
            kept = pc.if_else(b.column(k).is_null(), pa.scalar(None, pa.binary()), kept.cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), kept], names=[*names, *out])

    return run


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings(), keep: tuple[str, ...] = (), whole_characters: bool = False, out: tuple[str, ...] = OUT) -> DataFrame:
    """Per row: the key, the columns to keep, and n_bytes, n_removed, n_spans, kept (the remaining bytes; null for null), named ``out``.

    ``whole_characters``: a span gives up bytes at its ends rather than cut a character.
    """
    of, spans_, body = fresh(docs.columns, "of", "spans", "body")
    passing: list[Table] = []
    found = repeated_spans(docs, key, text, settings, passing).groupBy(F.col("doc").alias(of))
    table = Table(gathered(found.agg(F.collect_list(F.struct("lo", "hi")).alias(spans_))), "spans")
    for t in passing:
        t.drop()
    spans = table.frame()
    release(docs.sparkSession)
    names = [key, *keep]
    # documents without spans, most of them, aren't shuffled
    rows, rest = split(docs.select(*names, F.col(text).cast("binary").alias(body)), key, table.frame().select(of))
    joined = rows.join(spans, rows[key].cast("long") == spans[of], "left").select(*(rows[c] for c in names), rows[body], spans[spans_])
    joined = joined.union(rest.withColumn(spans_, F.lit(None).cast(joined.schema[spans_].dataType)))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in out[:3]] + [T.StructField(out[3], T.BinaryType())])
    return joined.mapInArrow(_cut(names, whole_characters, out), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def repeats_stage(docs: DataFrame, settings: Settings = Settings(length=200, gram=48)) -> DataFrame:
    """The documents without their repeated strings of 200 bytes and more, about 30 words.

    ``n_chars``, if there is such a column, follows the text.  A document of which nothing is left goes.
    """
    names = docs.columns
    out = tuple(fresh(names, *OUT))
    cut = cut_repeats(docs, settings=settings, keep=tuple(c for c in names if c not in ("doc_id", "text")), whole_characters=True, out=out)
    changed = F.col(out[1]) > 0
    text = F.col(out[3]).cast("string")
    new = {"text": text}
    if "n_chars" in names:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return gathered(cut.filter(~changed | (F.octet_length(out[3]) > 0)).select(*(new[c].alias(c) if c in new else F.col(c) for c in names)))
