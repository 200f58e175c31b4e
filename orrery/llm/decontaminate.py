"""Benchmark decontamination by latent semantic retrieval.

1. Words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, letters of ASCII and Latin-1 lower-cased) of every document are hashed;
   the passages of a fixed number of words that their buckets occur in are counted over
   all documents.
2. These passages become TF-IDF rows, each divided by the root
   of its words' squared weights.  A randomised SVD of all passages is computed in
   two distributed passes: tasks send sums of the size of the basis, never rows.
3. Windows of two widths over whole documents, a step of words apart, are
   projected (divided by the singular values, so that no direction dominates) and
   compared with the benchmark's items by cosine: near ones are candidates.
4. Cosines fall with the share of a window that an item fills, so they alone lose items
   much shorter or longer than the windows.  Each place where as many of an item's rarest
   words stand within a window of its length as any leak must have is a candidate too:
   together these are a superset of all leaks, whatever the item's length and words.
5. Around each candidate, the longest common subsequence of words with the item is
   computed in windows of about the item's length.  A document leaks the item if it
   has ``sure`` of its words in order, or ``least`` of them together with the
   item's answer: its last words, of which ``answer`` must be there in order.  An item
   of fewer than ``least_words`` words is leaked where all its words stand in a row.

The items are sent to tasks in blocks of at most ``block`` items.  What tasks sum up
is added in a tree, so that no task reads more than ``fan`` parts of a sum.

Defined results: null or empty documents or items, or those without words, match
nothing.  Rows of one key are each searched, and their matches are given once per key
and item; so are items that occur twice.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.store import Table, fresh
from orrery.llm.textops import ALNUM, LOWER, blocks, hash_spans, mix, runs, text_bytes


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 13
    rank: int = 128
    extra: int = 16  # further directions of the random basis
    signs: int = 4  # random combinations that a row is added to
    passage: int = 48  # words of a row of the matrix
    step: int = 24  # words between windows
    widths: tuple[int, ...] = (1, 2)  # of windows, in steps
    common: float = 0.25  # buckets in a larger share of passages carry no weight; items of such words are found by their seeds
    cosine: float = 0.45
    sure: float = 0.7
    least: float = 0.5
    answer: float = 0.8
    answer_words: int = 8
    least_words: int = 8  # of an item that some of its words tell
    hits: float = 0.02  # words of a text that may be rare words of one item, if the rule leaves the choice
    block: int = 10_000
    fan: int = 32  # parts that are added at once
    seed: int = 11


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of each text, and the offsets of each text's words."""
    low = LOWER[data]
    # the capitals of Latin-1: C3 and 80 to 9E but for the multiplication sign
    capital = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) if len(low) else np.zeros(0, np.int64)
    low[capital + 1] += 0x20
    starts, ends = runs(ALNUM[low], offsets)
    return (hash_spans(low, starts, ends) >> np.uint64(32)).astype(np.uint32), np.searchsorted(starts, offsets)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in blocks(offsets):
            cut = offsets[i : j + 1]
            words, to = word_hashes(data[cut[0] : cut[-1]], cut - cut[0])
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(4 * to), pa.py_buffer(words)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), column], names=["doc", "words"])


def _batches(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, words, offsets) of a bounded number of words, or one document."""
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in blocks(offsets, 4 * limit):
            cut = offsets[i : j + 1]
            yield b.column(0).slice(i, j - i), np.frombuffer(data[cut[0] : cut[-1]].tobytes(), np.uint32), (cut - cut[0]) // 4


def frequencies(words: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """Passages in which each bucket occurs, and passages: their size doesn't grow with the documents'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(s.buckets + 1, np.int64)
        for _, w, offsets in _batches(batches, 1 << 17):
            bucket = np.sort(cells(w, segments(offsets, s.passage), s.passage, s.buckets).astype(np.min_scalar_type(s.buckets)), axis=1)
            new = np.ones(bucket.shape, bool)
            new[:, 1:] = bucket[:, 1:] != bucket[:, :-1]
            counts[:-1] += np.bincount(bucket[new], minlength=s.buckets + 1)[:-1]
            counts[-1] += len(bucket)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    out = np.zeros(s.buckets + 1, np.int64)
    for r in words.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most buckets + 1 rows
        out[r.bucket] = r.n
    return out[:-1], int(out[-1])


def weights(df: np.ndarray, n: int, s: Settings) -> np.ndarray:
    idf = np.log((1 + n) / (1 + df))
    return np.where(df > s.common * n, 0.0, idf).astype(np.float32)


def segments(offsets: np.ndarray, size: int) -> np.ndarray:
    """Starts of runs of ``size`` words of each document, the last of a document may be shorter."""
    n = -(-np.diff(offsets) // size)
    return np.repeat(offsets[:-1], n) + size * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def cells(words: np.ndarray, starts: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """The buckets of each segment's words (segments, size), filled up with ``buckets``."""
    lengths = np.diff(np.append(starts, len(words)))
    out = np.full((len(starts), size), buckets, np.int64)
    out.ravel()[np.arange(len(words)) + np.repeat(size * np.arange(len(starts)) - starts, lengths)] = words % buckets
    return out


def filled(table: np.ndarray) -> np.ndarray:
    """The table with a row of zeros for the fill of :func:`cells`."""
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])


def row_sums(bucket: np.ndarray, table: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Sums of a filled table's rows over the cells of each segment, some segments at a time so that they stay in the cache."""
    n, size = bucket.shape
    out = np.zeros((n, table.shape[1]), np.float32)
    for i in range(0, n, chunk):
        some, total = bucket[i : i + chunk], out[i : i + chunk]
        for k in range(size):
            total += table.take(some[:, k], axis=0)
    return out


def scales(bucket: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """What a passage's row is multiplied with: one over the root of its words' squared weights."""
    return 1 / np.sqrt(np.maximum(filled(idf**2).take(bucket).sum(axis=1), 1e-9))


def _part(i: int, x: np.ndarray) -> pa.RecordBatch:
    """A part of this task's sum."""
    return pa.RecordBatch.from_arrays([pa.array([i]), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.ascontiguousarray(x, np.float64).tobytes()], pa.binary())], names=["part", "task", "body"])


def _sum_binary(frame: DataFrame, parts: int, tasks: int, fan: int) -> np.ndarray:
    """The sum of the arrays that tasks sent as (part, task, body) rows, part by part, ``fan`` tasks' parts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]]), pa.array([total.tobytes()], pa.binary())], names=["part", "task", "body"])
        for b in batches:
            for at, body in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2), strict=True):
                x = np.frombuffer(body.as_py(), np.float64)
                if at == name:
                    total = total + x
                    continue
                if name is not None:
                    yield row()
                name, total = at, x
        if name is not None:
            yield row()

    places = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        tasks = -(-tasks // fan)
        near = frame.select("part", F.floor(F.col("task") / fan).cast("long").alias("task"), "body")
        frame = near.repartition(min(parts * tasks, max(places, parts)), "part", "task").sortWithinPartitions("part", "task").mapInArrow(run, PART)
        if tasks <= 1:
            break
    got = frame.collect()  # a row for each part
    return np.concatenate([np.frombuffer(r.body, np.float64) for r in sorted(got, key=lambda r: r.part)]) if got else np.zeros(0)


PART = "part long, task long, body binary"


def singular_basis(words: DataFrame, idf: np.ndarray, s: Settings) -> np.ndarray:
    """(buckets, rank): right singular vectors of all passages, divided by their singular values.

    The first pass adds every row, with random signs, to a few of ``rank + extra``
    combinations (a sparse random test matrix): their orthonormal basis Q spans the
    leading row space.  The second sums (A Q)'(A Q), which gives the directions in it.
    """
    width, parts = s.rank + s.extra, 64

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((width, s.buckets + 1)), filled(idf.astype(np.float64))
        for _, w, offsets in _batches(batches, 1 << 17):
            starts = segments(offsets, s.passage)
            if not len(starts):
                continue
            bucket = cells(w, starts, s.passage, s.buckets)
            value = (weight.take(bucket) * scales(bucket, idf)[:, None]).ravel()
            # signs and combinations follow from a row's words, so that a task run again gives the same
            draw = mix((bucket * np.arange(1, s.passage + 1)).sum(axis=1).astype(np.uint64) + np.uint64(s.seed))
            for k in range(s.signs):
                draw = mix(draw + np.uint64(k + 1))
                sign, row = 1.0 - 2.0 * (draw & np.uint64(1)).astype(np.float64), ((draw >> np.uint64(8)) % np.uint64(width)).astype(np.int64)
                at = (row[:, None] * (s.buckets + 1) + bucket).ravel()
                total += np.bincount(at, value * np.repeat(sign, s.passage), total.size).reshape(total.shape)
        if total.any():
            for i, x in enumerate(np.array_split(np.ascontiguousarray(total[:, :-1].T), parts)):
                yield _part(i, x)

    tasks = words.rdd.getNumPartitions()
    total = _sum_binary(words.mapInArrow(first, PART), parts, tasks, s.fan)
    if not len(total):
        return np.zeros((s.buckets, 1), np.float32)
    q, _ = np.linalg.qr(total.reshape(s.buckets, width))
    table = filled((q * idf[:, None]).astype(np.float32))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width, width), np.float64)
        for _, w, offsets in _batches(batches, 1 << 17):
            bucket = cells(w, segments(offsets, s.passage), s.passage, s.buckets)
            c = row_sums(bucket, table) * scales(bucket, idf).astype(np.float32)[:, None]
            gram += c.T @ c
        for i, x in enumerate(np.array_split(gram, 8)):
            yield _part(i, x)

    gram = _sum_binary(words.mapInArrow(second, PART), 8, tasks, s.fan).reshape(width, width)
    value, vector = np.linalg.eigh(gram)
    lead = np.argsort(-value)[: s.rank]
    lead = lead[value[lead] > 1e-6 * max(value.max(), 1e-12)]
    return (q @ vector[:, lead] / np.sqrt(value[lead])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def lcs(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a bit per word of the pattern."""
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        m = masks.get(w)
        if m:
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return len(pattern) - v.bit_count()


def window(m: int, s: Settings = Settings()) -> int:
    """Words of the windows in which an item of ``m`` words is compared."""
    return m if m < s.least_words else m + m // 4 + 2


def least_common(m: int, s: Settings) -> int:
    """Words of an item of ``m`` words that any leak has in order."""
    return m if m < s.least_words else next(c for c in range(m + 1) if c >= min(s.least, s.sure) * m)


SEED = -2.0  # in place of a cosine


class Seeds:
    """Candidates that no leak can avoid.

    A leak has at least c = ``least`` (or ``sure``; all of a short item's) of an item's m words in order within
    a window, so of any k of the item's words at least k - (m - c) are there.  The k
    rarest are taken, as many as occur in ``hits`` of all words, and m - c + 1 at least.
    Which words count as rare changes only the time.
    """

    def __init__(self, items: list[tuple[object, list[int]]], df: np.ndarray, n: int, s: Settings):
        self.need, self.width, pairs, times = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), [], []
        share = df / max(n, 1) / s.passage
        for i, (_, x) in enumerate(items):
            m = len(x)
            least = least_common(m, s)
            by = np.array(x, np.uint32)
            by = by[np.lexsort((by, share[by % s.buckets]))]
            new = np.append(True, by[1:] != by[:-1])
            k = max(m - least + 1, int(np.searchsorted(np.cumsum(share[by % s.buckets] * new), s.hits, side="right")))
            self.need[i], self.width[i] = k - (m - least), window(m, s)
            for column, x in zip((pairs, times), np.unique(by[:k], return_counts=True), strict=True):
                column.append(x)
        words, item = np.concatenate(pairs), np.repeat(np.arange(len(items)), [len(x) for x in pairs])
        order = np.argsort(words, kind="stable")
        self.words, first, self.count = np.unique(words[order], return_index=True, return_counts=True)
        self.first, self.item, self.times = first, item[order].astype(np.min_scalar_type(len(items))), np.concatenate(times)[order]
        self.bits = (1 << 20) - 1
        self.known = np.zeros(self.bits + 1, bool)
        self.known[self.words & self.bits] = True

    def places(self, w: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 17, pairs: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, items, first words, ends) of all candidates, a bounded number of words and (word, item) pairs at a time."""
        at = np.flatnonzero(self.known[w & self.bits])
        code = np.minimum(np.searchsorted(self.words, w[at]), len(self.words) - 1)
        same = self.words[code] == w[at]
        at, code, widest = at[same], code[same], int(self.width.max())
        to = np.concatenate([[0], np.cumsum(self.count[code])])
        i = 0
        while i < len(at):
            # all that starts with words i to j, which may end up to a window later
            j = min(int(np.searchsorted(to, to[i] + pairs, side="right")) - 1, int(np.searchsorted(at, at[i] + chunk)))
            j = max(j, i + 1)
            end = int(np.searchsorted(at, at[j - 1] + widest))
            c, n = code[i:end], self.count[code[i:end]]
            row = np.repeat(self.first[c] - (to[i:end] - to[i]), n) + np.arange(to[end] - to[i])
            order = np.argsort(self.item[row], kind="stable")
            row, place = row[order], np.repeat(at[i:end], n)[order]
            item = self.item[row].astype(np.int64)
            last = np.arange(len(item)) + self.need[item] - 1
            begin = np.flatnonzero(last < len(item))
            last = last[begin]
            begin, last = (x[(item[last] == item[begin]) & (place[last] - place[begin] < self.width[item[begin]])] for x in (begin, last))
            doc = np.searchsorted(offsets, place[begin], side="right") - 1
            inside = place[last] < offsets[doc + 1]
            begin, last, doc = begin[inside], last[inside], doc[inside]
            # a word counts as often as the item has it
            key = (item << 40) + place
            size = np.searchsorted(key, (item[begin] << 40) + np.minimum(place[begin] + self.width[item[begin]], offsets[doc + 1])) - begin
            ends = np.concatenate([[0], np.cumsum(size)])
            x = 0
            while x < len(begin):
                y = max(x + 1, int(np.searchsorted(ends, ends[x] + pairs, side="right")) - 1)
                some = np.repeat(np.arange(y - x), size[x:y])
                words = row[np.repeat(begin[x:y] - (ends[x:y] - ends[x]), size[x:y]) + np.arange(ends[y] - ends[x])]
                met, count = np.unique(some * len(self.item) + words, return_counts=True)
                enough = np.bincount(met // len(self.item), np.minimum(count, self.times[met % len(self.item)]), y - x) >= self.need[item[begin[x:y]]]
                b = begin[x:y][enough]
                yield doc[x:y][enough], item[b], place[b], place[last[x:y][enough]] + 1
                x = y
            i = j


def leaks(n: int, answer: int, m: int, s: Settings) -> bool:
    return n >= s.sure * m or (n >= s.least * m and answer >= s.answer * min(s.answer_words, m))


def best_match(item: list[int], words: np.ndarray, lo: int, hi: int, s: Settings) -> tuple[int, int]:
    """(common words, common words of the answer) of the best window within words[lo:hi] of those that leak the item; zeros without one.

    Windows an eighth of the item apart come first; all windows if none of those leaks.
    """
    m = len(item)
    width = window(m, s)
    if m < s.least_words:
        whole = np.array(item, np.uint32)
        begins = lo + np.flatnonzero(words[lo : hi - m + 1] == whole[0]) if hi - lo >= m else ()
        return (m, m) if any((words[b : b + m] == whole).all() for b in begins) else (0, 0)
    known, window_words = set(item), words[lo:hi].tolist()
    to = np.concatenate([[0], np.cumsum([w in known for w in window_words])])
    best = (0, 0)
    for stride in dict.fromkeys((max(1, m // 8), 1)):
        begins = np.arange(0, max(1, hi - lo - width + stride), stride)
        bound = to[np.minimum(begins + width, hi - lo)] - to[begins]
        for b in begins[bound >= min(s.least, s.sure) * m].tolist():
            text = window_words[b : b + width]
            n = lcs(item, text)
            if n >= max(best[0], min(s.least, s.sure) * m):
                answer = lcs(item[-s.answer_words :], text)
                if leaks(n, answer, m, s):
                    best = max(best, (n, answer))
        if best[0]:
            break
    return best


def _search(items: list[tuple[object, list[int]]], basis: np.ndarray, idf: np.ndarray, seeds: Seeds | None, s: Settings, item_type: pa.DataType):
    table = filled((basis * idf[:, None]).astype(np.float32))
    target = np.zeros((table.shape[1], len(items)), np.float32)
    for i, (_, x) in enumerate(items):
        target[:, i] = table[np.array(x) % s.buckets].sum(axis=0)
    target /= np.maximum(np.linalg.norm(target, axis=0), 1e-12)
    told = np.array([len(x) >= s.least_words for _, x in items], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, w, offsets in _batches(batches, 1 << 17):
            starts = segments(offsets, s.step)
            if not len(starts):
                continue
            doc = np.searchsorted(offsets, starts, side="right") - 1
            sums = row_sums(cells(w, starts, s.step, s.buckets), table)
            # no pair without such a place can pass the rule, whatever its cosine: it isn't looked at further
            found: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for places in seeds.places(w, offsets) if seeds else ():
                for d, j, a, b in zip(*(x.tolist() for x in places), strict=True):
                    found.setdefault((d, j), []).append((SEED, a, b))
            open_ = np.sort(np.array([d * len(items) + j for d, j in found], np.int64))
            for k in s.widths if len(open_) else ():
                x = sums.copy()
                for d in range(1, k):
                    x[:-d] += np.where((doc[d:] == doc[:-d])[:, None], sums[d:], 0)
                for a in range(0, len(x), 4096):
                    cosine = unit(x[a : a + 4096]) @ target
                    i, j = np.nonzero((cosine >= s.cosine) & told)
                    pair = doc[a + i] * len(items) + j
                    passes = open_[np.minimum(np.searchsorted(open_, pair), len(open_) - 1)] == pair
                    for i, j in zip(i[passes].tolist(), j[passes].tolist(), strict=True):
                        r = a + i
                        found[int(doc[r]), j].append((float(cosine[i, j]), int(starts[r]), int(starts[r]) + k * s.step))
            out: list[list] = [[], [], [], [], [], []]
            for (d, j), places in found.items():
                name, words = items[j]
                m, best, width = len(words), (0, 0), window(len(words), s)
                regions: list[list[int]] = []
                for _, a, b in sorted(places, key=lambda p: p[1]):
                    a, b = max(int(offsets[d]), a - width), min(int(offsets[d + 1]), b + width)
                    if regions and a <= regions[-1][1]:
                        regions[-1][1] = max(b, regions[-1][1])
                    else:
                        regions.append([a, b])
                for a, b in regions:
                    best = max(best, best_match(words, w, a, b, s))
                if best[0] and leaks(*best, m, s):
                    near = max(p[0] for p in places)
                    if near == SEED:  # no window is near enough: the nearest around the candidates
                        lo, hi = np.searchsorted(starts, (min(p[1] for p in places) - s.step, max(p[2] for p in places)))
                        lo = max(int(lo), int(np.searchsorted(doc, d)))
                        to = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums[lo : np.searchsorted(doc, d, side="right")], axis=0, dtype=np.float64)])
                        begin = np.arange(max(int(hi) - lo, 1))
                        near = max(float((unit(to[np.minimum(begin + k, len(to) - 1)] - to[begin]) @ target[:, j]).max()) for k in s.widths)
                    for c, v in zip(out, (d, name, near, best[0], m, best[1]), strict=True):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(out[0])), pa.array(out[1], item_type), pa.array(out[2], pa.float64()), *(pa.array(c, pa.int32()) for c in out[3:])], names=["doc", "item", "cosine", "common", "item_words", "answer_common"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, item, cosine, common, item_words, answer_common) of each leak."""
    s = settings
    shape = T.StructType([T.StructField("doc", docs.schema[key].dataType), T.StructField("words", T.BinaryType())])
    words = Table(docs.select(key, text).mapInArrow(_words, shape), "words").frame()
    df, n = frequencies(words, s)
    idf = weights(df, n, s)
    basis = singular_basis(words, idf, s)
    kind = benchmark.schema[item].dataType
    schema = T.StructType([shape[0], T.StructField("item", kind), T.StructField("cosine", T.DoubleType()), *(T.StructField(c, T.IntegerType()) for c in ("common", "item_words", "answer_common"))])
    from pyspark.sql.pandas.types import to_arrow_type

    found, block = None, []

    def search() -> DataFrame:
        return words.mapInArrow(_search(list(block), basis, idf, Seeds(block, df, n, s) if block else None, s, to_arrow_type(kind)), schema)

    for r in benchmark.select(item, item_text).distinct().toLocalIterator():
        raw = (r[1] or "").encode()
        hashed = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        if hashed:
            block.append((r[0], hashed))
        if len(block) == s.block:
            found, block = search() if found is None else found.union(search()), []
    if block or found is None:
        found = search() if found is None else found.union(search())
    best = found.groupBy("doc", "item").agg(F.max(F.struct("common", "answer_common", "cosine", "item_words")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), "b.cosine", "b.common", "b.item_words", "b.answer_common")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item."""
    (name,) = fresh(docs.columns, "drop")
    drop = contamination(docs, benchmark).select(F.col("doc_id").alias(name)).filter(F.col(name).isNotNull()).distinct()
    return docs.join(drop, docs["doc_id"] == drop[name], "left_anti")
