"""Best-fit packing of token sequences by linear grouping.

Only the count of each length matters for a plan, and a length is at most the
capacity, so the plan is made on the driver from one histogram of fixed size:

1. Large lengths are grouped into groups of equal cardinality and rounded up to
   the largest of their group.
2. For these few sizes, configurations are chosen one after another: each holds
   the largest size left and fills the capacity as far as sizes can (an exact
   subset sum), and is used as often as the counts allow.
3. Actual lengths take the rounded ones' places, which leaves each sequence its
   true residual.
4. Small lengths are put, largest first, where they fit best.

Step 2 to 4 handle runs of like sequences at once, so the plan stays small at any
number of documents.  Each piece finds its place by its length and its rank among
pieces of that length; ranks are counted per task and summed up per task.

Defined results: a null or empty text is a piece with the end token alone.  Texts
longer than the capacity are cut into pieces of that capacity, the first may be
shorter.  Equal rows are packed each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orrery.llm.store import written
from orrery.llm.textops import rank_in_group
from orrery.llm.tokens import encoder

CAPACITY = 1024
END = 2


@dataclass
class Run:
    """``count`` sequences from ``first`` on, filled alike up to ``used``."""

    first: int
    count: int
    used: int


def linear_groups(counts: dict[int, int], n_groups: int) -> list[list[tuple[int, int]]]:
    """Groups, of about equal cardinality, of (length, count), largest lengths first; a length may be split."""
    total = sum(counts.values())
    n_groups = max(1, min(n_groups, total))
    bounds = [total * (i + 1) // n_groups for i in range(n_groups)]
    out: list[list[tuple[int, int]]] = [[]]
    seen = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, bounds[len(out) - 1] - seen)
            if take:
                out[-1].append((length, take))
            left, seen = left - take, seen + take
            if seen == bounds[len(out) - 1] and len(out) < n_groups:
                out.append([])
    return [g for g in out if g]


def best_configuration(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often each size (descending, the first with a count included) is used to fill the most."""
    start = next(i for i, c in enumerate(counts) if c)
    room = capacity - sizes[start]
    counts = [c - (i == start) for i, c in enumerate(counts)]
    full, reach = (1 << (room + 1)) - 1, [1]
    for s, c in zip(sizes[start:], counts[start:], strict=True):
        now = reach[-1]
        for _ in range(min(c, room // s)):
            grown = (now | now << s) & full
            if grown == now:
                break
            now = grown
        reach.append(now)
    at, use = reach[-1].bit_length() - 1, [0] * len(sizes)
    use[start] = 1
    for i in range(len(sizes) - 1, start - 1, -1):  # the smallest sizes only where larger ones don't reach
        before = reach[i - start]
        while not before >> at & 1:
            at -= sizes[i]
            use[i] += 1
    return use


def sequences(placements: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + count for _, _, count, first, _ in placements), default=0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, n_groups: tuple[int, ...] = (100, 400, 2000, 8000), small: float = 1 / 8) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, count, first sequence, offset) of all pieces.

    Ranks from ``first rank`` on go to consecutive sequences, at ``offset`` each.
    Of the numbers of groups, the one that needs the fewest sequences is taken.
    """
    return min((plan_grouped(histogram, capacity, n, small) for n in n_groups), key=sequences)


def plan_grouped(histogram: dict[int, int], capacity: int, n_groups: int, small: float) -> list[tuple[int, int, int, int, int]]:
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("a length is outside the capacity")
    out: list[tuple[int, int, int, int, int]] = []
    rank: dict[int, int] = defaultdict(int)
    n_sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        out.append((length, rank[length], count, first, offset))
        rank[length] += count

    if histogram.get(capacity):
        put(capacity, histogram[capacity], 0, 0)
        n_sequences = histogram[capacity]
    large = {n: c for n, c in histogram.items() if small * capacity < n < capacity and c}
    open_runs: dict[int, list[Run]] = defaultdict(list)  # by residual
    residuals: list[int] = []  # those with runs, ascending

    def keep(run: Run) -> None:
        left = capacity - run.used
        if run.count and left:
            if not open_runs[left]:
                insort(residuals, left)
            open_runs[left].append(run)

    groups = linear_groups(large, n_groups) if large else []
    by_size: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for g in groups:
        by_size[g[0][0]] += g
    sizes = sorted(by_size, reverse=True)
    members = [sorted(by_size[s], reverse=True) for s in sizes]
    counts = [sum(c for _, c in m) for m in members]
    while any(counts):
        use = best_configuration(sizes, counts, capacity)
        times = min(c // u for c, u in zip(counts, use, strict=True) if u)
        runs = [Run(n_sequences, times, 0)]
        n_sequences += times
        for i, u in enumerate(use):
            for _ in range(u):
                counts[i] -= times
                cut: list[Run] = []
                for r in runs:  # actual lengths in place of the size
                    while r.count:
                        length, left = members[i].pop()
                        take = min(left, r.count)
                        put(length, take, r.first, r.used)
                        cut.append(Run(r.first, take, r.used + length))
                        r = Run(r.first + take, r.count - take, r.used)
                        if left > take:
                            members[i].append((length, left - take))
                runs = cut
        for r in runs:
            keep(r)
    for length in sorted((n for n, c in histogram.items() if c and n <= small * capacity), reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(residuals, length)
            if k == len(residuals):
                each = capacity // length
                keep(Run(n_sequences, -(-left // each), 0))
                n_sequences += -(-left // each)
                continue
            r = open_runs[residuals[k]].pop()
            if not open_runs[residuals[k]]:
                residuals.pop(k)
            take = min(left, r.count)
            put(length, take, r.first, r.used)
            keep(Run(r.first, take, r.used + length))
            keep(Run(r.first + take, r.count - take, r.used))
            left -= take
    return out


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, int, np.ndarray]]:
    """(piece, start, ids) of a document's ids; only the first piece is shorter."""
    head = len(ids) % capacity or min(len(ids), capacity)
    for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
        yield piece, start, ids[start : head if piece == 0 else start + capacity]


def _pieces(path: str | None, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                owner, out = [], ([], [], [], [])
                for i, ids in enumerate(encode.encode(rows.column(1).to_pylist())):
                    for piece, start, x in cut(np.append(ids, np.uint32(end)), capacity):
                        owner.append(i)
                        for c, v in zip(out, (piece, start, len(x), zlib.crc32(x.astype("<u4").tobytes())), strict=True):
                            c.append(v)
                length = np.array(out[2], np.int64)
                rank = seen[length] + rank_in_group(length)
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(owner, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:]), pa.array(np.full(len(owner), part, np.int32)), pa.array(rank)],
                    names=["key", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def _place(placements: list[tuple[int, int, int, int, int]], names: list[str]):
    p = np.array(sorted(placements), np.int64).reshape(-1, 5)
    width = 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = p[:, 0] << width | p[:, 1]
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(keys, b.column("length").to_numpy() << width | rank, side="right") - 1
            new = [pa.array(p[i, 3] + rank - p[i, 1]), pa.array(p[i, 4])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=names)

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, n_groups: tuple[int, ...] = (100, 400, 2000, 8000)) -> DataFrame:
    """Per piece: the key, piece, start, length, ids_crc32, sequence_id, offset."""
    fields = [T.StructField("key", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")), T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]
    pieces = written(docs.select(key, text).mapInArrow(_pieces(tokenizer, capacity, end), T.StructType(fields)), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(starts, ["length", "part"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))
    names = ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = T.StructType(fields[:5] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_place(plan(histogram, capacity, n_groups), names), schema).withColumnRenamed("key", key)


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
