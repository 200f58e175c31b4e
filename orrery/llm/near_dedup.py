"""Near-duplicate detection: MinHash bands, sequential Bayesian verification, exact check.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and a
   MinHash signature; texts with equal sets are one class, stood for by its
   smallest key.
2. Classes whose signatures agree in a band are candidates.  In a band's bucket
   every class is compared with the bucket's smallest key only, so that a bucket
   of any size gives one pair per class.
3. A candidate's signatures are compared a batch of hashes at a time; it is dropped
   once the posterior probability that its similarity reaches the threshold is
   under ``miss`` (uniform prior; one byte of each hash is compared, whose chance
   agreement the likelihood accounts for).
4. Survivors are checked exactly on their full shingle sets.
5. Connected components of the links are found.  In buckets that then still hold
   several components, pairs across components are compared too, on their full sets.
   One row of such a pair is outside the bucket's largest component: rows outside are
   dealt to all parts of the bucket, all others to their own part only, so that a
   bucket with one large component costs no more than its rows.  A part holds a
   bounded number of rows and shingles; rows outside visit it in blocks of the same
   bound.  Only links leave a task; a pair is compared in its first common band, and
   not once links found in the task have joined its components.  Pairs within a
   component can't change the result.

A pair at the threshold shares no band with a probability of
``(1 - 0.8**4)**32 < 1e-7``.

Defined results: null or empty texts, or texts without words, have an empty set
and are linked with nothing.  Rows of one key share its component; rows with a
null key have a null component and are kept.  Equal rows get equal results.
Further columns are ignored.  An empty table gives no rows.  Keys are integers,
as components are named by the smallest one; a key of another type is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.graph import components
from orrery.llm.store import Table, fresh, gathered, integral, only, release, written
from orrery.llm.textops import LOWER, NOT_SPACE, U64, blocks, hash_spans, mix, runs, text_bytes


@dataclass(frozen=True)
class Settings:
    width: int = 5  # words of a shingle
    percent: int = 80  # least similarity
    bands: int = 32
    rows: int = 4
    step: int = 16  # hashes of a batch of the sequential test
    miss: float = 1e-6
    block: int = 400_000  # shingles of a part of a bucket
    members: int = 1024  # rows of a part of a bucket

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    low = LOWER[data]
    starts, ends = runs(NOT_SPACE[low], offsets)
    words = hash_spans(low, starts, ends)
    first = np.searchsorted(starts, offsets)  # the first word of each text
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(to[-1]) + np.repeat(first[:-1] - to[:-1], n)
    size = np.repeat(np.minimum(n_words, width), n)
    h = size.astype(np.uint64)
    for k in range(width):
        live = size > k
        if live.all():
            h = mix(h + words[at + k])
        else:
            h[live] = mix(h[live] + words[at[live] + k])
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[to[:-1][n > 0]] = True
    counts = np.concatenate([[0], np.cumsum(new)])
    return h[new], counts[to]


def minhash(sets: np.ndarray, offsets: np.ndarray, n_hashes: int) -> np.ndarray:
    """Signatures (texts with a set, n_hashes) of 32 bits; empty sets are left out."""
    rng = np.random.default_rng(20)
    seeds, factors = rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32), rng.integers(0, 1 << 32, n_hashes, dtype=np.uint32) | np.uint32(1)
    first = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((n_hashes, len(first)), np.uint32)
    if len(first):
        base = (sets >> U64(32)).astype(np.uint32)
        room = np.empty_like(base)
        for i in range(n_hashes):
            np.bitwise_xor(base, seeds[i], out=room)
            np.multiply(room, factors[i], out=room)
            np.minimum.reduceat(room, first, out=out[i])
    return np.ascontiguousarray(out.T)


def band_keys(signatures: np.ndarray, s: Settings) -> np.ndarray:
    x = signatures.reshape(len(signatures), s.bands, s.rows).astype(np.uint64)
    key = np.arange(s.bands, dtype=np.uint64)[None, :] + U64(1)
    for k in range(s.rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + x[:, :, k])
    return key.view(np.int64)


def _sketch(s: Settings, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in blocks(offsets):
                cut = offsets[i : j + 1]
                sets, to = shingle_sets(data[cut[0] : cut[-1]], cut - cut[0], s.width)
                n = np.diff(to)
                has = n > 0
                sums = np.zeros((2, j - i), np.uint64)
                if has.any():
                    sums[0, has] = np.add.reduceat(sets, to[:-1][has])
                    sums[1, has] = np.add.reduceat(mix(sets), to[:-1][has])
                sig = minhash(sets, to, s.hashes)
                rows = np.where(has, np.cumsum(has) - 1, 0)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * s.bands)]), pa.int32()), pa.array(band_keys(sig, s).ravel()))
                low = np.ascontiguousarray(sig.astype(np.uint8))
                pool = low if len(low) else np.zeros((1, s.hashes), np.uint8)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(s.hashes), len(pool), [None, pa.py_buffer(pool)]).take(pa.array(np.where(has, rows, 0), mask=~has))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), packed.cast(pa.binary()), keys],
                    names=names,
                )

    return run


def sketches(docs: DataFrame, key: str, text: str, s: Settings) -> DataFrame:
    """Per row: doc, n, two sums that name the set, signature bytes, band keys."""
    long = T.LongType()
    schema = T.StructType([T.StructField(c, k) for c, k in (("doc", long), ("n", long), ("set_a", long), ("set_b", long), ("sig", T.BinaryType()), ("bands", T.ArrayType(long)))])
    return docs.select(integral(docs, key).alias("doc"), F.col(text).alias("text")).mapInArrow(_sketch(s, schema.names), schema)


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(hashes compared, least agreements that keep a pair) after each batch.

    The posterior of the similarity J given m of n agreements, with a uniform prior
    and agreement probability J + (1 - J) / 256, is integrated on a grid.
    """
    j = (np.arange(4000) + 0.5) / 4000
    q, reach = j + (1 - j) / 256, j >= s.percent / 100
    out = []
    for n in range(s.step, s.hashes + 1, s.step):
        least = 0
        for m in range(n + 1):
            log = m * np.log(q) + (n - m) * np.log1p(-q)
            p = np.exp(log - log.max())
            if p[reach].sum() / p.sum() >= s.miss:
                least = m
                break
        out.append((n, least))
    return out


def sequential_test(a: np.ndarray, b: np.ndarray, s: Settings, bounds: list[tuple[int, int]] | None = None) -> np.ndarray:
    """Which pairs of signature bytes (pairs, hashes) survive all batches."""
    live, seen, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in bounds or least_matches(s):
        seen[live] += (a[live, done:n] == b[live, done:n]).sum(axis=1)
        live, done = live[seen[live] >= least], n
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def surviving(pairs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Of (a, b), the pairs that sizes and the sequential test let through."""
    half = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = least_matches(s)
        for b in batches:
            x, y = (text_bytes(b.column(c))[0].reshape(-1, s.hashes) for c in (2, 3))
            keep = pa.array(sequential_test(x, y, s, bounds))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(keep)

    sized = pairs.join(half("a"), "a").join(half("b"), "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * s.percent)
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Of (a, b), the pairs whose full shingle sets are similar enough; docs: (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                keep, sets = [], {}
                for side in (0, 1):
                    ids = rows.column(side).to_pylist()
                    fresh = {d: i for i, d in reversed(list(enumerate(ids))) if d not in sets}
                    data, offsets = text_bytes(rows.column(2 + side).take(pa.array(list(fresh.values()), pa.int64())))
                    names = list(fresh)
                    for i, j in blocks(offsets):
                        cut = offsets[i : j + 1]
                        h, to = shingle_sets(data[cut[0] : cut[-1]], cut - cut[0], s.width)
                        sets |= {names[k]: h[to[k - i] : to[k - i + 1]] for k in range(i, j)}
                for x, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    n, common = len(sets[x]) + len(sets[y]), common_shingles(sets[x], sets[y])
                    keep.append(n > 0 and 100 * common >= s.percent * (n - common))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    half = lambda x: docs.select(F.col("doc").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(half("a"), "a").join(half("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _full_sets(s: Settings):
    """Each text's shingles as ascending hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for i, j in blocks(offsets):
                cut = offsets[i : j + 1]
                h, to = shingle_sets(data[cut[0] : cut[-1]], cut - cut[0], s.width)
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(8 * to), pa.py_buffer(np.ascontiguousarray(h))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), column], names=["doc", "set"])

    return run, "doc long, set binary"


def common_shingles(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


@dataclass
class Cell:
    """Rows of a bucket's part and rows outside its largest component that visit it."""

    slot: int  # of the bucket's band
    home: np.ndarray
    visitor: np.ndarray
    inside: np.ndarray  # of the bucket's largest component
    doc: np.ndarray
    component: np.ndarray
    sig: np.ndarray
    bands: np.ndarray
    sets: list[np.ndarray]


def links_across(cell: Cell, s: Settings, bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links between visitors and rows at home that have different components; two rows outside meet where the smaller is at home."""
    c, out = cell, []
    names, label = np.unique(c.component, return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(x) for x in c.sets])
    visitors, home = np.flatnonzero(c.visitor), np.flatnonzero(c.home)
    rows = max(1, (1 << 22) // (len(home) * s.step + 1))
    head = c.sig[home, : s.step]
    for a in range(0, len(visitors), rows):
        v = visitors[a : a + rows]
        same = (c.sig[v, None, : s.step] == head[None]).sum(axis=2) >= bounds[0][1]
        same &= (label[v, None] != label[None, home]) & (c.inside[None, home] | (c.doc[v, None] > c.doc[None, home]))
        same &= np.minimum(size[v, None], size[None, home]) * 100 >= np.maximum(size[v, None], size[None, home]) * s.percent
        i, j = np.nonzero(same)
        i, j = v[i], home[j]
        keep = sequential_test(c.sig[i], c.sig[j], s, bounds) if len(i) else np.zeros(0, bool)
        i, j = i[keep], j[keep]
        if len(i):
            first = (c.bands[i] == c.bands[j]).argmax(axis=1) == c.slot
            i, j = i[first], j[first]
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(label[x]), root(label[y])
            if p != q:
                shared = common_shingles(c.sets[x], c.sets[y])
                if 100 * shared >= s.percent * (size[x] + size[y] - shared):
                    out.append((int(c.doc[x]), int(c.doc[y])))
                    parent[max(p, q)] = min(p, q)
    return out


CELL = ("band", "p", "q", "home", "visitor", "inside", "slot", "doc", "component", "sig", "bands", "set")


def _across(s: Settings):
    """Links of the cells (band, p, q) of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, held = least_matches(s), []

        def handle(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            band, p, q, home, visitor, inside, slot, doc, component = (rows.column(c).to_numpy() for c in CELL[:9])
            sig = text_bytes(rows.column("sig"))[0].reshape(-1, s.hashes)
            bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, s.bands)
            data, offsets = text_bytes(rows.column("set"))
            edge = np.flatnonzero((band[1:] != band[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(band)], strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes(), np.uint64) for k in range(a, b)]
                    cell = Cell(int(slot[a]), home[a:b], visitor[a:b], inside[a:b], doc[a:b], component[a:b], sig[a:b], bands[a:b], sets)
                    out += links_across(cell, s, bounds)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                held.append(b.slice(at, 2000))
                rows = pa.Table.from_batches(held)
                names = [rows.column(c).to_numpy() for c in range(3)]
                edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in names], axis=0))
                if len(edge):
                    cut = int(edge[-1]) + 1
                    yield handle(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield handle(pa.Table.from_batches(held))

    return run


def cells(rows: DataFrame, s: Settings, held) -> DataFrame:
    """Rows of mixed buckets (band, slot, doc, component, n), dealt to cells (p, q): (doc, slot, band, p, q, home, visitor, inside)."""
    of = rows.groupBy("band", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    of = of.groupBy("band").agg(F.max(F.struct("rows", "total", "component")).alias("top"), F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    count = lambda n, total: F.greatest(F.lit(1), F.ceil(n / s.members), F.ceil(total / s.block)).cast("int")
    plan = of.select("band", F.col("top.component").alias("largest"), count(F.col("rows"), F.col("total")).alias("parts"), count(F.col("rows") - F.col("top.rows"), F.col("total") - F.col("top.total")).alias("visits"))
    known = rows.join(held(plan, "plan"), "band")
    at = known.withColumns({"inside": F.col("component") == F.col("largest"), "p0": F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"), "q0": F.pmod(F.xxhash64("doc", F.lit(1)), F.col("visits")).cast("int")})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = F.transform(upto("visits"), lambda q: F.struct(F.col("p0").alias("p"), q.alias("q"), F.lit(True).alias("home"), (~F.col("inside") & (q == F.col("q0"))).alias("visitor")))
    visit = F.transform(F.filter(upto("parts"), lambda p: ~F.col("inside") & (p != F.col("p0"))), lambda p: F.struct(p.alias("p"), F.col("q0").alias("q"), F.lit(False).alias("home"), F.lit(True).alias("visitor")))
    return at.select("doc", "slot", "band", "inside", F.explode(F.concat(home, visit)).alias("cell")).select("doc", "slot", "band", "inside", "cell.*")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: doc (the key), n_shingles, component_id, kept."""
    s, spark, passing = settings, docs.sparkSession, []

    def held(df: DataFrame, name: str) -> DataFrame:
        """A table that goes once the components are known."""
        passing.append(Table(gathered(df), name))
        return passing[-1].frame()

    rows = written(gathered(sketches(docs, key, text, s)), "sketch")
    # written, so that the joins have an exchange on either side, whose hot partitions can be split
    sets = held(rows.filter("n > 0 and doc is not null").groupBy("set_a", "set_b").agg(F.min("doc").alias("least")), "sets")
    same = written(gathered(rows.filter("n > 0 and doc is not null").select("doc", "set_a", "set_b").join(sets, ["set_a", "set_b"]).select("doc", "least")), "classes")
    least = same.filter("doc = least").select("doc").distinct()
    reps = held(rows.filter("n > 0").join(least, "doc", "left_semi").dropDuplicates(["doc", "set_a", "set_b"]), "representatives")
    buckets = reps.select(F.explode("bands").alias("band"), "doc")
    centres = held(buckets.groupBy("band").agg(F.min("doc").alias("b"), F.count("*").alias("size")).filter("size > 1").drop("size"), "centres")
    stars = buckets.join(centres, "band").filter("doc != b").select(F.col("doc").alias("a"), "b").distinct()
    texts = docs.select(integral(docs, key).alias("doc"), F.col(text).alias("text"))

    def links(pairs: DataFrame) -> DataFrame:
        """Confirmed pairs; only texts that a pair needs are joined."""
        left = held(pairs, "candidates")
        chosen = held(only(texts, "doc", left.select(F.explode(F.array("a", "b")).alias("doc")).distinct()), "texts")
        release(spark)
        return held(confirmed(left, chosen, s), "links")

    found = links(surviving(stars, reps, s))
    release(spark)
    first = held(components(found), "components")
    labelled = held(reps.join(first.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")), "labelled")
    spread = labelled.select(F.posexplode("bands").alias("slot", "band"), "doc", "component", "n")
    mixed = spread.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low != high and size > 2")
    open_ = held(spread.join(held(mixed.select("band"), "mixed"), "band"), "open")
    full_sets = held(only(texts, "doc", open_.select("doc").distinct()).mapInArrow(*_full_sets(s)), "full")
    release(spark)
    full = labelled.select("doc", "component", "sig", "bands").join(full_sets, "doc")
    dealt = cells(open_, s, held).join(full, "doc")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, "band", "p", "q").sortWithinPartitions("band", "p", "q", "doc").select(*CELL)
    more = held(dealt.mapInArrow(_across(s), "a long, b long").distinct(), "links")
    label = lambda side: first.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v"))
    release(spark)
    second = components(joined)
    final = same.join(first.select(F.col("node").alias("least"), "component"), "least", "left").select("doc", F.coalesce("component", "least").alias("component"))
    final = final.join(second.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("doc", F.coalesce("joined", "component").alias("component"))
    # a key with several rows: their least component
    final = written(gathered(final.groupBy("doc").agg(F.min("component").alias("component"))), "components")
    for t in passing:
        t.drop()
    component = F.coalesce("component", "doc")
    return rows.select("doc", "n").join(final, "doc", "left").select("doc", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, settings=Settings(width=4)).withColumnRenamed("doc", "doc_id")


def dedup_stage(docs: DataFrame) -> DataFrame:
    """The documents of which each group of near copies keeps one (five-word shingles)."""
    (name,) = fresh(docs.columns, "drop")
    drop = near_duplicates(docs).filter("not kept").select(F.col("doc").alias(name)).distinct()
    return gathered(docs.join(drop, docs["doc_id"].cast("long") == drop[name], "left_anti"))
