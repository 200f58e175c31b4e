"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of a fixed number of bytes in both directions, labels
every position with a distribution over languages, and a document's probabilities
are the mean over its letters' positions.  All bytes of a text are in exactly one
window; states start anew in each, so a text of any length takes bounded memory.

The network is trained in numpy by backpropagation through time, on a bounded
sample: ``Training.documents`` labelled documents (those with the smallest hash of
their key) with ``Training.windows`` windows each.  Prediction covers every row.

Defined results: ``und`` with score 0 if a text is null or has no letter.  Equal
texts get equal predictions to the last bit, wherever they stand and however long
they are: windows are computed in batches of one fixed shape, and a text's windows
are summed in their order.  Of languages with equal probabilities the first by name
is predicted.  Rows with a null language never train.  An empty table gives no
rows; if no labelled row is left to learn from, every prediction is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.store import fresh
from orrery.llm.textops import blocks, text_bytes

UNKNOWN = "und"
FILL = 256
LETTER = np.zeros(257, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


#: Windows of a batch.  One shape for all, as a matrix product may round differently for another.
BATCH = 2048


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit."""

    documents: int = 3000
    windows: int = 4
    width: int = 96
    hidden: int = 8
    steps: int = 160
    batch: int = 192
    rate: float = 0.03
    seed: int = 7


def _gate(a: np.ndarray) -> np.ndarray:
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


class Network:
    """Parameters by direction (axis 0: forward, backward).

    ``z`` and ``r`` are the update and reset gates, halved before the tanh so that
    (tanh + 1) / 2 is the logistic function; ``n`` is the candidate state.
    """

    def __init__(self, labels: list[str], width: int, hidden: int, seed: int = 0):
        rng, self.labels, self.width, self.hidden = np.random.default_rng(seed), labels, width, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {f"e{g}": draw(2, 257, hidden, scale=0.3) for g in "zrn"}
        self.p |= {f"u{g}": draw(2, hidden, hidden, scale=hidden**-0.5) for g in "zrn"}
        self.p |= {"bn": np.zeros((2, 1, hidden), np.float32), "o": draw(2, hidden, len(labels), scale=0.5), "bo": np.zeros(len(labels), np.float32)}

    def _steps(self, x: np.ndarray) -> np.ndarray:
        """Indices into both directions' tables laid end to end, by step: (width, 2 * windows)."""
        x = x.astype(np.int64)
        return np.concatenate([x.T, x.T[::-1] + 257], axis=1)

    def logits(self, x: np.ndarray, trace: list | None = None) -> np.ndarray:
        """(width, windows, labels) scores of windows of symbols (windows, width)."""
        p, n, steps = self.p, len(x), self._steps(x)
        tables = {g: p[f"e{g}"].reshape(514, self.hidden) for g in "zrn"}
        h = np.zeros((2, n, self.hidden), np.float32)
        out = np.zeros((self.width, n, len(self.labels)), np.float32) + p["bo"]
        for t in range(self.width):
            at = {g: tables[g].take(steps[t], axis=0).reshape(2, n, self.hidden) for g in "zrn"}
            z = _gate(at["z"].__iadd__(h @ p["uz"]))
            r = _gate(at["r"].__iadd__(h @ p["ur"]))
            u = h @ p["un"]
            u += p["bn"]
            c = at["n"]
            c += r * u
            np.tanh(c, out=c)
            before, h = h, c + z * (h - c)
            if trace is not None:
                trace.append((z, r, u, c, before, h))
            y = h @ p["o"]
            out[t] += y[0]
            out[self.width - 1 - t] += y[1]
        return out

    def gradients(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (weighted mean cross-entropy over letters' positions) and its gradients, through time."""
        p, n, width = self.p, len(x), self.width
        trace: list = []
        scores = self.logits(x, trace)
        scores -= scores.max(axis=2, keepdims=True)
        prob = np.exp(scores)
        prob /= prob.sum(axis=2, keepdims=True)
        w = (LETTER[x] * weight[:, None]).T.astype(np.float32)
        w /= max(float(w.sum()), 1e-9)
        of_label = prob[:, np.arange(n), labels]
        loss = float(-(w * np.log(np.maximum(of_label, 1e-9))).sum())
        d = prob
        d[:, np.arange(n), labels] -= 1
        d *= w[:, :, None]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["bo"] = d.sum(axis=(0, 1))
        deltas = {k: np.zeros((width, 2 * n, self.hidden), np.float32) for k in "zrn"}
        dh = np.zeros((2, n, self.hidden), np.float32)
        turn = lambda a: a.transpose(0, 2, 1)
        for t in range(width - 1, -1, -1):
            z, r, u, c, before, h = trace[t]
            dy = np.stack([d[t], d[width - 1 - t]])
            g["o"] += turn(h) @ dy
            dh = dh + dy @ turn(p["o"])
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z) * 2  # the tanh's argument is half the logistic's
            dr = dc * u * r * (1 - r) * 2
            du = dc * r
            dh = dh * z + du @ turn(p["un"]) + dr @ turn(p["ur"]) + dz @ turn(p["uz"])
            back = turn(before)
            g["un"] += back @ du
            g["ur"] += back @ dr
            g["uz"] += back @ dz
            g["bn"] += du.sum(axis=1, keepdims=True)
            for k, v in (("z", dz), ("r", dr), ("n", dc)):
                deltas[k][t] = v.reshape(2 * n, self.hidden)
        steps = self._steps(x).ravel()
        order = np.argsort(steps, kind="stable")
        used, first = np.unique(steps[order], return_index=True)
        for k, v in deltas.items():
            g[f"e{k}"].reshape(514, self.hidden)[used] = np.add.reduceat(v.reshape(-1, self.hidden)[order], first)
        return loss, g

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over letters' positions of each window's probabilities (windows, labels), and letters."""
        scores = np.ascontiguousarray(self.logits(x).transpose(2, 0, 1))
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        letters = LETTER[x].T
        scores *= letters / scores.sum(axis=0)
        return scores.sum(axis=1).T.astype(np.float64), letters.sum(axis=0)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, labels): means over the letters' positions of each text; zeros without letters."""
        x, owner = windows_of(data, offsets, self.width)
        sums, letters = np.zeros((len(x), len(self.labels))), np.zeros(len(x))
        for a in range(0, len(x), BATCH):
            some = x[a : a + BATCH]
            full = np.concatenate([some, np.full((BATCH - len(some), self.width), FILL, x.dtype)])
            s, n = self.pooled(full)
            sums[a : a + BATCH], letters[a : a + BATCH] = s[: len(some)], n[: len(some)]
        n_texts = len(offsets) - 1
        total = np.stack([np.bincount(owner, sums[:, k], n_texts) for k in range(len(self.labels))], axis=1)
        return total / np.maximum(np.bincount(owner, letters, n_texts), 1)[:, None]


def windows_of(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (windows, width), filled at the end of each text, and each window's text."""
    sizes = np.diff(offsets)
    per = -(-sizes // width)
    to = np.concatenate([[0], np.cumsum(per)]) * width
    out = np.full(to[-1], FILL, np.int16)
    out[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], sizes)] = data
    return out.reshape(-1, width), np.repeat(np.arange(len(sizes)), per)


def fit(samples: list[tuple[bytes, str]], t: Training = Training()) -> Network | None:
    """A network trained on (bytes, label) samples by Adam; labels weigh the same."""
    labels = sorted({y for _, y in samples})
    if not labels:
        return None
    raw = [b[: t.width] for b, _ in samples]
    offsets = np.concatenate([[0], np.cumsum([max(len(b), 1) for b in raw])])
    x, _ = windows_of(np.frombuffer(b"".join(b or b"\0" for b in raw), np.uint8), offsets, t.width)
    y = np.searchsorted(labels, [v for _, v in samples])
    share = np.bincount(y, minlength=len(labels))
    net, rng = Network(labels, t.width, t.hidden, t.seed), np.random.default_rng(t.seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    odds = (1.0 / share[y]) / len(labels)
    for step in range(1, t.steps + 1):
        take = rng.choice(len(x), min(t.batch, len(x)), p=odds / odds.sum())
        _, g = net.gradients(x[take], y[take], np.ones(len(take)))
        norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
        rate = t.rate * min(1.0, step / 10) * (1 - step / (t.steps + 1))
        for k, a in g.items():
            a = a * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.01 * (a * a - v[k])
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def sample(docs: DataFrame, key: str, text: str, label: str, usable, t: Training) -> list[tuple[bytes, str]]:
    """At most ``t.documents * t.windows`` (window, label) pairs of usable labelled rows."""
    usable = usable & F.col(label).isNotNull()
    n = docs.filter(usable).count()
    if not n:
        return []
    # rows whose hash is small enough for four times the documents wanted: what reaches the driver doesn't grow with the input
    order, size, raw = F.xxhash64(F.col(key).cast("string"), F.lit(t.seed)), F.octet_length(text), F.col(text).cast("binary")
    few = F.pmod(order, F.lit(1 << 31)) < min(1.0, 4 * t.documents / n) * (1 << 31)
    cut = lambda i: F.substring(raw, 1 + F.pmod(F.xxhash64(order, F.lit(i)), F.greatest(size - F.lit(t.width - 1), F.lit(1))).cast("int"), F.lit(t.width))
    rows = docs.filter(usable & few & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), order.alias("order"), F.array(*(cut(i) for i in range(t.windows))).alias("windows"))
    got = rows.orderBy("order", "label", "windows").limit(t.documents).select("label", "windows").collect()
    return [(bytes(w), r["label"]) for r in got for w in r.windows]


def predict(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row: the key, the columns to keep, and the predicted label and its score, named ``out``."""
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            lettered = b.column(1).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets, 2 << 20):
                cut = offsets[i : j + 1]
                has = lettered[i:j].astype(bool)
                best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                if net is not None and has.any():
                    mean = net.probabilities(data[cut[0] : cut[-1]], cut - cut[0])
                    best, score = mean.argmax(axis=1), np.clip(mean.max(axis=1), 0, 1)
                known = has & (net is not None)
                labels = np.array([UNKNOWN] + (net.labels if net else []), dtype=object)
                label = pa.array(labels[np.where(known, best + 1, 0)], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(2 + k).slice(i, j - i) for k in range(len(names))), label, pa.array(np.where(known, score, 0.0))], names=[*names, *out])

    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    body, lettered = fresh(docs.columns, "text", "lettered")
    shown = [F.col(text).alias(body), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(lettered)]
    return docs.select(*shown, *names).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the key as text leaves 1 when divided by 3 (null key: no)."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", t: Training = Training()) -> Network | None:
    return fit(sample(docs, key, text, label, ~held_out(key), t), t)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_stage(docs: DataFrame, clear: float = 0.4, size: int = 400, text: str = "text") -> DataFrame:
    """Documents with a known language; those without letters or without a clear language go.

    The score of L labels is never under 1/L.  It has to be ``clear`` of the way from
    there to 1 for texts of ``size`` bytes and more, in proportion less for shorter ones.
    """
    names = docs.columns
    label, score = fresh(names, "label", "score")
    net = train(docs)
    chance = 1 / len(net.labels) if net else 1.0
    least = F.lit(chance - 1e-6) + F.lit((1 - chance) * clear) * F.least(F.lit(1.0), F.octet_length(text) / F.lit(size))
    kept = predict(docs, net, keep=tuple(c for c in names if c != "doc_id"), out=(label, score))
    return kept.filter((F.col(label) != UNKNOWN) & (F.col(score) >= least)).select(*names)
