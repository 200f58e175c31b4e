"""Warm-up passes, timed runs in several threads, statistics per query, queries a second."""

from __future__ import annotations

import csv
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from statistics import mean, median

from pyspark.sql import DataFrame

#: Query sets: all thirteen star-schema queries, and those without the four slow ones.
SETS = {"star": [f"ssb_q{i:02d}" for i in range(1, 14)], "star-fast": [f"ssb_q{i:02d}" for i in range(1, 14) if i not in (7, 11, 12, 13)], "weblog": [f"bdb_{i}{v}" for i in (1, 2, 3) for v in "abc"]}


def force(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def describe(times: list[float]) -> dict[str, float]:
    return {"min": min(times), "max": max(times), "mean": mean(times), "median": median(times), "count": len(times)}


def run(queries: dict[str, Callable[[], DataFrame]], threads: int = 1, warmup: int = 0, runs: int = 1, path: str | None = None, name: str = "queries") -> dict:
    """Per-query statistics and queries a second; one record per run goes to the CSV at ``path``."""

    def worker(_: int) -> tuple[list[tuple[str, float]], float]:
        for _ in range(warmup):
            for q in queries.values():
                force(q())
        out, began = [], time.perf_counter()
        for _ in range(runs):
            for k, q in queries.items():
                t = time.perf_counter()
                force(q())
                out.append((k, time.perf_counter() - t))
        return out, time.perf_counter() - began

    with ThreadPoolExecutor(threads) as pool:
        results = list(pool.map(worker, range(threads)))
    records = [r for out, _ in results for r in out]
    if path:
        with open(path, "w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["queryset", "query", "time"])
            w.writerows((name, k, f"{t:.6f}") for k, t in records)
    qps = sum(runs * len(queries) / wall for _, wall in results)
    return {"queries": {k: describe([t for q, t in records if q == k]) for k in queries}, "qps": qps}
