"""``python -m orrery.cli -d FOLDER -q QUERY [FILE...]``: runs queries and prints them as tab-separated text."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from orrery.runtime import TIMEOUT_S, Engine


def statements(text: str) -> list[str]:
    """Split at semicolons outside quotes."""
    out, now, quote = [], [], ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        if c == ";" and not quote:
            out.append("".join(now))
            now = []
        else:
            now.append(c)
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def show(engine: Engine, texts: list[str], out=None, timeout: float = TIMEOUT_S) -> None:
    for sql in (s for t in texts for s in statements(t)):
        for line in engine.stream(sql, timeout=timeout):
            print(line, file=out or sys.stdout)


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    p = argparse.ArgumentParser(prog="orrery")
    p.add_argument("-d", "--data", required=True, help="folder of Parquet tables")
    p.add_argument("-q", "--query")
    p.add_argument("-t", "--timeout", type=float, default=TIMEOUT_S)
    p.add_argument("files", nargs="*", help="files of queries")
    a = p.parse_args(args)
    texts = ([a.query] if a.query else []) + [Path(f).read_text() for f in a.files]
    if not texts:
        p.error("a query or a file is needed")
    show(Engine(spark or SparkSession.builder.getOrCreate(), a.data), texts, out, a.timeout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
