"""Text forms of results: tab-separated lines with two header lines, console print, DDL, JSON."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTED = ("VARCHAR", "CHAR", "DATE", "TIME", "TIMESTAMP")
ESCAPES = {"\\": "\\\\", '"': '\\"', "\t": "\\t", "\n": "\\n", "\r": "\\r"}


def wire_type(kind: T.DataType) -> str:
    names = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.StringType: "VARCHAR"}
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    for k, n in names.items():
        if isinstance(kind, k):
            return n
    raise ValueError(f"no wire type for {kind.simpleString()}")


def spark_type(name: str) -> str:
    base = name.split("(")[0].strip().upper()
    if base in ("DECIMAL", "NUMERIC"):
        return name.lower().replace("numeric", "decimal")
    return {"INTEGER": "int", "INT": "int", "BIGINT": "bigint", "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIME": "string", "VARCHAR": "string", "CHAR": "string"}[base]


def _field(value: object, quoted: bool) -> str:
    if value is None:
        return "NULL"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return '"' + "".join(ESCAPES.get(c, c) for c in text) + '"' if quoted else text


def to_wire(df: DataFrame) -> Iterator[str]:
    """Names, types, then a line per row; rows are streamed a partition at a time."""
    kinds = [wire_type(f.dataType) for f in df.schema.fields]
    yield "\t".join(df.columns)
    yield "\t".join(kinds)
    quoted = [k.split("(")[0] in QUOTED for k in kinds]
    for row in df.toLocalIterator():
        yield "\t".join(_field(v, q) for v, q in zip(row, quoted, strict=True))


def _unescape(text: str) -> str:
    out, i, back = [], 0, {v[1]: k for k, v in ESCAPES.items()}
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            out.append(back.get(text[i + 1], text[i + 1]))
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def parse_wire(lines: Iterable[str]) -> tuple[list[str], list[str], list[tuple]]:
    """Names, types and typed rows of wire text."""
    it = iter(lines)
    names, kinds = next(it).split("\t"), next(it).split("\t")
    if len(names) != len(kinds):
        raise ValueError("as many types as names are needed")
    read = {"int": int, "bigint": int, "smallint": int, "tinyint": int, "float": float, "double": float, "boolean": lambda v: v == "true", "date": datetime.date.fromisoformat, "timestamp_ntz": datetime.datetime.fromisoformat}
    rows = []
    for line in it:
        values = []
        for raw, kind in zip(line.split("\t"), kinds, strict=True):
            text = _unescape(raw[1:-1]) if raw[:1] == '"' else raw
            k = spark_type(kind)
            values.append(None if raw == "NULL" else Decimal(text) if k.startswith("decimal") else read.get(k, str)(text))
        rows.append(tuple(values))
    return names, kinds, rows


def from_wire(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    names, kinds, rows = parse_wire(lines)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {spark_type(k)}" for n, k in zip(names, kinds, strict=True)))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NULL").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("nullValue", "NULL").schema(schema).csv(path)


def console(df: DataFrame, most: int = 1000) -> str:
    """Header, types and up to ``most`` rows, NULL for nulls; a last line says if there are more."""
    rows = df.take(most + 1)
    lines = ["\t".join(df.columns), "\t".join(wire_type(f.dataType) for f in df.schema.fields), *("\t".join(_field(v, False) for v in r) for r in rows[:most])]
    return "\n".join(lines + [f"... more than {most} rows"] * (len(rows) > most))


def ddl(table: str, df: DataFrame) -> str:
    return f"CREATE TABLE {table} ({', '.join(f'{f.name} {wire_type(f.dataType)}' for f in df.schema.fields)})"


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def monitoring(nodes: list[str], queries: list[dict]) -> str:
    return json.dumps({"nodes": nodes, "numNodes": len(nodes), "queries": queries}, sort_keys=True)
