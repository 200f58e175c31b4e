"""A connection, statements with typed parameters, and scrollable results."""

from __future__ import annotations

import datetime
import socket
from decimal import Decimal
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

from orrery.runtime import Engine
from orrery.sources.wire import parse_wire, wire_type

VERSION = (0, 2)


class Connection:
    def __init__(self, engine: Engine):
        self.engine, self.closed, self.client_info = engine, False, {}

    def is_valid(self) -> bool:
        return not self.closed and self.engine.spark.range(1).count() == 1

    def statement(self) -> Statement:
        self._check()
        return Statement(self)

    def prepare(self, sql: str) -> Statement:
        self._check()
        return Statement(self, sql)

    def close(self) -> None:
        self.closed = True

    def _check(self) -> None:
        if self.closed:
            raise RuntimeError("the connection is closed")

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def connect(spark: SparkSession, folder: str, **settings) -> Connection:
    return Connection(Engine(spark, folder, **settings))


class RemoteConnection:
    """A connection to a running query server, by ``orrery://host:port``."""

    def __init__(self, url: str, timeout: float = 3600.0):
        at = urlsplit(url)
        if at.scheme != "orrery" or not at.hostname or not at.port:
            raise ValueError(f"not of the form orrery://host:port: {url!r}")
        self.socket = socket.create_connection((at.hostname, at.port), timeout)
        self.lines = self.socket.makefile("r", encoding="utf-8", newline="\n")

    def _send(self, line: str) -> None:
        self.socket.sendall(line.encode() + b"\n")

    def _line(self) -> str:
        line = self.lines.readline()
        if not line:
            raise ConnectionError("the server closed the connection")
        if line.startswith("!"):
            raise RuntimeError(line[1:].rstrip("\n"))
        return line.rstrip("\n")

    def is_valid(self) -> bool:
        self._send("PING")
        return self._line() == "PONG"

    def execute_query(self, sql: str) -> ResultSet:
        self._send("EXEC " + " ".join(sql.split("\n")))
        lines = [self._line()]
        while (line := self._line()) or len(lines) < 2:
            lines.append(line)
        names, types, rows = parse_wire(lines)
        return ResultSet(names, types, rows)

    def close(self) -> None:
        self.socket.close()

    def __enter__(self) -> RemoteConnection:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _bind(kind):
    def put(self, index: int, value):
        return self._set(index, None if value is None else kind(value))

    return put


class Statement:
    """Parameters count from 1 and stay bound between executions."""

    def __init__(self, connection: Connection, sql: str | None = None):
        self.connection, self.sql, self.bound, self.result, self.timeout = connection, sql, {}, None, 3600.0

    def _set(self, index: int, value) -> Statement:
        if index < 1:
            raise IndexError("parameters count from 1")
        self.bound[index] = value
        return self

    set_boolean, set_byte, set_short, set_int, set_long = _bind(bool), _bind(int), _bind(int), _bind(int), _bind(int)
    set_float, set_double, set_decimal, set_string, set_url = _bind(float), _bind(float), _bind(Decimal), _bind(str), _bind(str)

    def set_null(self, index: int) -> Statement:
        return self._set(index, None)

    def set_date(self, index: int, value: datetime.date) -> Statement:
        return self._set(index, value)

    def set_time(self, index: int, value: datetime.time) -> Statement:
        return self._set(index, value.isoformat())

    def set_timestamp(self, index: int, value: datetime.datetime) -> Statement:
        return self._set(index, value)

    def clear(self) -> None:
        self.bound.clear()

    def execute_query(self, sql: str | None = None) -> ResultSet:
        self.connection._check()
        text = sql or self.sql
        if not text:
            raise ValueError("there is no query")
        if sorted(self.bound) != list(range(1, len(self.bound) + 1)):
            raise ValueError("parameters are missing")
        df, rows = self.connection.engine.execute(text, [self.bound[i] for i in sorted(self.bound)] or None, self.timeout)
        self.result = ResultSet(df.columns, [wire_type(f.dataType) for f in df.schema.fields], rows)
        return self.result

    def execute(self, sql: str | None = None) -> bool:
        self.execute_query(sql)
        return True


class ResultSet:
    """Rows count from 1; before the first is 0, after the last is their number plus 1."""

    def __init__(self, names: list[str], types: list[str], rows: list):
        self.names, self.types, self.rows, self.at = names, types, [tuple(r) for r in rows], 0
        self.was_null = False

    def next(self) -> bool:
        return self.relative(1)

    def previous(self) -> bool:
        return self.relative(-1)

    def absolute(self, row: int) -> bool:
        """Counted from the end if negative."""
        self.at = min(max(0, row if row >= 0 else len(self.rows) + 1 + row), len(self.rows) + 1)
        return 1 <= self.at <= len(self.rows)

    def relative(self, rows: int) -> bool:
        return self.absolute(max(0, self.at + rows))

    def first(self) -> bool:
        return self.absolute(1)

    def last(self) -> bool:
        return self.absolute(len(self.rows)) and bool(self.rows)

    def before_first(self) -> None:
        self.at = 0

    def after_last(self) -> None:
        self.at = len(self.rows) + 1

    def find_column(self, name: str) -> int:
        for i, n in enumerate(self.names, 1):
            if n.lower() == name.lower():
                return i
        raise KeyError(name)

    def get(self, column: int | str):
        if not 1 <= self.at <= len(self.rows):
            raise IndexError("there is no current row")
        i = self.find_column(column) if isinstance(column, str) else column
        if not 1 <= i <= len(self.names):
            raise IndexError(f"no column {i}")
        value = self.rows[self.at - 1][i - 1]
        self.was_null = value is None
        return value

    def _as(self, column, kind):
        value = self.get(column)
        return None if value is None else kind(value)

    def get_string(self, column) -> str | None:
        return self._as(column, str)

    def get_int(self, column) -> int | None:
        return self._as(column, int)

    get_long = get_short = get_byte = get_int

    def get_double(self, column) -> float | None:
        return self._as(column, float)

    get_float = get_double

    def get_decimal(self, column) -> Decimal | None:
        return self._as(column, lambda v: v if isinstance(v, Decimal) else Decimal(str(v)))

    def get_boolean(self, column) -> bool | None:
        return self._as(column, bool)

    def get_date(self, column) -> datetime.date | None:
        return self._as(column, lambda v: v.date() if isinstance(v, datetime.datetime) else v if isinstance(v, datetime.date) else datetime.date.fromisoformat(v))

    def get_time(self, column) -> datetime.time | None:
        return self._as(column, lambda v: v.time() if isinstance(v, datetime.datetime) else datetime.time.fromisoformat(v))

    def get_timestamp(self, column) -> datetime.datetime | None:
        return self._as(column, lambda v: v if isinstance(v, datetime.datetime) else datetime.datetime.fromisoformat(str(v)))

    def get_url(self, column):
        return self._as(column, urlsplit)

    def __iter__(self):
        return iter(self.rows)

    def __len__(self) -> int:
        return len(self.rows)
