"""Scenarios, straggler settings, timeouts, the query log, and the engine that ties them together."""

from __future__ import annotations

import threading
import time
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from orrery.cluster import Membership
from orrery.plans import policies
from orrery.plans.query_info import inspect
from orrery.plans.rewrite import SlicedQuery, rewrite
from orrery.sources.catalog import TABLES, FactTable, register
from orrery.sources.star import register_star
from orrery.sources.wire import monitoring, to_wire

LOG_SIZE = 10
TIMEOUT_S = 3600


@dataclass(frozen=True)
class Scenario:
    """Whether queries are sliced, and where slices go."""

    name: str
    sliced: bool
    policy: str


SCENARIOS = {
    s.name: s
    for s in (
        Scenario("baseline", False, "single"),
        Scenario("loadbalance", False, "load_balancing"),
        Scenario("rewriteround", True, "round_robin"),
        Scenario("rewriterandom", True, "random"),
        Scenario("rewriteload", True, "load_balancing"),
        Scenario("full", True, "sticky_load_balancing"),
        Scenario("sticky", True, "sticky"),
    )
}


def speculation(quantile: float = 0.75, multiplier: float = 1.0, interval_ms: int = 1000) -> dict[str, str]:
    """Settings for a new session under which slow tasks are run again elsewhere and the first result wins."""
    return {"spark.speculation": "true", "spark.speculation.quantile": str(quantile), "spark.speculation.multiplier": str(multiplier), "spark.speculation.interval": f"{interval_ms}ms"}


def place(spark: SparkSession, scenario: Scenario, slices: int, nodes: list[str], loads: list[float] | None = None) -> DataFrame:
    policy = getattr(policies, scenario.policy)
    args = [spark, slices if scenario.sliced else 1, nodes]
    return policy(*args, loads or [0.0] * len(nodes)) if "load" in scenario.policy else policy(*args)


class QueryTimeout(RuntimeError):
    pass


@contextmanager
def limited(spark: SparkSession, seconds: float = TIMEOUT_S):
    """The Spark jobs of the block are cancelled once the time is up."""
    tag, late = f"timeout-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise QueryTimeout(f"stopped after {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def run_with_timeout(spark: SparkSession, action, seconds: float = TIMEOUT_S):
    """``action()``, whose Spark jobs are cancelled once the time is up."""
    with limited(spark, seconds):
        return action()


@dataclass
class LogEntry:
    id: str
    sql: str
    started: float
    seconds: float
    rows: int


@dataclass
class QueryLog:
    """The last few queries; safe to use from several threads."""

    size: int = LOG_SIZE
    entries: deque = field(init=False)

    def __post_init__(self):
        self.entries, self._lock = deque(maxlen=self.size), threading.Lock()

    def add(self, entry: LogEntry) -> None:
        with self._lock:
            self.entries.append(entry)

    def all(self) -> list[LogEntry]:
        with self._lock:
            return list(self.entries)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.id, e.sql, e.started, e.seconds, e.rows) for e in self.all()], "id string, sql string, started double, seconds double, rows long")


class Engine:
    """Read-only SQL over a folder of Parquet tables.

    With a fact table and a scenario that slices, aggregate queries run by slices, and
    the scenario's policy says which member has each slice.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: tuple[str, ...] = TABLES, nodes: list[str] | None = None, scenario: str = "sticky", fact: FactTable | None = None, slices: int | None = None):
        self.spark, self.log, self.fact, self.slices = spark, QueryLog(), fact, slices
        self.members, self.scenario = Membership(patience=float("inf") if nodes else 5.0), SCENARIOS[scenario]
        for node in nodes or []:
            self.members.beat(node)
        self._own = bool(nodes)
        if folder:
            register(spark, folder, tables)
            if set(TABLES[:7]) <= set(tables):
                register_star(spark, folder)

    @property
    def nodes(self) -> list[str]:
        """Names of the members: those given, else the session's executors."""
        return list(self.members.alive() if self._own else self.members.refresh(self.spark))

    def sliced(self, text: str) -> SlicedQuery | None:
        """The query by slices, if the scenario and the query allow that."""
        if not (self.scenario.sliced and self.fact):
            return None
        return rewrite(self.spark, text, self.fact, self.slices or self.fact.shards())

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        """A query as a DataFrame; ``?`` and ``:name`` are bound to ``args``; other statements raise NotAQuery."""
        inspect(self.spark, text)
        found = None if args else self.sliced(text)
        return found.result if found else self.spark.sql(text.strip().rstrip(";"), args=args)

    def placement(self, text: str) -> DataFrame:
        """(slice, node) of the query's sub-queries; one sub-query if it isn't sliced."""
        found, loads = self.sliced(text), self.members.alive() if self._own else self.members.refresh(self.spark)
        return place(self.spark, self.scenario, found.slices if found else 1, list(loads), list(loads.values()))

    def execute(self, text: str, args: list | dict | None = None, timeout: float = TIMEOUT_S) -> tuple[DataFrame, list]:
        """Runs the query and logs it: its DataFrame and rows."""
        started = time.time()
        df = self.sql(text, args)
        rows = run_with_timeout(self.spark, df.collect, timeout)
        self._logged(text, started, len(rows))
        return df, rows

    def stream(self, text: str, args: list | dict | None = None, timeout: float = TIMEOUT_S) -> Iterator[str]:
        """Wire text of the query, which runs once and is logged at its end; a partition at a time is held."""
        started, n = time.time(), -2
        with limited(self.spark, timeout):
            for line in to_wire(self.sql(text, args)):
                n += 1
                yield line
        self._logged(text, started, n)

    def _logged(self, text: str, started: float, rows: int) -> None:
        self.log.add(LogEntry(uuid.uuid4().hex, text, started, time.time() - started, rows))

    def monitoring(self) -> str:
        return monitoring(self.nodes, [asdict(e) for e in self.log.all()])
