"""Virtual tables about the engine's own state."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, RoutingError, ShardedTable, write_sharded
from .ddl import setting
from .planner import QueryCache


def human(n: float, unit: str = "B") -> str:
    for prefix in ("", "k", "M", "G", "T"):
        if abs(n) < 1000:
            return f"{n:.1f} {prefix}{unit}" if prefix else f"{n:.0f} {unit}"
        n /= 1000
    return f"{n:.1f} P{unit}"


def _shard_rows(c: Catalog) -> list[tuple]:
    return [(t.name, t.column, t.shards, t.kind) for t in c.tables] + [(n, None, c.shards, "omni") for n in sorted(c.omni)]


def admin_shards(spark: SparkSession, c: Catalog) -> DataFrame:
    return spark.createDataFrame(_shard_rows(c), "name string, column_name string, shards int, kind string")


@dataclass
class TableCopies:
    """Copies of tables as they run: rows, bytes and times of the writes themselves."""

    spark: SparkSession
    rows: list[tuple] = field(default_factory=list)

    def run(self, name: str, df: DataFrame, t: ShardedTable, path: str, schema: str = "public") -> int:
        """Write df by shards under path; returns the rows written.  A copy that fails is listed as failed."""
        began, sql = time.monotonic(), f"COPY {schema}.{name}"
        seen = Observation()
        try:
            write_sharded(df.observe(seen, F.count(F.lit(1)).alias("n")), t, path)
        except Exception:
            self._put(schema, name, "failed", 0, 0, time.monotonic() - began, sql)
            raise
        took, n = time.monotonic() - began, seen.get["n"]
        size = self._size(path)
        self._put(schema, name, "done", n, size, took, sql)
        return n

    def _size(self, path: str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def _put(self, schema: str, name: str, status: str, n: int, size: int, took: float, sql: str) -> None:
        took = max(took, 1e-3)
        self.rows.append((schema, name, status, n, human(n, "rows"), size, human(size), int(size / took), f"{human(size / took)}/s", f"{took:.3f} s", int(took * 1000), sql))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "schema string, table string, status string, rows long, rows_human string, bytes long, bytes_human string, bytes_per_sec long, bytes_per_sec_human string, elapsed string, elapsed_ms long, sql string")


@dataclass
class Engine:
    """What the SHOW views show: the catalog, and counters that the caller feeds."""

    spark: SparkSession
    catalog: Catalog
    queries: QueryCache = field(default_factory=QueryCache)
    copies: TableCopies | None = None
    settings: dict[str, str] = field(default_factory=dict)
    prepared: dict[str, str] = field(default_factory=dict)
    listeners: list[tuple[str, str]] = field(default_factory=list)
    mirrors: list[tuple[str, float]] = field(default_factory=list)
    slots: list[tuple[str, int, int]] = field(default_factory=list)
    transactions: list[tuple[str, str]] = field(default_factory=list)
    synced: list[tuple[str, str, str]] = field(default_factory=list)
    tasks: list[tuple[int, str, str]] = field(default_factory=list)
    moves: dict[str, Any] = field(default_factory=dict)  # streaming.orchestrator.Reshard by name
    instance: str = field(default_factory=lambda: uuid.uuid4().hex[:8])

    def _views(self) -> dict[str, tuple[str, Callable[[], list[tuple]]]]:
        q = self.queries.seen
        return {
            "config": ("name string, value string", lambda: sorted(self.settings.items())),
            "instance_id": ("instance_id string", lambda: [(self.instance,)]),
            "lists": ("list string, items long", lambda: [("shards", self.catalog.shards), ("sharded_tables", len(self.catalog.tables)), ("omni_tables", len(self.catalog.omni)), ("schemas", len(self.catalog.schemas)), ("prepared", len(self.prepared)), ("queries", len(q))]),
            "listeners": ("listener string, channel string", lambda: self.listeners),
            "mirrors": ("mirror string, exposure double", lambda: self.mirrors),
            "prepared": ("name string, statement string", lambda: sorted(self.prepared.items())),
            "query_cache": ("query string, hits long, direct long, multi long", lambda: sorted(((k, *n) for k, n in q.items()), key=lambda x: -x[1])),
            "replication": ("slot string, lsn long, applied_lsn long, lag long", lambda: [(n, sent, done, sent - done) for n, sent, done in self.slots]),
            "replication_slots": ("slot string, lsn long", lambda: [(n, sent) for n, sent, _ in self.slots]),
            "schema_sync": ("phase string, object string, status string", lambda: self.synced),
            "shards": ("name string, column_name string, shards int, kind string", lambda: _shard_rows(self.catalog)),
            "stats": ("name string, value double", self.metrics),
            "tasks": ("id int, kind string, status string", lambda: self.tasks),
            "transactions": ("transaction string, phase string", lambda: self.transactions),
            "version": ("version string", lambda: [(f"tesselar on Spark {self.spark.version}",)]),
        }

    def metrics(self) -> list[tuple[str, float]]:
        hits = [n for n in self.queries.seen.values()]
        return [("query_cache_entries", float(len(hits))), ("queries_total", float(sum(n[0] for n in hits))), ("queries_direct_total", float(sum(n[1] for n in hits))), ("queries_multi_total", float(sum(n[2] for n in hits))), ("shards", float(self.catalog.shards)), ("replication_lag", float(max((s - d for _, s, d in self.slots), default=0)))]

    def open_metrics(self) -> str:
        """The counters in OpenMetrics text form."""
        out = []
        for name, value in self.metrics():
            kind, base = ("counter", name.removesuffix("_total")) if name.endswith("_total") else ("gauge", name)
            out += [f"# TYPE tesselar_{base} {kind}", f"tesselar_{name} {value:g}"]
        return "\n".join([*out, "# EOF"]) + "\n"

    def show(self, sql: str) -> DataFrame:
        """SHOW <view> [column, ...]: a view, or the named columns of it."""
        m = re.fullmatch(r"\s*show\s+(\w+)\s*(.*?)\s*;?\s*", sql, re.IGNORECASE | re.DOTALL)
        name = m[1].lower() if m else ""
        if name == "table_copies":
            df = (self.copies or TableCopies(self.spark)).frame()
        elif name in self._views():
            schema, rows = self._views()[name]
            df = self.spark.createDataFrame(rows(), schema)
        else:
            raise RoutingError(f"no such view: {sql}")
        wanted = [c.strip().lower() for c in m[2].split(",")] if m[2] else df.columns
        if unknown := [c for c in wanted if c not in df.columns]:
            raise RoutingError(f"{name} has no column {', '.join(unknown)}")
        return df.select(*wanted)


    _STEPS = {"reshard": "run", "copy_data": "copy", "replicate": "replay", "cutover": "cutover", "schema_sync pre": "schema_pre", "schema_sync post": "schema_post"}

    def run(self, sql: str) -> DataFrame:
        """An admin command: RESHARD, COPY_DATA, REPLICATE, CUTOVER or SCHEMA_SYNC PRE | POST of a move, RESET QUERY_CACHE, RELOAD, SET name = value; returns what it did."""
        words = sql.strip().rstrip(";").split()
        verb = " ".join(words[:-1]).lower()
        if verb in self._STEPS and words[-1] in self.moves:
            number = len(self.tasks) + 1
            self.tasks.append((number, verb, "running"))
            try:
                result = getattr(self.moves[words[-1]], self._STEPS[verb])()
            except Exception:
                self.tasks[number - 1] = (number, verb, "failed")
                raise
            self.tasks[number - 1] = (number, verb, "done")
            self.synced += [s for s in self.moves[words[-1]].steps if s not in self.synced]
            said = "" if result is None else str(result)
        elif sql.strip().rstrip(";").lower() == "reset query_cache":
            self.queries.seen.clear()
            said = "empty"
        elif sql.strip().rstrip(";").lower() == "reload":
            for table in self.spark.catalog.listTables():
                if not table.isTemporary:
                    self.spark.catalog.refreshTable(table.name)
            said = "reloaded"
        elif given := setting(sql):
            self.settings[given[0]] = given[1]
            said = f"{given[0]} = {given[1]}"
        else:
            raise RoutingError(f"no such command: {sql}")
        return self.spark.createDataFrame([(verb or sql.lower(), said)], "command string, result string")


def system_tables(spark: SparkSession) -> DataFrame:
    """Tables and views that the session's catalog knows."""
    rows = [(t.catalog, ".".join(t.namespace or []) or None, t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "catalog string, schema string, name string, kind string, temporary boolean")


def system_columns(spark: SparkSession) -> DataFrame:
    """Their columns."""
    rows = [(t.name, i, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name), 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")
