"""Moving tables to another number of shards while changes go on: schema, copy, replay, cutover."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import RoutingError
from ..plans.store import Store
from . import cdc
from .reshard import CutoverPolicy


def with_retry(run: Callable[[], object], attempts: int = 5, base_s: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """run(), again after base * 2^min(k, 5) seconds where it fails; refusals are not tried again."""
    for k in range(attempts):
        try:
            return run()
        except RoutingError:
            raise
        except Exception:
            if k == attempts - 1:
                raise
            sleep(base_s * 2 ** min(k, 5))


def check_unique(df: DataFrame, key: list[str]) -> None:
    """A replicated table that is followed by whole rows needs a key that tells its rows apart."""
    if not key or df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise RoutingError(f"{', '.join(key) or 'no column'}: not unique")


@dataclass
class Followed:
    """A table to move: its key, and its other columns."""

    name: str
    key: str
    columns: list[str]


@dataclass
class Reshard:
    """Copies tables from one store to another and follows their changes until the other can take over.

    events(after) gives the change events beyond a position (see cdc), position() the
    newest one.  Steps may be run one by one; each can run again.  The applied position
    of a table is published with its content, so that a replay that is run again skips
    what is there.
    """

    spark: SparkSession
    source: Store
    target: Store
    tables: list[Followed]
    events: Callable[[int], DataFrame]
    position: Callable[[], int]
    policy: CutoverPolicy = field(default_factory=lambda: CutoverPolicy(3600, 0, 60))
    attempts: int = 5
    steps: list[tuple[str, str, str]] = field(default_factory=list)

    def _done(self, phase: str, name: str, status: str = "done") -> None:
        self.steps.append((phase, name, status))

    def schema_pre(self) -> None:
        """Tables must exist at the source, be identifiable, and not hold rows at the target."""
        for t in self.tables:
            cdc.check_identity("key", [t.key], t.columns)
            if self.source.catalog.sharded(t.name) is None:
                check_unique(self.source.read(t.name), [t.key])
            if self.target.exists(t.name) and self.target.read(t.name).limit(1).count():
                raise RoutingError(f"{t.name}: the target is not empty")
            self._done("pre", t.name)

    def copy(self) -> dict[str, int]:
        """Every row, hashed anew; all tables are published together.  Returns the position that the copy stands for, by table."""
        at = self.position()

        def once() -> None:
            with self.target as target:
                for t in self.tables:
                    rows = self.source.read(t.name).select(t.key, *t.columns)
                    if target.exists(t.name):
                        target.insert(t.name, rows)
                    else:
                        target.create(t.name, rows)
                target.create("_applied" if not target.exists("_applied") else f"_applied_{at}", self.spark.createDataFrame([(t.name, at) for t in self.tables], "table string, lsn long"))

        with_retry(once, self.attempts)
        for t in self.tables:
            self._done("copy", t.name)
        return {t.name: at for t in self.tables}

    def schema_post(self) -> None:
        """What was copied has as many rows as the target says that it has."""
        for t in self.tables:
            twice = self.target.read(t.name).groupBy(t.key).count().where("count > 1 and " + f"`{t.key}` is not null").limit(1).count()
            if twice:
                raise RoutingError(f"{t.name}: rows of equal key after the copy")
            self._done("post", t.name)

    def applied(self) -> dict[str, int]:
        return {r.table: r.lsn for r in self.target.read("_applied").collect()}

    def replay(self) -> int:
        """Apply the events beyond each table's position, and publish content and positions together; returns the newest position."""
        applied = self.applied()
        newest = self.position()
        events = self.events(min(applied.values())).where(F.col("lsn") <= newest)
        events = cdc.gate(events, self.target.read("_applied"))
        with self.target as target:
            for t in self.tables:
                mine = events.where(F.col("table") == t.name)
                if mine.limit(1).count():
                    self._fold(target, t, mine)
            target.delete("_applied", "true")
            target.insert("_applied", self.spark.createDataFrame([(t.name, newest) for t in self.tables], "table string, lsn long"))
        self._done("replay", "*", f"at {newest}")
        return newest

    def _fold(self, target: Store, t: Followed, events: DataFrame) -> None:
        """The shards of the changed keys are rewritten; others keep their files."""
        rule = target.catalog.sharded(t.name)
        flat = cdc.expand_key_changes(events)
        shards = None
        if rule is not None and rule.column == t.key:
            shards = frozenset(r.s for r in flat.select(rule.shard_column(F.col("key")).alias("s")).distinct().collect())  # one per shard
            shards = None if None in shards else shards

        def change(df: DataFrame) -> DataFrame:
            after = cdc.fold(df.drop("shard"), events, t.key, t.columns)
            return target._place(t.name, after.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in [t.key, *t.columns])))

        m, _ = target._rewrite(t.name, shards, change)
        target._publish(t.name, m)

    def cutover(self, elapsed_s: float = 0.0, idle_s: float = 0.0, pause: Callable[[], None] = lambda: None, resume: Callable[[bool], None] = lambda switched: None) -> str | None:
        """If the policy says so: pause writers, replay what is left, point the views at the target, resume.  None: not yet."""
        why = self.policy.ready(elapsed_s, self.position() - min(self.applied().values()), idle_s)
        if why is None:
            return None
        pause()
        try:
            self.replay()
            for t in self.tables:
                self.target.read(t.name).createOrReplaceTempView(t.name)
                self._done("cutover", t.name, why)
        except Exception:
            resume(False)
            raise
        resume(True)
        return why

    def run(self) -> str:
        """All steps; changes are replayed until the policy lets the target take over."""
        began = time.monotonic()
        self.schema_pre()
        self.copy()
        self.schema_post()
        self.replay()
        while (why := self.cutover(time.monotonic() - began)) is None:
            self.replay()
        return why
