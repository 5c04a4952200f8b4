"""Catalog of sharded, replicated (omni) and schema-placed tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import partition as P


class RoutingError(ValueError):
    """A statement that must not run, for safety."""


@dataclass(frozen=True)
class ShardedTable:
    """Table partitioned by one column.  name None: every table that has the column.

    Of centroids, mapping (lists, ranges, default) and hash the first that is set decides.
    """

    name: str | None
    column: str
    shards: int
    kind: str = "bigint"
    function: str = "hash"
    lists: tuple = ()
    ranges: tuple = ()
    default: int | None = None
    centroids: tuple = ()
    probes: int | None = None

    @property
    def mapped(self) -> bool:
        return bool(self.lists or self.ranges or self.default is not None)

    def shard_column(self, key: Column | None = None) -> Column:
        """Shard of each row; null where a mapping does not know the value or the key is null: such rows belong to all shards."""
        key = F.col(self.column) if key is None else key
        if self.mapped:
            return P.mapping_shard(key, self.lists, self.ranges, self.default)
        if self.function == "sha1":
            return P.sha1_shard(key, self.shards, self.kind == "uuid")
        return {"bigint": P.hash_bigint, "uuid": P.hash_uuid, "varchar": P.hash_varchar}[self.kind](key, self.shards)

    def shards_of(self, value) -> frozenset[int] | None:
        """Shards that rows of a key value can be on; None: any."""
        if value is None:
            return None
        if self.centroids:
            near = sorted(range(len(self.centroids)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(value, self.centroids[i], strict=True)), i))
            return frozenset(i % self.shards for i in near[: self.probes or P.default_probes(len(self.centroids))])
        if self.mapped:
            for values, shard in reversed(self.lists):
                if value in values:
                    return frozenset({shard})
            for start, end, shard in self.ranges:
                if (start is None or value >= start) and (end is None or value < end):
                    return frozenset({shard})
            return None if self.default is None else frozenset({self.default})
        return frozenset({P.shard_of(value, self.kind, self.shards, self.function)})


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    refers_to: str
    key: str
    on_delete: str = "no action"


@dataclass
class Catalog:
    shards: int
    tables: list[ShardedTable] = field(default_factory=list)
    omni: set[str] = field(default_factory=set)
    schemas: dict[str, int | None] = field(default_factory=dict)
    tenant_column: str | None = None
    cross_shard: bool = True
    read_only: bool = False
    comment_prefix: str = "tesselar"
    columns: dict[str, Sequence[str]] = field(default_factory=dict)
    foreign_keys: list[ForeignKey] = field(default_factory=list)

    def sharded(self, name: str) -> ShardedTable | None:
        """The table's own entry, else one for a column that it has."""
        named = next((t for t in self.tables if t.name == name), None)
        return named or next((t for t in self.tables if t.name is None and t.column in self.columns.get(name, ())), None)

    def destructive(self, name: str) -> bool:
        """Would deleting a row of the table change or delete rows that refer to it?"""
        return any(k.refers_to == name and k.on_delete.lower() in ("cascade", "set null", "set default") for k in self.foreign_keys)

    def common(self) -> ShardedTable:
        """The rule for bare keys: only where all tables agree."""
        rules = {(t.kind, t.function, t.lists, t.ranges, t.default, t.centroids): t for t in self.tables}
        if len(rules) != 1:
            raise RoutingError("a bare key needs one partition function; there are several")
        return next(iter(rules.values()))


def with_shard(df: DataFrame, t: ShardedTable, strict: bool = False) -> DataFrame:
    """df with its shard column; rows that belong to all shards get one copy for each (see one_copy), or raise if strict."""
    shard = t.shard_column()
    if strict:
        return df.withColumn("shard", F.coalesce(shard, F.raise_error(F.lit("row without a shard")).cast("int")))
    # the shard is worked out once: a row's own place, or all of them
    every = F.sequence(F.lit(0), F.lit(t.shards - 1))
    placed = df.withColumn("__shard", shard.cast("int"))
    return placed.withColumn("shard", F.explode(F.when(F.col("__shard").isNull(), every).otherwise(F.array("__shard")))).drop("__shard")


def one_copy(df: DataFrame, t: ShardedTable) -> DataFrame:
    """Rows of a stored table, each once: those that lie on all shards are taken from shard 0."""
    own = F.col(t.column).isNotNull() if not t.mapped and not t.centroids else t.shard_column().isNotNull()
    return df.where(own | (F.col("shard") == 0))


def round_robin(df: DataFrame, shards: int) -> DataFrame:
    """df with a shard for each row in turn, for rows whose key is not known."""
    return df.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))


def write_sharded(df: DataFrame, t: ShardedTable, path: str, mode: str = "overwrite") -> None:
    """One folder per shard; a shard's rows are brought together by one shuffle, and large shards split into several files by AQE."""
    with_shard(df, t).hint("rebalance", "shard").write.mode(mode).partitionBy("shard").parquet(path)


def read_sharded(spark: SparkSession, t: ShardedTable, path: str) -> DataFrame:
    """A table that write_sharded wrote, each row once; shard is a storage partition."""
    return one_copy(spark.read.parquet(path), t)
