"""What a database keeps as installed functions: checks of tables and columns, and sequences whose ids hash to a shard of their own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import job_number
from ..functions.partition import hash_bigint
from .catalog import Catalog, RoutingError, ShardedTable
from .planner import Shards

#: Statements that call one of these run on all shards.
ALL_SHARDS = ("install_sharded_sequence", "install_next_id", "install_shard_id")


def forced_shards(sql: str) -> Shards | None | bool:
    """None (all shards) where a statement installs something, False where it does not."""
    bare = sql.lower().replace(" ", "")
    return None if any(f"{name}(" in bare for name in ALL_SHARDS) else False


def check_table(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise RoutingError(f"there is no table {name}")


def check_column(spark: SparkSession, name: str, column: str) -> str:
    """The column's type; raises where there is none."""
    check_table(spark, name)
    found = {c.name.lower(): c.dataType for c in spark.catalog.listColumns(name)}
    if column.lower() not in found:
        raise RoutingError(f"{name} has no column {column}")
    return found[column.lower()]


@dataclass(frozen=True)
class ShardedSequence:
    """Ids for the rows of one table: those of a shard hash to that shard.

    Ids are reserved in blocks of `block`, each by a file of the shared folder that only
    one writer can create, so concurrent jobs never share one.
    """

    spark: SparkSession
    folder: str
    shards: int
    block: int = 100_000

    def _reserved(self) -> DataFrame:
        n = job_number(self.spark, self.folder)
        return self.spark.range((n - 1) * self.block + 1, n * self.block + 1)

    def ids(self, shard: int | None = None) -> DataFrame:
        """The ids of a new block, all or those of a shard; about block / shards each."""
        got = self._reserved()
        return got if shard is None else got.where(hash_bigint(F.col("id"), self.shards) == shard)


def install_sharded_sequence(spark: SparkSession, catalog: Catalog, table: str, column: str, folder: str, block: int = 100_000) -> ShardedSequence:
    """A sequence for a table's BIGINT key; the table must be there, and be sharded by that column or by none yet."""
    kind = check_column(spark, table, column)
    if kind != "bigint":
        raise RoutingError(f"{table}.{column} is {kind}, ids are bigint")
    t = catalog.sharded(table)
    if t is None:
        catalog.tables.append(ShardedTable(table, column, catalog.shards))
    elif t.column != column or t.kind != "bigint" or t.mapped or t.function != "hash":
        raise RoutingError(f"{table} is not sharded by the hash of {column}")
    return ShardedSequence(spark, f"{folder.rstrip('/')}/{table}.{column}", catalog.shards, block)


def shard_id(rows: DataFrame, t: ShardedTable, name: str = "shard_id") -> DataFrame:
    """rows with the number of their shard as a column of its own."""
    return rows.withColumn(name, t.shard_column())
