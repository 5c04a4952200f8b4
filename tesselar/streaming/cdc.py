"""Change-data capture: decoded row changes folded into a table, in batch and in streams.

An event has lsn, seq, op (I, U, D), key, old_key (null unless the key changed), the
table's columns as `new` (null for deletes) and `unchanged`, the names of columns
whose value was not sent.  Order is (lsn, seq).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import RoutingError, ShardedTable


def order_of() -> Column:
    return F.struct("lsn", "seq")


def gate(events: DataFrame, applied: DataFrame) -> DataFrame:
    """Events beyond their table's applied position; rows of one transaction share its lsn and pass together.

    applied has one row per table; Spark chooses how to join it.
    """
    a = applied.select("table", F.col("lsn").alias("applied_lsn"))
    return events.join(a, "table", "left").where(F.col("applied_lsn").isNull() | (F.col("lsn") > F.col("applied_lsn"))).drop("applied_lsn")


def expand_key_changes(events: DataFrame) -> DataFrame:
    """A changed key becomes the delete of the old key, then the insert of the new one; the new row must be whole."""
    changed = (F.col("op") == "U") & F.col("old_key").isNotNull() & (F.col("old_key") != F.col("key"))
    whole = F.when(F.size("unchanged") > 0, F.raise_error(F.lit("key change with unsent columns"))).otherwise(F.lit("I"))
    gone = F.struct(F.lit("D").alias("op"), F.col("old_key").alias("key"), F.lit(0).alias("step"))
    new = F.struct(whole.alias("op"), F.col("key").alias("key"), F.lit(1).alias("step"))
    same = F.struct(F.col("op").alias("op"), F.col("key").alias("key"), F.lit(0).alias("step"))
    parts = F.explode(F.when(changed, F.array(gone, new)).otherwise(F.array(same)))
    out = events.withColumn("e", parts)
    return out.withColumn("seq", F.col("seq") * 2 + F.col("e.step")).withColumn("op", F.col("e.op")).withColumn("key", F.col("e.key")).drop("e")


def fold(base: DataFrame, events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base after the events: one aggregation over events, one join with base.

    Of each column the last sent value counts; values sent before the row's last
    insert or delete do not.  A null that was sent is a value.  Updates of missing
    rows change nothing; an insert of a present row replaces it.
    """
    e = expand_key_changes(events)
    o = order_of()
    aggregates = [F.max(F.when(F.col("op").isin("I", "D"), o)).alias("reset"), F.max_by("op", o).alias("last"), F.max_by("op", F.when(F.col("op").isin("I", "D"), o)).alias("reset_op")]
    for c in columns:
        sent = (F.col("op") != "D") & ~F.array_contains("unchanged", c)
        aggregates.append(F.max(F.when(sent, F.struct(F.col("lsn").alias("lsn"), F.col("seq").alias("seq"), F.struct(F.col(f"new.{c}").alias("v")).alias("v")))).alias(f"_{c}"))
    state = e.groupBy(F.col("key").alias(key)).agg(*aggregates)
    b = base.select(key, *(F.col(c).alias(f"base_{c}") for c in columns), F.lit(True).alias("present"))
    j = b.join(state, key, "full")
    exists = F.when(F.col("last").isNull(), F.col("present")).when(F.col("last") == "D", F.lit(False)).when(F.col("reset_op") == "I", F.lit(True)).when(F.col("reset_op") == "D", F.lit(False)).otherwise(F.coalesce("present", F.lit(False)))

    def value(c: str) -> Column:
        at = F.struct(F.col(f"_{c}.lsn").alias("lsn"), F.col(f"_{c}.seq").alias("seq"))
        fresh = F.col(f"_{c}").isNotNull() & (F.col("reset").isNull() | (at >= F.col("reset")))
        return F.when(fresh, F.col(f"_{c}.v.v")).when(F.col("reset").isNull(), F.col(f"base_{c}")).alias(c)

    return j.where(exists).select(key, *(value(c) for c in columns))


def missed(base: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """op, n: keys whose first event updates or deletes a row that is not there."""
    first = events.groupBy(F.col("key").alias(key)).agg(F.min_by("op", order_of()).alias("op"))
    return first.where("op <> 'I'").join(base.select(key), key, "left_anti").groupBy("op").agg(F.count("*").alias("n"))


def delete_by_full_identity(base: DataFrame, gone: DataFrame) -> DataFrame:
    """Each deleted row, given by all its columns (nulls equal), removes exactly one equal row."""
    return base.exceptAll(gone.select(base.columns))


def move_by_full_identity(base: DataFrame, old: DataFrame, new: DataFrame, t: ShardedTable) -> DataFrame:
    """Updates that give the whole old and new row: the old one leaves its shard, the new one enters its own."""
    rest = delete_by_full_identity(base.drop("shard"), old.drop("shard"))
    both = rest.unionByName(new.select(rest.columns))
    return both.withColumn("shard", t.shard_column())


def routed(events: DataFrame, t: ShardedTable) -> DataFrame:
    """Events with the shard of their key, by the same function that places rows in batch."""
    return events.withColumn("shard", t.shard_column(F.col("key")))


def lag(sent: DataFrame, applied: DataFrame) -> DataFrame:
    """Distance of the applied position from the newest event, per table."""
    newest = sent.groupBy("table").agg(F.max("lsn").alias("newest"))
    return newest.join(applied, "table", "left").select("table", (F.col("newest") - F.coalesce("lsn", F.lit(0))).alias("lag"))


def check_identity(identity: str, key: list[str], columns: list[str]) -> None:
    """A table can be followed only if its rows can be told apart."""
    if identity == "nothing" or (identity == "key" and not key) or not columns:
        raise RoutingError("the table has no replica identity")


class VersionedState:
    """A table's content and the position that it stands for, published together as numbered versions in a folder.

    A version is a folder with content and position; readers take the newest that is
    complete.  A batch that runs again finds its version or writes the same one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(p)
        self._fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions."""
        root = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/applied/_SUCCESS")))

    def start(self, base: DataFrame, table: str, lsn: int = -1) -> None:
        self.publish(base, self.spark.createDataFrame([(table, lsn)], "table string, lsn long"), 0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.versions()[-1]}/rows")

    def applied(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.versions()[-1]}/applied")

    def publish(self, rows: DataFrame, applied: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{version}/rows")
        applied.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{version}/applied")  # the last step: it makes the version complete


def apply_stream(source: DataFrame, state: VersionedState, decode: Callable[[DataFrame], DataFrame], table: str, key: str, columns: list[str], checkpoint: str):
    """Start a query that decodes each micro-batch, drops what is applied already, and folds the rest into the state.

    A batch that runs again, or that a restart replays from an older position, publishes
    the same content: the gate drops events at or below the applied position.
    """

    def one(batch: DataFrame, number: int) -> None:
        events = gate(decode(batch), state.applied())
        newest = events.agg(F.max("lsn")).first()[0]
        if newest is not None:
            rows = fold(state.read(), events, key, columns)
            state.publish(rows, state.spark.createDataFrame([(table, newest)], "table string, lsn long"), state.versions()[-1] + 1)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
