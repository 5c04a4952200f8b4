"""Moving a table from N to M shards, and the decision to cut over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import ShardedTable, one_copy, with_shard, write_sharded


def reshard(source: DataFrame, target: ShardedTable, origin: ShardedTable | None = None) -> DataFrame:
    """Rows with the shard that the target's function gives them; copies of rows that lay on all shards by the origin's rule (the target's if none is given) are taken once."""
    return with_shard(one_copy(source, origin or target).drop("shard"), target)


def reshard_omni(copies: DataFrame, sources: int, shards: int) -> DataFrame:
    """Every target shard gets the rows of one source copy: source i owns the targets d with d % sources = i."""
    targets = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda d: F.when(d % sources == F.col("shard"), d)))
    return copies.withColumn("shard", F.explode(targets))


def copy_tables(spark: SparkSession, tables: dict[str, tuple[DataFrame, ShardedTable]], path: str) -> DataFrame:
    """Writes each table under path/<name>; returns table, shard and rows, read back from what was written."""
    out = None
    for name, (df, target) in tables.items():
        write_sharded(df.drop("shard"), target, f"{path}/{name}")
        n = spark.read.parquet(f"{path}/{name}").groupBy("shard").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "shard", "rows")
        out = n if out is None else out.unionByName(n)
    return out


@dataclass(frozen=True)
class CutoverPolicy:
    timeout_s: float
    lag_bytes: int
    idle_s: float

    def ready(self, elapsed_s: float, lag_bytes: int, idle_s: float) -> str | None:
        """Why to cut over now: timeout, lag or idle, in this order; None: not yet."""
        if elapsed_s >= self.timeout_s:
            return "timeout"
        if lag_bytes <= self.lag_bytes:
            return "lag"
        return "idle" if idle_s > self.idle_s else None


def cut_over(spark: SparkSession, view: str, path: str) -> None:
    """Point the view at the new copy; readers see the old one or the new one."""
    spark.read.parquet(path).createOrReplaceTempView(view)
