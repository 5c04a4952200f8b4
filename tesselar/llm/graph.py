"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_jobs, small_side, stored


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the node's smallest one, or the node itself."""
    both = e.union(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked with the smallest one."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, root: every node of an edge with the smallest node that it is connected with.

    Alternates large-star and small-star steps until the edges are stars; each round is
    stored, so lineage stays short and a lost executor repeats tasks only.  Smallest
    neighbours come from aggregations and joins, so a node of very many edges needs no
    task of its own.  It takes a logarithmic number of rounds; they end when one changes
    nothing.
    """
    e = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        e = stored(_small_star(_large_star(e)), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """roots (node, root: a smaller node that it is connected with; other nodes are their own) after more edges (u, v); stored, and to be broadcast if small."""
    with short_jobs(edges.sparkSession):
        return small_side(_merged(roots, edges))


def _merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    if roots is None:
        return stored(components(edges).where("node <> root"), "roots")
    e = edges
    for end in ("u", "v"):
        at = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        e = e.join(at, end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    more = stored(components(e).where("node <> root"), "more")
    on = small_side(more).select(F.col("node").alias("root"), F.col("root").alias("lower"))
    return stored(roots.join(on, "root", "left").select("node", F.coalesce("lower", "root").alias("root")).unionByName(more), "roots")
