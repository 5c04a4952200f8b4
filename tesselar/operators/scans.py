"""Scans of sharded and replicated tables, projection, filters and pruning."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.partition import centroid_shards, shard_of
from ..plans.catalog import Catalog, RoutingError, ShardedTable, one_copy, write_sharded
from ..plans.planner import check_same_shape, explain, prune, prune_relation, pruned, relations, route, route_statement
from ..plans.admin import system_columns, system_tables
from ..plans.store import Store
from ..session import fresh_folder, made_once, read, views
from .params import bound
from .registry import query, sql_query

ORDERS = ShardedTable("orders", "o_orderkey", 4)
LINEITEM = ShardedTable("lineitem", "l_orderkey", 4)
CUSTOMER = ShardedTable("customer", "c_custkey", 4)
EVENTS = ShardedTable("events", "user_id", 4)
CATALOG = Catalog(4, [ORDERS, LINEITEM, CUSTOMER, EVENTS], {"nation", "region", "part", "supplier"}, columns={"orders": ["o_orderkey"], "lineitem": ["l_orderkey"], "customer": ["c_custkey"], "events": ["user_id"]})


def sharded(spark, sf_dir, t: ShardedTable):
    """The table as write_sharded stores it (written once per session); shard is its storage partition."""
    path = made_once(spark, sf_dir, f"sharded-{t.name}", lambda p: write_sharded(read(spark, sf_dir, t.name), t, p))
    return spark.read.parquet(path)


@query("scan_direct_shard", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def scan_direct_shard(spark, sf_dir):
    return pruned(sharded(spark, sf_dir, ORDERS), ORDERS, "o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_multi_shard", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 7, 11)")
def scan_multi_shard(spark, sf_dir):
    return pruned(sharded(spark, sf_dir, ORDERS), ORDERS, "o_orderkey IN (1, 2, 3, 5, 7, 11)").select("o_orderkey", "o_totalprice")


@query("scan_all_shards", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def scan_all_shards(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("scan_gather_unordered", "SELECT o_orderkey, o_orderpriority FROM orders")
def scan_gather_unordered(spark, sf_dir):
    """All shards in whatever order they come: one scan over their folders."""
    return one_copy(sharded(spark, sf_dir, ORDERS), ORDERS).select("o_orderkey", "o_orderpriority")


@query("scan_omni", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_omni(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("scan_omni_dedup", "SELECT r_regionkey, r_name FROM region")
def scan_omni_dedup(spark, sf_dir):
    """A replicated table stored once per shard: one shard's copy is read."""
    copies = read(spark, sf_dir, "region").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return copies.where("shard = 0").select("r_regionkey", "r_name")


sql_query("scan_no_table", "", "SELECT 1 AS one, 'a' || 'b' AS ab")
sql_query("scan_values", "", "SELECT id, label FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS t(id, label)")
sql_query("project_basic", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")


@query("prune_eq", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE 42 = l_orderkey")
def prune_eq(spark, sf_dir):
    return pruned(sharded(spark, sf_dir, LINEITEM), LINEITEM, "42 = l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("prune_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (3, 33, 66) AND l_quantity > 5")
def prune_in(spark, sf_dir):
    return pruned(sharded(spark, sf_dir, LINEITEM), LINEITEM, "l_orderkey IN (3, 33, 66) AND l_quantity > 5").select("l_orderkey", "l_linenumber")


@query("prune_and", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 2, 3, 4) AND (o_orderkey = 3 OR o_orderkey = 4)")
def prune_and(spark, sf_dir):
    return pruned(sharded(spark, sf_dir, ORDERS), ORDERS, "o_orderkey IN (1, 2, 3, 4) AND (o_orderkey = 3 OR o_orderkey = 4)").select("o_orderkey", "o_orderstatus")


@query("filter_any_array", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = ANY([1, 2, 3])")
def filter_any_array(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(F.array_contains(F.array(*(F.lit(x).cast("long") for x in (1, 2, 3))), F.col("o_custkey"))).select("o_orderkey", "o_custkey")


@query("filter_null_safe_eq", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IS NOT DISTINCT FROM 5")
def filter_null_safe_eq(spark, sf_dir):
    return pruned(sharded(spark, sf_dir, ORDERS), ORDERS, "o_orderkey <=> 5").select("o_orderkey", "o_orderdate")


sql_query("filter_or", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey = 3 OR o_totalprice > 400000")
sql_query("filter_range", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority LIKE '1%' AND o_orderstatus <> 'P'")
sql_query("filter_is_null", "orders", "SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS k FROM orders) t WHERE k IS NULL")
sql_query("filter_is_not_null", "orders", "SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS k FROM orders) t WHERE k IS NOT NULL")


@query("filter_param", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 9 AND o_totalprice > 0.5")
def filter_param(spark, sf_dir):
    args = {"key": 9, "least": 0.5}
    return pruned(sharded(spark, sf_dir, ORDERS), ORDERS, "o_orderkey = :key AND o_totalprice > :least", args).select("o_orderkey", "o_totalprice")


@query("prepared_param_query", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < 50 GROUP BY o_orderstatus")
def prepared_param_query(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < :most GROUP BY o_orderstatus", args={"most": 50})


sql_query("subquery_in_filter", "orders customer", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")


@query("tenant_filter", "SELECT event_type, count(*) AS n FROM events WHERE user_id = 7 GROUP BY event_type")
def tenant_filter(spark, sf_dir):
    """A statement without a filter on the tenant column is refused."""
    guarded = Catalog(4, [EVENTS], tenant_column="user_id")
    try:
        route(spark, guarded, "events", "event_type = 'click'")
    except RoutingError:
        pass
    else:
        raise AssertionError("the tenant guard let a statement pass")
    route(spark, guarded, "events", "user_id = 7")
    return pruned(sharded(spark, sf_dir, EVENTS), EVENTS, "user_id = 7").groupBy("event_type").agg(F.count("*").alias("n"))


@query("validate_shard_schema", "SELECT n_nationkey, n_name FROM nation")
def validate_shard_schema(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    try:
        check_same_shape(n, n.withColumnRenamed("n_name", "other"))
    except RoutingError:
        return check_same_shape(n.where("n_nationkey % 2 = 0"), n.where("n_nationkey % 2 = 1"))
    raise AssertionError("shards of different shape were united")


@query("catalog_columns", "SELECT table_name, ordinal_position::INTEGER AS position, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type, TRUE AS nullable, column_name IN ('o_orderkey', 'l_orderkey', 'c_custkey') AND table_name = CASE left(column_name, 1) WHEN 'o' THEN 'orders' WHEN 'l' THEN 'lineitem' ELSE 'customer' END AS is_sharding_key FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'customer', 'nation', 'region')")
def catalog_columns(spark, sf_dir):
    """Columns of the registered tables with their position, type and sharding."""
    rows = []
    for name in ("orders", "lineitem", "customer", "nation", "region"):
        t = CATALOG.sharded(name)
        rows += [(name, i, f.name, f.dataType.simpleString(), f.nullable, bool(t and t.column == f.name)) for i, f in enumerate(read(spark, sf_dir, name).schema, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean, is_sharding_key boolean")


def _trace() -> str:
    from ..plans.planner import name_of

    got = name_of(ORDERS.shards_of(1) | ORDERS.shards_of(2))
    lines = [f"Summary: shard={got} role=replica", f"{got}: orders.o_orderkey matched", f"{got}: sharded tables together"]
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(lines)) + ") t(line, plan)"


@query("explain_route", _trace())
def explain_route(spark, sf_dir):
    r = route(spark, CATALOG, "orders", "o_orderkey IN (1, 2)", sql="/* tesselar_role: replica */ SELECT * FROM orders WHERE o_orderkey IN (1, 2)")
    return explain(spark, r)


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def read_centroids(spark, path: str, most_bytes: int = 64 << 20) -> list[list[float]]:
    """Centroids from a file that holds a JSON array of vectors of one length."""
    text, size = spark.read.text(path, wholetext=True).select("value", F.octet_length("value")).first()
    if size > most_bytes:
        raise RoutingError(f"{path} has {size} bytes; centroids are kept by every task")
    vectors = [list(map(float, v)) for v in json.loads(text)]
    if not vectors or len({len(v) for v in vectors}) != 1 or not vectors[0]:
        raise RoutingError(f"{path}: centroids must be vectors of one length")
    return vectors


def centroids_of(spark, sf_dir, n: int = 8) -> list[list[float]]:
    """The first n vectors by id stand for trained centroids."""
    return [list(r.embedding) for r in _vectors(spark, sf_dir).orderBy("vec_id").limit(n).collect()]


_ANN_SQL = """
WITH c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) AS i, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 8),
d AS (SELECT v.vec_id, c.i, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], c.e::DOUBLE[]), c.i) AS r FROM embeddings v, c),
w AS (SELECT e FROM c WHERE i = 3),
q AS (SELECT DISTINCT i % 4 AS s FROM (SELECT a.i, row_number() OVER (ORDER BY list_distance(a.e::DOUBLE[], w.e::DOUBLE[]), a.i) AS r FROM c a, w) WHERE r <= 3)
SELECT v.vec_id, round(list_distance(v.embedding::DOUBLE[], w.e::DOUBLE[]), 4) AS distance FROM embeddings v JOIN d ON d.vec_id = v.vec_id AND d.r = 1, w WHERE d.i % 4 IN (SELECT s FROM q) ORDER BY 2, 1 LIMIT 10
"""


@query("ann_probe_topk", _ANN_SQL)
def ann_probe_topk(spark, sf_dir):
    """The ten nearest vectors among the shards that the query's nearest centroids lie on: approximate by design."""
    from ..functions.vector import l2

    c = centroids_of(spark, sf_dir)
    want = c[3]
    t = ShardedTable("embeddings", "embedding", 4, kind="vector", centroids=tuple(map(tuple, c)))
    near = sorted(t.shards_of(want))
    v = _vectors(spark, sf_dir).withColumn("shard", F.element_at(centroid_shards(F.col("embedding"), c, 4, 1), 1)).where(F.col("shard").isin(near))
    goal = F.array(*(F.lit(float(x)) for x in want))
    return v.select("vec_id", F.round(l2(F.col("embedding"), goal), 4).alias("distance")).orderBy("distance", "vec_id").limit(10)


@query("alias_pruned_join", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey = 7 AND o.o_totalprice > 0")
def alias_pruned_join(spark, sf_dir):
    """Each relation of a statement is pruned by the conditions on its own alias."""
    sql = "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_orderkey = 7 AND o.o_totalprice > 0"
    got = {r.alias: prune_relation(CATALOG.sharded(r.name), r) for r in relations(spark, sql)}
    if got != {"o": None, "l": LINEITEM.shards_of(7)}:
        raise AssertionError(got)
    o = one_copy(sharded(spark, sf_dir, ORDERS), ORDERS).alias("o")
    l = sharded(spark, sf_dir, LINEITEM).where(F.col("shard").isin(*got["l"])).alias("l")
    return o.join(l, F.expr("o.o_orderkey = l.l_orderkey")).where("l.l_orderkey = 7 AND o.o_totalprice > 0").select("o.o_orderkey", "l.l_linenumber")


@query("join_schema_qualified", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def join_schema_qualified(spark, sf_dir):
    """Tables of one placed schema lie together: the join sees one shard."""
    placed = Catalog(4, schemas={"east": 1, "west": 2})
    if route_statement(spark, placed, "SELECT * FROM east.nation n JOIN east.region r ON n.n_regionkey = r.r_regionkey").shards != frozenset({1}):
        raise AssertionError("one schema is one shard")
    if route_statement(spark, placed, "SELECT * FROM west.nation n JOIN east.region r ON n.n_regionkey = r.r_regionkey").shards != frozenset({2}):
        raise AssertionError("the first schema decides")
    east = Store(spark, fresh_folder(spark, "store"), placed)
    for name in ("nation", "region"):
        east.create(f"east.{name}", read(spark, sf_dir, name))
    n, r = (east.read(f"east.{x}") for x in ("nation", "region"))
    return n.join(r, (F.col("n_regionkey") == F.col("r_regionkey")) & (n.shard == r.shard)).where("r_name = 'ASIA'").select("n_name", "r_name")


@query("system_tables", "SELECT table_name AS name, count(*) AS columns FROM information_schema.columns WHERE table_name IN ('nation', 'region') GROUP BY 1")
def system_tables_query(spark, sf_dir):
    views(spark, sf_dir, "nation", "region")
    c = system_columns(spark).where(F.col("table_name").isin("nation", "region"))
    return c.join(system_tables(spark).select(F.col("name").alias("table_name")), "table_name").groupBy(F.col("table_name").alias("name")).agg(F.count("*").alias("columns"))


@query("centroid_file", "SELECT vec_id, 1 AS near FROM embeddings ORDER BY vec_id LIMIT 8")
def centroid_file(spark, sf_dir):
    """Centroids kept as a JSON file and read back: each of the vectors they were made of is its own nearest."""
    c = centroids_of(spark, sf_dir)
    path = fresh_folder(spark, "centroids")
    spark.createDataFrame([(json.dumps(c),)], "value string").coalesce(1).write.text(path)
    t = ShardedTable("embeddings", "embedding", 8, kind="vector", centroids=tuple(map(tuple, read_centroids(spark, path))), probes=1)
    rows = _vectors(spark, sf_dir).orderBy("vec_id").limit(8).collect()
    return spark.createDataFrame([(r.vec_id, len(t.shards_of(list(r.embedding)))) for r in rows], "vec_id long, near int")
