"""Joins, aggregation, windows, sorting, set operations and subqueries.

Results are those of one database over all rows, whatever the sharding.  Replicated
dimensions are broadcast; sharded tables are joined on their shared key, or by a
shuffle that Spark plans.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vector import l2
from ..session import made_once, read
from ..types import order
from .registry import query, sql_query

# ---------------------------------------------------------------- joins


BUCKETS = 16


def bucketed(spark, sf_dir, name: str, key: str, buckets: int = BUCKETS):
    """A table in buckets of its key (written once per session): tables of equal buckets join without a shuffle.

    The number of buckets is chosen when data is laid out, for tasks of some 128 MB.
    """
    table = f"{name}_by_{key}_{zlib.crc32(sf_dir.encode()):08x}"

    def make(path: str) -> None:
        read(spark, sf_dir, name).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table)

    made_once(spark, sf_dir, f"buckets-{name}-{key}", make)
    return spark.table(table)


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY c_custkey")
def join_left(spark, sf_dir):
    # orders are counted per customer before the join, so the join sees one row per key
    o = read(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("o_orderkey").alias("k"))
    c = read(spark, sf_dir, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("join_multiway", "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_multiway(spark, sf_dir):
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("r_name").agg(F.sum("k").alias("n"), F.round(F.sum("t"), 2).alias("total"))


@query("join_colocated", "SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_colocated(spark, sf_dir):
    """Both tables lie in buckets of the key, sorted: the join and the aggregation need no exchange."""
    o, l = bucketed(spark, sf_dir, "orders", "o_orderkey"), bucketed(spark, sf_dir, "lineitem", "l_orderkey")
    return o.hint("merge").join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


sql_query("join_broadcast_omni", "customer nation", "SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
sql_query("join_omni_omni", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql_query("join_shuffle", "orders customer", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql_query("join_semi", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("join_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql_query("join_right", "orders customer", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
sql_query("join_full", "nation supplier", "SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0")
sql_query("join_cross", "nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region")
sql_query("join_theta", "nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_nationkey < r_regionkey * 3")
sql_query("join_self", "nation", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_lateral", "nation supplier", "SELECT n_nationkey, t.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS t")
sql_query("join_lookup", "customer nation", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")


@query("join_range_mapping", "SELECT o_orderkey, b.shard FROM orders JOIN (VALUES (0, 100, 0), (100, 1000, 1), (1000, 1000000000, 2)) b(lo, hi, shard) ON o_orderkey >= lo AND o_orderkey < hi")
def join_range_mapping(spark, sf_dir):
    """Disjoint ranges as a small relation: the range of a key is found by bisection, within the row; no nested loop."""
    ranges = spark.createDataFrame([(0, 100, 0), (100, 1000, 1), (1000, 1_000_000_000, 2)], "lo long, hi long, shard int")
    return range_join(read(spark, sf_dir, "orders").select("o_orderkey"), ranges, "o_orderkey")


def range_join(df, ranges, key: str, lo: str = "lo", hi: str = "hi", most: int = 1_000_000):
    """df with the columns of the range [lo, hi) that holds its key; ranges are disjoint, a key outside them has no row.

    All ranges travel as one sorted array to every task, so their number is checked;
    a key bisects it, each step a constant number of column operations.
    """
    n = ranges.count()
    if n > most:
        raise ValueError(f"{n} ranges; {most} at most are sent to every task")
    rest = [c for c in ranges.columns if c not in (lo, hi)]
    known = ranges.agg(F.array_sort(F.collect_list(F.struct(lo, hi, *rest))).alias("__ranges"))
    at = F.struct(F.lit(0).alias("a"), F.size("__ranges").alias("b"))  # the first range that begins after the key lies in [a, b]

    def halve(s, _):
        mid = ((s["a"] + s["b"]) / 2).cast("int")
        after = F.get("__ranges", mid)[lo] > F.col(key)
        open_ = s["a"] < s["b"]
        return F.struct(F.when(open_ & ~after, mid + 1).otherwise(s["a"]).alias("a"), F.when(open_ & after, mid).otherwise(s["b"]).alias("b"))

    steps = F.sequence(F.lit(1), F.lit(max(1, n.bit_length() + 1)))
    found = df.crossJoin(F.broadcast(known)).withColumn("__r", F.get("__ranges", F.aggregate(steps, at, halve)["a"] - 1))
    return found.where(F.col(key) < F.col("__r")[hi]).select(*df.columns, *(F.col("__r")[c].alias(c) for c in rest))


# ---------------------------------------------------------------- aggregation

sql_query("agg_count_star", "lineitem", "SELECT count(*) AS n FROM lineitem")
sql_query("agg_count_col", "orders", "SELECT count(CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS n FROM orders")
sql_query("agg_sum", "lineitem", "SELECT round(sum(l_quantity), 2) AS qty, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
sql_query("agg_min", "lineitem", "SELECT min(l_shipdate) AS d, min(l_returnflag) AS f, min(l_extendedprice) AS p FROM lineitem")
sql_query("agg_max", "lineitem", "SELECT max(l_shipdate) AS d, max(l_returnflag) AS f, max(l_extendedprice) AS p FROM lineitem")
sql_query("agg_min_distinct", "orders", "SELECT min(DISTINCT o_custkey) AS lo, max(DISTINCT o_custkey) AS hi FROM orders")
sql_query("agg_avg", "lineitem", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY l_returnflag")
# AVG of intervals adds microseconds in 64 bits and overflows on large tables; as decimals they do not
sql_query("agg_avg_interval", "orders", "SELECT CAST(extract(DAY FROM a) AS INT) AS days, CAST(extract(HOUR FROM a) AS INT) AS hours, a > INTERVAL '0' SECOND AS later FROM (SELECT make_dt_interval(0, 0, 0, CAST(avg(CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2000-01-01 00:00:00', TIMESTAMP_NTZ'2000-01-01 00:00:00' + i) AS DECIMAL(28, 0))) / 1000000 AS DECIMAL(18, 6))) AS a FROM (SELECT TIMESTAMP_NTZ'2030-01-01 00:00:00' - CAST(o_orderdate AS TIMESTAMP_NTZ) AS i FROM orders) t) u", "SELECT floor(a / 86400)::INTEGER AS days, (floor(a / 3600) % 24)::INTEGER AS hours, a > 0 AS later FROM (SELECT avg(epoch(TIMESTAMP '2030-01-01' - o_orderdate::TIMESTAMP)) AS a FROM orders) t")
for _name, _f in (("var_pop", "var_pop"), ("var_samp", "var_samp"), ("stddev_pop", "stddev_pop"), ("stddev_samp", "stddev_samp")):
    sql_query(f"agg_{_name}", "lineitem", f"SELECT l_linestatus, round({_f}(l_quantity), 6) AS v FROM lineitem GROUP BY l_linestatus")
sql_query("agg_count_distinct", "lineitem", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
sql_query("agg_sum_distinct", "lineitem", "SELECT CAST(sum(DISTINCT l_suppkey) AS BIGINT) AS s, round(avg(DISTINCT l_suppkey), 6) AS a FROM lineitem")
sql_query("agg_bool_and", "orders", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS every_one, bool_or(o_totalprice > 400000) AS some_one FROM orders GROUP BY o_orderstatus")
sql_query("agg_array_agg", "nation", "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_string_agg", "nation", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_percentile", "orders", "SELECT round(percentile(o_totalprice, 0.25), 6) AS q1, round(percentile(o_totalprice, 0.5), 6) AS q2 FROM orders", "SELECT round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS q2 FROM orders")
sql_query("agg_corr", "lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS v FROM lineitem")
sql_query("agg_multi", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, max(l_tax) AS t FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("agg_cast", "lineitem", "SELECT CAST(round(sum(l_quantity)) AS BIGINT) AS q, sum(l_quantity) IS NULL AS none FROM lineitem")
sql_query("agg_expression", "lineitem", "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price FROM lineitem GROUP BY l_returnflag")
sql_query("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql_query("agg_filter", "orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders")
sql_query("agg_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("agg_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("agg_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query("agg_approx_distinct", "SELECT abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) < 0.2 * count(DISTINCT l_orderkey) AS close FROM lineitem")
def agg_approx_distinct(spark, sf_dir):
    """The sketch and the exact count are aggregates of their own: in one, Spark keeps and shuffles a sketch of 13 KB for each distinct key."""
    keys = read(spark, sf_dir, "lineitem").select("l_orderkey")
    sketch = keys.agg(F.approx_count_distinct("l_orderkey", 0.01).alias("about"))
    exact = keys.distinct().agg(F.count("l_orderkey").alias("n"))
    return sketch.crossJoin(exact).selectExpr("abs(about - n) < 0.05 * n AS close")


sql_query("agg_approx_percentile", "orders", "SELECT abs(approx_percentile(o_totalprice, 0.5, 10000) - percentile(o_totalprice, 0.5)) < 0.01 * percentile(o_totalprice, 0.5) AS close FROM orders", "SELECT abs(approx_quantile(o_totalprice, 0.5) - quantile_cont(o_totalprice, 0.5)) < 0.05 * quantile_cont(o_totalprice, 0.5) AS close FROM orders")
sql_query("agg_empty", "lineitem", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_shipdate) AS d FROM lineitem WHERE l_orderkey < 0")
sql_query("groupby_ordinal", "orders", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
sql_query("groupby_column", "orders", "SELECT orders.o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
sql_query("groupby_expr", "orders", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")
sql_query("groupby_no_agg", "customer", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
sql_query("groupby_functional_dep", "customer orders", "SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql_query("groupby_null", "orders", "SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS k FROM orders) t GROUP BY k")
sql_query("groupby_array", "orders", "SELECT array_join(a, '-') AS a, count(*) AS n FROM (SELECT array(array(o_orderstatus), array(substr(o_orderpriority, 1, 1)))[1] AS a FROM orders) t GROUP BY a", "SELECT array_to_string(a, '-') AS a, count(*) AS n FROM (SELECT [substr(o_orderpriority, 1, 1)] AS a FROM orders) t GROUP BY a")
sql_query("groupby_interval", "orders", "SELECT CAST(extract(DAY FROM i) AS INT) AS days, count(*) AS n FROM (SELECT CAST(o_orderdate AS TIMESTAMP_NTZ) - CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS i FROM orders) t GROUP BY i", "SELECT datediff('day', date_trunc('month', o_orderdate)::DATE, o_orderdate::DATE)::INTEGER AS days, count(*) AS n FROM orders GROUP BY o_orderdate::TIMESTAMP - date_trunc('month', o_orderdate)::TIMESTAMP, 1")
sql_query("groupby_multidim", "orders", "SELECT array_join(transform(a, x -> array_join(x, '-')), '|') AS a, count(*) AS n FROM (SELECT array(array(o_orderstatus), array(substr(o_orderpriority, 1, 1), 'x')) AS a FROM orders) t GROUP BY a", "SELECT o_orderstatus || '|' || substr(o_orderpriority, 1, 1) || '-x' AS a, count(*) AS n FROM orders GROUP BY 1")

# ---------------------------------------------------------------- windows

sql_query("window_row_number", "orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders")
sql_query("window_rank", "customer", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 6) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment), 6) AS u FROM customer")
sql_query("window_lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders")
sql_query("window_running_sum", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
sql_query("window_range_frame", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM lineitem")
sql_query("window_ntile", "customer", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer")
sql_query("window_first_last", "orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")

# ---------------------------------------------------------------- sorting and limits

sql_query("sort_ordinal", "nation", "SELECT n_name, n_regionkey FROM nation ORDER BY 2, 1")
sql_query("sort_asc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey")
sql_query("sort_desc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey")
sql_query("sort_expr", "orders", "SELECT o_orderkey FROM orders ORDER BY abs(o_totalprice - 100000), o_orderkey")


@query("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey")
def sort_multi(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(order("c_mktsegment"), order("c_acctbal", descending=True), "c_custkey")


@query("sort_nulls", "SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 END AS k FROM orders) t ORDER BY k DESC NULLS FIRST, o_orderkey")
def sort_nulls(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 7).alias("k"))
    return o.orderBy(order("k", descending=True), "o_orderkey")


@query("vector_l2", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS d FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def vector_l2(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    goal = F.array(*(F.lit(float(x)) for x in v.where("vec_id = 0").first().embedding))
    return v.select("vec_id", F.round(l2(F.col("embedding"), goal), 4).alias("d"))


@query("vector_knn", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS d FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 5) b ORDER BY d, vec_id LIMIT 10")
def vector_knn(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    goal = F.array(*(F.lit(float(x)) for x in v.where("vec_id = 5").first().embedding))
    return v.select("vec_id", F.round(l2(F.col("embedding"), goal), 4).alias("d")).orderBy("d", "vec_id").limit(10)


sql_query("limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
sql_query("topk", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
sql_query("limit_expression", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 2 * 3 + 4")
sql_query("limit_all", "nation", "SELECT n_nationkey FROM nation ORDER BY n_name LIMIT ALL", "SELECT n_nationkey FROM nation ORDER BY n_name")
sql_query("limit_only", "orders", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 17) t")


@query("limit_param", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12")
def limit_param(spark, sf_dir):
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT :most", args={"most": 12})


sql_query("distinct_rows", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    """First row of each key in sort order, as a maximum over structs: partial aggregation, no sort of a key's rows."""
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey"))).alias("b")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


# ---------------------------------------------------------------- set operations, CTEs, subqueries

sql_query("union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql_query("intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql_query("except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
sql_query("except_all", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql_query("cte_basic", "orders", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
sql_query("cte_recursive", "", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
sql_query("subquery_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
sql_query("subquery_correlated", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")

# ---------------------------------------------------------------- the flagship query


def pricing_summary(spark, sf_dir):
    """Line items by status: two-phase aggregation over all shards, PostgreSQL order."""
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 6).alias("avg_price")).orderBy(order("l_returnflag"))


query("pricing_summary", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 6) AS avg_price FROM lineitem GROUP BY l_returnflag")(pricing_summary)
query("clickbench_q3", "SELECT sum(l_suppkey)::BIGINT AS s, count(*) AS n, round(avg(l_quantity), 6) AS a FROM lineitem")(lambda spark, sf_dir: read(spark, sf_dir, "lineitem").agg(F.sum("l_suppkey").alias("s"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("a")))
query("clickbench_q4", "SELECT round(avg(user_id), 6) AS a FROM events")(lambda spark, sf_dir: read(spark, sf_dir, "events").agg(F.round(F.avg("user_id"), 6).alias("a")))


@query("window_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r <= 2")
def window_top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey")
