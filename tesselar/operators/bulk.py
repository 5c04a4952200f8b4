"""Bulk load and unload queries, mirroring, publish/subscribe and admin views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.admin import Engine, TableCopies, admin_shards
from ..plans.catalog import ShardedTable, with_shard
from ..plans.planner import QueryCache, route
from ..session import fresh_folder, read
from ..sources.copy import BinaryCopySource, read_csv, read_text, to_text, write_binary, write_csv
from ..streaming.pubsub import channel_shard, notify, tee
from .registry import query
from .scans import CATALOG, ORDERS


def _folder(spark) -> str:
    """A fresh path below the folder that driver and executors share."""
    return fresh_folder(spark, "copy")


_COLUMNS = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice", F.concat(F.col("o_orderpriority"), F.lit('\t"x", \\y')).alias("o_orderpriority"))


_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority || chr(9) || '\"x\", \\y' AS o_orderpriority FROM orders"


@query("copy_in_text", _SQL)
def copy_in_text(spark, sf_dir):
    path = _folder(spark)
    to_text(_orders(spark, sf_dir)).write.mode("overwrite").text(path)
    return read_text(spark, path, _COLUMNS)


@query("copy_in_csv", _SQL)
def copy_in_csv(spark, sf_dir):
    path = _folder(spark)
    write_csv(_orders(spark, sf_dir), path, header=True, mode="overwrite")
    return read_csv(spark, path, _COLUMNS, header=True)


@query("copy_out_csv", _SQL)
def copy_out_csv(spark, sf_dir):
    path = _folder(spark)
    write_csv(_orders(spark, sf_dir), path, sep=";", null="NULL", mode="overwrite")
    return read_csv(spark, path, _COLUMNS, sep=";", null="NULL", lines=True)


@query("copy_in_binary", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM (" + _SQL + ") t")
def copy_in_binary(spark, sf_dir):
    """Rows are written as binary COPY files and read back by the data source."""
    path = _folder(spark)
    write_binary(_orders(spark, sf_dir), path)
    return read_binary(spark, path, _COLUMNS)


def read_binary(spark, path: str, schema: str):
    spark.dataSource.register(BinaryCopySource)
    return spark.read.format("copy_binary").schema(schema).load(path)


@query("copy_out_all", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def copy_out_all(spark, sf_dir):
    """All shards are written out and read as one."""
    path = _folder(spark)
    with_shard(read(spark, sf_dir, "orders"), ORDERS).write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("copy_route_rows", "SELECT CASE WHEN o_orderkey < 500 THEN 0 ELSE 1 END AS shard, count(*) AS n FROM orders GROUP BY 1")
def copy_route_rows(spark, sf_dir):
    t = ShardedTable("orders", "o_orderkey", 2, ranges=((None, 500, 0), (500, None, 1)))
    return with_shard(read(spark, sf_dir, "orders"), t).groupBy("shard").agg(F.count("*").alias("n"))


@query("mirror_sample", "SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'click' AND ('0x' || substr(sha1(user_id::VARCHAR), 33, 8))::BIGINT % 1000000 < 300000 GROUP BY 1, 2")
def mirror_sample(spark, sf_dir):
    """The mirror gets whole transactions, chosen by their key, of the kinds that its filter lets pass; the main sink gets all."""
    path = _folder(spark)
    e = read(spark, sf_dir, "events")
    tee(e, f"{path}/main", f"{path}/mirror", "user_id", 0.3, kinds=F.col("event_type") != "click")
    if spark.read.parquet(f"{path}/main").count() != e.count():
        raise AssertionError("the main sink is not whole")
    return spark.read.parquet(f"{path}/mirror").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("pubsub_channel_counts", "SELECT event_type AS channel, count(*) AS n FROM events GROUP BY event_type")
def pubsub_channel_counts(spark, sf_dir):
    """Notifications per channel; every notification of a channel is on the channel's shard."""
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), channel_shard(F.col("event_type"), 4).alias("shard"))
    return e.groupBy("channel", "shard").agg(F.count("*").alias("n")).drop("shard")


@query("pubsub_notify", "SELECT listener, event_type AS channel, count(*) AS n, sum(event_id)::BIGINT AS payloads FROM events JOIN (VALUES ('l1', 'click'), ('l2', 'click'), ('l2', 'purchase')) t(listener, channel) ON event_type = channel WHERE event_id % 10 <> 8 GROUP BY 1, 2")
def pubsub_notify(spark, sf_dir):
    """What each listener hears on its channels: notifications of committed transactions."""
    m = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("payload"), (F.col("event_id") % 10 != 8).alias("committed"))
    heard = notify(m, spark.createDataFrame([("l1", "click"), ("l2", "click"), ("l2", "purchase")], "listener string, channel string"))
    return heard.groupBy("listener", "channel").agg(F.count("*").alias("n"), F.sum("payload").alias("payloads"))


@query("admin_show", "SELECT * FROM (VALUES ('shards', 4), ('sharded_tables', 4), ('omni_tables', 4), ('schemas', 0), ('prepared', 0), ('queries', 0)) t(list, items)")
def admin_show(spark, sf_dir):
    return Engine(spark, CATALOG).show("SHOW lists list, items")


@query("admin_query_cache", "SELECT * FROM (VALUES ('SELECT * FROM orders WHERE o_orderkey = ?', 3, 3, 0), ('SELECT count(*) FROM orders', 1, 0, 1)) t(query, hits, direct, multi)")
def admin_query_cache(spark, sf_dir):
    cache = QueryCache()
    for key in (1, 2, 3):
        predicate = f"o_orderkey = {key}"
        cache.record(f"SELECT * FROM orders WHERE {predicate}", route(spark, CATALOG, "orders", predicate))
    cache.record("SELECT count(*) FROM orders", route(spark, CATALOG, "orders"))
    return cache.frame(spark)


@query("admin_table_copies", "SELECT * FROM (SELECT 'orders' AS \"table\", 'done' AS status, count(*) AS \"rows\", TRUE AS measured FROM orders UNION ALL SELECT 'customer', 'done', count(*), TRUE FROM customer) t")
def admin_table_copies_query(spark, sf_dir):
    """Copies of two tables, with the rows, bytes and time that the writes themselves took."""
    copies = TableCopies(spark)
    for name, t in (("orders", ORDERS), ("customer", CATALOG.sharded("customer"))):
        copies.run(name, read(spark, sf_dir, name), t, f"{_folder(spark)}/{name}")
    got = copies.frame()
    return got.select("table", "status", "rows", ((F.col("bytes") > 0) & (F.col("elapsed_ms") > 0) & (F.col("bytes_per_sec") > 0)).alias("measured"))


@query("admin_shards", "SELECT name, column_name, shards, kind FROM (VALUES ('orders', 'o_orderkey', 4, 'bigint'), ('lineitem', 'l_orderkey', 4, 'bigint'), ('customer', 'c_custkey', 4, 'bigint'), ('events', 'user_id', 4, 'bigint'), ('nation', NULL, 4, 'omni'), ('region', NULL, 4, 'omni'), ('part', NULL, 4, 'omni'), ('supplier', NULL, 4, 'omni')) t(name, column_name, shards, kind)")
def admin_shards_query(spark, sf_dir):
    return admin_shards(spark, CATALOG)
