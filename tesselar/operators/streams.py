"""Change-data capture and event-time window queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..session import read
from ..sources import pgoutput
from ..streaming import cdc
from .bulk import _folder
from .registry import query
from .scans import EVENTS
from .sharding import _hash_sql

_TYPE = "key long, op string"


def _base(spark, sf_dir):
    """The state that the events change: even users, with the status they start in."""
    e = read(spark, sf_dir, "events").where("user_id % 2 = 0")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.lit("start").alias("status"), F.lit(0.0).alias("amount"))


def _changes(spark, sf_dir, ops: str = "IUPD"):
    """Changes made from the events table: event_id is the lsn, its remainder by 10 the operation (P: an update that leaves amount unsent)."""
    m = F.col("event_id") % 10
    op = F.when(m == 9, "I").when(m == 8, "D").when(m >= 6, "P").otherwise("U")
    e = read(spark, sf_dir, "events").select(F.lit("accounts").alias("table"), F.col("event_id").alias("lsn"), F.lit(0).alias("seq"), op.alias("kind"), F.col("user_id").alias("key"), F.lit(None).cast("long").alias("old_key"), F.struct(F.col("event_type").alias("status"), F.col("value").alias("amount")).alias("new"))
    e = e.where(F.col("kind").isin(*ops))
    return e.withColumn("unchanged", F.when(F.col("kind") == "P", F.array(F.lit("amount"))).otherwise(F.array().cast("array<string>"))).withColumn("op", F.when(F.col("kind") == "P", "U").otherwise(F.col("kind"))).drop("kind")


def _fold_sql(ops: str, result: str = "SELECT id, status, round(amount, 6) AS amount FROM state") -> str:
    """DuckDB: values after a key's last insert or delete, else the base row's."""
    kinds = ", ".join(f"'{o}'" for o in ops)
    return f"""
WITH base AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 = 0),
ch AS (SELECT * FROM (SELECT event_id AS lsn, user_id AS id, event_type AS status, value AS amount, CASE WHEN event_id % 10 = 9 THEN 'I' WHEN event_id % 10 = 8 THEN 'D' WHEN event_id % 10 >= 6 THEN 'P' ELSE 'U' END AS op FROM events) t WHERE op IN ({kinds})),
r AS (SELECT id, max(lsn) FILTER (op IN ('I', 'D')) AS reset, arg_max(op, lsn) AS last, arg_max(op, lsn) FILTER (op IN ('I', 'D')) AS reset_op FROM ch GROUP BY id),
v AS (SELECT ch.id, arg_max(status, lsn) FILTER (op <> 'D') AS status, arg_max(amount, lsn) FILTER (op IN ('I', 'U')) AS amount, count(*) FILTER (op IN ('I', 'U')) AS n FROM ch JOIN r ON ch.id = r.id AND (r.reset IS NULL OR ch.lsn >= r.reset) GROUP BY ch.id),
state AS (SELECT coalesce(b.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'start' ELSE v.status END AS status, CASE WHEN r.id IS NULL THEN 0.0 WHEN v.n > 0 THEN v.amount WHEN r.reset IS NULL THEN 0.0 END AS amount
    FROM base b FULL JOIN r ON b.id = r.id LEFT JOIN v ON v.id = r.id
    WHERE CASE WHEN r.id IS NULL THEN true WHEN last = 'D' THEN false WHEN reset_op = 'I' THEN true WHEN reset_op = 'D' THEN false ELSE b.id IS NOT NULL END)
{result}"""


def _folded(spark, sf_dir, ops):
    return cdc.fold(_base(spark, sf_dir), _changes(spark, sf_dir, ops), "id", ["status", "amount"]).select("id", "status", F.round("amount", 6).alias("amount"))


@query("cdc_delete", "SELECT DISTINCT user_id AS id, 'start' AS status, 0.0::DOUBLE AS amount FROM events WHERE user_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 = 8 AND event_type = 'purchase')")
def cdc_delete(spark, sf_dir):
    """Deletes of the users that a purchase event of a certain number names; the others stay."""
    bought = _changes(spark, sf_dir, "D").where("new.status = 'purchase'")
    return cdc.fold(_base(spark, sf_dir), bought, "id", ["status", "amount"]).select("id", "status", F.round("amount", 6).alias("amount"))


for _name, _ops in (("cdc_insert", "I"), ("cdc_update", "U"), ("cdc_partial_update", "UP"), ("cdc_apply", "IUPD")):
    query(_name, _fold_sql(_ops))(lambda spark, sf_dir, ops=_ops: _folded(spark, sf_dir, ops))


@query("cdc_key_change", "SELECT CASE WHEN id % 4 = 0 THEN id + 1000000 ELSE id END AS id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE 'start' END AS status FROM (SELECT DISTINCT user_id AS id FROM events WHERE user_id % 2 = 0)")
def cdc_key_change(spark, sf_dir):
    b = _base(spark, sf_dir)
    e = b.where("id % 4 = 0").select(F.lit("accounts").alias("table"), F.col("id").alias("lsn"), F.lit(0).alias("seq"), F.lit("U").alias("op"), (F.col("id") + 1_000_000).alias("key"), F.col("id").alias("old_key"), F.struct(F.lit("moved").alias("status"), F.lit(1.0).alias("amount")).alias("new"), F.array().cast("array<string>").alias("unchanged"))
    return cdc.fold(b, e, "id", ["status", "amount"]).select("id", "status")


@query("cdc_lsn_gate", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id > 500")
def cdc_lsn_gate(spark, sf_dir):
    applied = spark.createDataFrame([("accounts", 500)], "table string, lsn long")
    return cdc.gate(_changes(spark, sf_dir), applied).agg(F.count("*").alias("n"), F.min("lsn").alias("first"))


@query("cdc_route", _hash_sql("events", "user_id", 4) + "SELECT k AS key, shard, count(*) AS n FROM hashed GROUP BY k, shard")
def cdc_route(spark, sf_dir):
    """Events go to the shard that holds their key's row."""
    return cdc.routed(_changes(spark, sf_dir), EVENTS).groupBy("key", "shard").agg(F.count("*").alias("n"))


@query("cdc_lag", "SELECT 'accounts' AS \"table\", max(event_id) - 100 AS lag FROM events")
def cdc_lag(spark, sf_dir):
    return cdc.lag(_changes(spark, sf_dir), spark.createDataFrame([("accounts", 100)], "table string, lsn long"))


@query("cdc_missed_rows", "WITH f AS (SELECT user_id, CASE WHEN min(event_id) % 10 = 9 THEN 'I' WHEN min(event_id) % 10 = 8 THEN 'D' ELSE 'U' END AS op FROM events WHERE user_id % 2 = 1 GROUP BY user_id) SELECT op, count(*) AS n FROM f WHERE op <> 'I' GROUP BY op")
def cdc_missed_rows(spark, sf_dir):
    return cdc.missed(_base(spark, sf_dir), _changes(spark, sf_dir), "id")


_TWICE = "SELECT event_type, user_id % 5 AS k FROM events"


@query("cdc_delete_full_identity", f"SELECT event_type, k, count(*) AS n FROM (({_TWICE}) EXCEPT ALL (SELECT DISTINCT event_type, k FROM ({_TWICE}) t)) u GROUP BY event_type, k")
def cdc_delete_full_identity(spark, sf_dir):
    b = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("k"))
    return cdc.delete_by_full_identity(b, b.distinct()).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("cdc_full_identity_move", "SELECT user_id + CASE WHEN event_type = 'click' THEN 7 ELSE 0 END AS user_id, event_id, event_type FROM events")
def cdc_full_identity_move(spark, sf_dir):
    b = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    old = b.where("event_type = 'click'")
    return cdc.move_by_full_identity(b, old, old.withColumn("user_id", F.col("user_id") + 7), EVENTS).drop("shard")


def _stream(spark, sf_dir):
    """The events table as a stream of files; event time needs an instant, which the session's time zone gives."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _collected(spark, stream, mode: str = "append"):
    """Run a stream over what is there; append goes to files, complete to the last batch's files."""
    base = _folder(spark)

    def put(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("cdc_source", "SELECT count(*) AS n, max(event_id) AS newest FROM events")
def cdc_source(spark, sf_dir):
    s = _stream(spark, sf_dir).select(F.col("event_id").alias("lsn"), "user_id")
    return _collected(spark, s).agg(F.count("*").alias("n"), F.max("lsn").alias("newest"))


@query("stream_tumbling", "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    w = _stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return _collected(spark, w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("stream_sliding", "SELECT date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR * k AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    w = _stream(spark, sf_dir).withWatermark("ts", "2 hours").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return _collected(spark, w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("stream_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session(spark, sf_dir):
    w = _stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return _collected(spark, w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


def _log(spark, sf_dir, folder: str, files: int = 3, most: int = 100_000) -> None:
    """The events table as message files of a replication log: a transaction per event, whole files in the order of their positions.

    There are at least so many ranges of positions as files says; a file holds at most so many transactions as most says, whatever the table's size.
    """
    relation = pgoutput.relation(pgoutput.Relation(7, "public", "accounts", "d", ((True, "id", 20), (False, "status", 25), (False, "amount", 701))))

    def said(event_id: int, user: int, status: str, value: float | None) -> bytes:
        lsn, m, key = event_id + 1, event_id % 10, str(user)
        row = [key, status, None if value is None else repr(value)]
        if m == 9:
            change = pgoutput.insert(7, row)
        elif m == 8:
            change = pgoutput.delete(7, [key, None, None])
        else:
            change = pgoutput.update(7, [*row[:2], ...] if m >= 6 else row)
        return pgoutput.to_file([(lsn, pgoutput.begin(lsn)), (lsn, relation), (lsn, change), (lsn, pgoutput.commit(lsn))])

    def put(batches):
        """A range's events, sorted, written file by file."""
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        where.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()

        def close(lsn: int, content: bytearray) -> pa.RecordBatch:
            with where.open_output_stream(f"{path}/.{lsn}.{attempt}.part", compression=None) as f:
                f.write(content)
            where.move(f"{path}/.{lsn}.{attempt}.part", f"{path}/{lsn}.log")
            return pa.RecordBatch.from_arrays([pa.array([lsn], pa.int64())], ["lsn"])

        content, held, last = bytearray(), 0, None
        for b in batches:
            for e in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                lsn = e[0] + 1
                if held >= most and lsn != last:  # a position is in one file only
                    yield close(last, content)
                    content, held = bytearray(), 0
                content += said(*e)
                held, last = held + 1, lsn
        if held:
            yield close(last, content)

    columns = ["event_id", "user_id", "event_type", "value"]
    e = read(spark, sf_dir, "events").select(*columns)
    ranges = max(files, -(-2 * e.count() // most))
    e.repartitionByRange(ranges, "event_id").sortWithinPartitions("event_id").mapInArrow(put, "lsn long").agg(F.count("*")).collect()


def _decoded(files, spark):
    """Change events of message files, in the form that cdc.fold takes."""
    e = pgoutput.events(files, pgoutput.relations_of(files)).where("op <> 'T'")
    new = F.struct(F.col("new")["status"].alias("status"), F.col("new")["amount"].cast("double").alias("amount"))
    return e.select("table", "lsn", "seq", "op", F.col("key").cast("long").alias("key"), F.col("old_key").cast("long").alias("old_key"), new.alias("new"), "unchanged")


@query("cdc_decode", "SELECT op, count(*) AS n, sum(event_id + 1)::BIGINT AS lsns, count(*) FILTER (event_id % 10 IN (6, 7)) AS partial FROM (SELECT *, CASE WHEN event_id % 10 = 9 THEN 'I' WHEN event_id % 10 = 8 THEN 'D' ELSE 'U' END AS op FROM events) t GROUP BY op")
def cdc_decode(spark, sf_dir):
    """Messages of a replication log, decoded file by file."""
    folder = _folder(spark)
    _log(spark, sf_dir, folder)
    files = spark.read.format("binaryFile").load(folder)
    return _decoded(files, spark).groupBy("op").agg(F.count("*").alias("n"), F.sum("lsn").alias("lsns"), F.count_if(F.size("unchanged") > 0).alias("partial"))


@query("cdc_stream_apply", _fold_sql("IUPD"))
def cdc_stream_apply(spark, sf_dir):
    """A replication log is followed as a stream: each batch is decoded, gated by the applied position and folded, and state and position are published together."""
    from ..sources.replication import ReplicationSource

    folder, checkpoint = _folder(spark), _folder(spark)
    _log(spark, sf_dir, folder)
    spark.dataSource.register(ReplicationSource)
    state = cdc.VersionedState(spark, _folder(spark))
    state.start(_base(spark, sf_dir), "accounts")
    files = spark.readStream.format("replication").load(folder)
    for _ in range(2):  # the second run begins at the checkpoint and finds nothing new
        cdc.apply_stream(files, state, lambda batch: _decoded(batch, spark).withColumn("table", F.lit("accounts")), "accounts", "id", ["status", "amount"], checkpoint).awaitTermination()
    return state.read().select("id", "status", F.round("amount", 6).alias("amount"))


@query("reshard_orchestrated", _hash_sql("(SELECT id AS k, status, amount FROM (" + _fold_sql("IUPD") + "))", "k", 6) + "SELECT shard, count(*) AS n FROM hashed GROUP BY shard")
def reshard_orchestrated(spark, sf_dir):
    """A table moves from 4 to 6 shards while its changes go on: copy, replay, cutover; rows per shard after it."""
    from ..plans.catalog import Catalog, ShardedTable
    from ..plans.store import Store
    from ..streaming.orchestrator import Followed, Reshard

    old, new = (Store(spark, _folder(spark), Catalog(n, [ShardedTable("accounts", "id", n)])) for n in (4, 6))
    old.create("accounts", _base(spark, sf_dir))
    changes = _changes(spark, sf_dir)
    last = changes.agg(F.max("lsn")).first()[0]
    # the copy stands for position -1: all changes come after it
    position = iter([-1, last // 2])
    move = Reshard(spark, old, new, [Followed("accounts", "id", ["status", "amount"])], lambda after: changes.where(F.col("lsn") > after), lambda: next(position, last))
    if move.run() != "lag":
        raise AssertionError("no cutover")
    return new.read("accounts").groupBy("shard").agg(F.count("*").alias("n"))


_LATE_SQL = """
WITH k AS (SELECT event_type, ts, date_trunc('hour', ts)::TIMESTAMP AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS until, event_id % 2 = 0 AS early FROM events),
m AS (SELECT max(ts) FILTER (early) - INTERVAL 1 HOUR AS first, max(ts) - INTERVAL 1 HOUR AS second FROM k)
SELECT event_type, start, count(*) AS n FROM k, m WHERE (until <= first AND early) OR (until > first AND until <= second) GROUP BY 1, 2
"""


@query("stream_late_data", _LATE_SQL)
def stream_late_data(spark, sf_dir):
    """Append mode: a window is given once, when the watermark has passed it; rows that come after that are late and are left out."""
    folder = _folder(spark)
    e = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    base = _folder(spark)
    # the first batch holds every second event; the others come later, and are late where the first batch's watermark has closed their window
    out = None
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(folder)
        s = spark.readStream.schema(e.schema).parquet(folder).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
        out = s.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
        out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("stream_join", "SELECT a.user_id, a.event_id AS click, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOURS")
def stream_join(spark, sf_dir):
    """Two streams joined on a key within two hours; watermarks bound what is kept."""
    a = _stream(spark, sf_dir).where("event_type = 'click'").select("user_id", F.col("event_id").alias("click"), F.col("ts").alias("at")).withWatermark("at", "1 hour")
    b = _stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase"), F.col("ts").alias("bought")).withWatermark("bought", "1 hour")
    j = a.join(b, F.expr("user_id = buyer AND bought >= at AND bought <= at + INTERVAL 2 HOURS"))
    return _collected(spark, j.select("user_id", "click", "purchase"))
