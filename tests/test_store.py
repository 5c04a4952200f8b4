"""Stored tables, transactions, schema statements, admin views and ids."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesselar.functions.ids import job_number, unique_id, with_unique_ids
from tesselar.operators import dml, relational, scans, streams
from tesselar.plans import ddl
from tesselar.plans.admin import Engine, TableCopies, system_columns, system_tables
from tesselar.plans.catalog import Catalog, ForeignKey, RoutingError, ShardedTable
from tesselar.plans.planner import route
from tesselar.plans.store import Manifest, Store
from tesselar.sources import pgoutput
from tesselar.streaming import pubsub
from tesselar.streaming.orchestrator import check_unique, with_retry

T = ShardedTable("t", "id", 4)
C = Catalog(4, [T], {"o"}, schemas={"east": 1}, foreign_keys=[ForeignKey("child", "p", "parent", "id", "CASCADE"), ForeignKey("child", "t", "t", "id")])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), C)
    s.create("t", spark.createDataFrame([(i, i * 10) for i in range(40)] + [(None, -1)], "id long, v long"))
    return s


def content(s, name="t"):
    return rows(s.read(name).select("id", "v"))


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_writes_touch_their_shards_only(spark, store):
    base = [(i, i * 10) for i in range(40)] + [(None, -1)]
    assert content(store) == sorted(base, key=repr)
    before = store.manifest("t").folders
    got = store.update("t", "id = 3", {"v": F.lit(0)})
    after = store.manifest("t").folders
    (shard,) = T.shards_of(3)
    assert {s for s in before if before[s] != after[s]} == {str(shard)} and got.affected == 1 and got.shards == {shard}
    assert rows(got.returning.select("id", "v")) == [(3, 0)]
    assert store.delete("t", "v = -1").affected == 1  # of a row without a key
    assert store.delete("t", "id IN (5, 6)").affected == 2
    assert store.delete("t", "id = 1000").affected == 0
    want = sorted(((i, 0 if i == 3 else i * 10) for i in range(40) if i not in (5, 6)), key=repr)
    assert content(store) == want
    assert store.vacuum("t") > 0 and content(store) == want
    assert rows(store.read("t", "id = 7").select("id", "v")) == [(7, 70)]
    plan = store.read("t", "id = 7")._jdf.queryExecution().executedPlan().toString()
    assert len(store.read("t", "id = 7").inputFiles()) < len(store.read("t").inputFiles()) and "Exchange" not in plan


def test_key_update_and_upsert(spark, store):
    with pytest.raises(RoutingError):
        store.update("t", "id = 1", {"id": F.lit(2)})
    for bad in (lambda: store.move_row("t", None, 9), lambda: store.move_row("t", "id < 4", 9), lambda: store.move_row("t", "id = 1", 99, True)):
        with pytest.raises(RoutingError):
            bad()
    assert rows(store.move_row("t", "id = 1", 99).returning.select("id", "v", "shard")) == [(99, 10, next(iter(T.shards_of(99))))]
    assert store.move_row("t", "id = 1", 100).affected == 0
    new = spark.createDataFrame([(2, 7, 1), (2, 5, 2), (500, 1, 1)], "id long, v long, n int")
    assert store.upsert("t", new, "id", "n").affected == 2
    got = dict(content(store))
    assert got[99] == 10 and 1 not in got and got[2] == 5 and got[500] == 1 and len(got) == 42


def test_upsert_on_a_partial_index(spark, store):
    new = spark.createDataFrame([(2, 7, 1), (3, 8, 1), (500, 1, 1)], "id long, v long, n int")
    assert store.upsert("t", new, "id", "n", "id % 2 = 0").affected == 3
    got = content(store)
    assert [x for x in got if x[0] in (2, 3, 500)] == [(2, 7), (3, 30), (3, 8), (500, 1)] and (None, -1) in got and len(got) == 43


def test_upsert_query_adds_beside_a_taken_key(spark, tmp_path):
    """On larger tables an order has the number of the row that the query adds."""
    orders = [(100, 7, 1.5), (101, 8, 2.5), (900010, 9, 3.5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert rows(dml.dml_upsert(spark, str(tmp_path))) == [(100, 1, 0.5), (101, 8, 2.5), (900010, 1, 0.5), (900010, 9, 3.5)]


def test_foreign_keys_guard_moves(spark, tmp_path):
    c = Catalog(2, [ShardedTable("parent", "id", 2)], foreign_keys=C.foreign_keys)
    s = Store(spark, str(tmp_path / "fk"), c)
    s.create("parent", spark.range(3))
    assert c.destructive("parent") and not c.destructive("t")
    with pytest.raises(RoutingError):
        s.move_row("parent", "id = 1", 9)


def test_placing(spark, store):
    dealt = store.insert("t", spark.range(100).select(F.col("id").alias("v")).coalesce(1))
    assert dealt.affected == 100 and dealt.shards == {0, 1, 2, 3}
    assert store.read("t").where("id is null").count() == 101 and store.read("t", "id = 7").count() == 1
    store.create("o", spark.createDataFrame([(1, 2)], "id long, v long"))
    store.insert("o", spark.createDataFrame([(3, 4)], "id long, v long"))
    assert content(store, "o") == [(1, 2), (3, 4)] and set(store.manifest("o").folders) == {"0"}
    store.create("east.x", spark.range(5).withColumn("v", F.col("id")))
    assert set(store.manifest("east.x").folders) == {"1"}
    with pytest.raises(RoutingError):
        store.truncate("t", "east.x")
    store.truncate("t", "o")
    assert content(store) == content(store, "o") == []
    with pytest.raises(RoutingError):
        store.create("t", spark.range(1))
    with pytest.raises(RoutingError):
        store.read("nothing")


def test_transactions(spark, store):
    with pytest.raises(ZeroDivisionError), store:
        store.delete("t", "id < 10")
        assert len(content(store)) == 31
        raise ZeroDivisionError
    assert len(content(store)) == 41
    # a driver that is lost between the phases: what was prepared is finished by the next one
    m = store.manifest("t")
    store.prepare([("t", Manifest(m.version + 1, m.schema, {})), ("n", Manifest(1, m.schema, {}))])
    again = Store(spark, store.root, C)
    assert len(content(again)) == 41 and not again.exists("n")
    assert again.recover() == 1 and content(again) == [] and again.exists("n") and again.recover() == 0
    # of two writers of one version the second is refused
    first, second = again.manifest("t"), Store(spark, store.root, C)
    second.insert("t", spark.createDataFrame([(1, 1)], "id long, v long"))
    with pytest.raises(RoutingError):
        again._publish("t", Manifest(first.version + 1, first.schema, {}))


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    plan = relational.join_colocated(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    for q in (scans.scan_direct_shard, scans.scan_multi_shard, scans.prune_eq, scans.prune_in, scans.prune_and, scans.filter_null_safe_eq, scans.filter_param):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*shard", plan), q
    plan = scans.scan_gather_unordered(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_range_join(spark):
    r = spark.createDataFrame([(i * 10, i * 10 + 7, f"r{i}") for i in range(23)], "lo long, hi long, name string")
    got = {x.k: x.name for x in relational.range_join(spark.range(-5, 240).withColumnRenamed("id", "k"), r, "k").collect()}
    assert got == {k: f"r{k // 10}" for k in range(230) if k % 10 < 7}
    with pytest.raises(ValueError):
        relational.range_join(spark.range(1).withColumnRenamed("id", "k"), r, "k", most=5)


def test_ids(spark, tmp_path):
    jobs = [job_number(spark, str(tmp_path / "jobs")) for _ in range(3)]
    assert jobs == [1, 2, 3]
    ids = [r.id for j in jobs for r in spark.range(0, 9000, 1, 5).select(unique_id(job=j).alias("id")).collect()]
    assert len(set(ids)) == 27000 and min(ids) > 0
    sql = with_unique_ids("SELECT unique_id() AS a, UNIQUE_ID ( ) AS b, 'unique_id()' AS c /* unique_id() */ FROM range(0, 1000, 1, 3)")
    got = spark.sql(sql).collect()
    assert len({x for r in got for x in (r.a, r.b)}) == 2000 and got[0].c == "unique_id()"


def test_schema_statements(spark):
    assert ddl.route_ddl(C, "CREATE TABLE t (a INT)") is None
    assert ddl.route_ddl(C, "CREATE TABLE IF NOT EXISTS east.t (a INT)") == {1}
    assert ddl.route_ddl(C, "CREATE UNIQUE INDEX CONCURRENTLY i ON east.t (a)") == {1}
    assert ddl.route_ddl(C, "DROP VIEW east.v") == {1} and ddl.route_ddl(C, "DROP SCHEMA east") == {1}
    assert ddl.route_ddl(C, "ALTER TABLE public.t ADD COLUMN b INT") is None
    assert ddl.route_ddl(C, "TRUNCATE TABLE east.a, east.b CASCADE") == {1}
    with pytest.raises(RoutingError):
        ddl.route_ddl(C, "TRUNCATE east.a, public.b")
    assert ddl.is_ddl("VACUUM t") and not ddl.is_ddl("SELECT 1")
    dump = ["CREATE TABLE a (id INT PRIMARY KEY, x TEXT)", "CREATE TABLE b (id BIGINT PRIMARY KEY, a_id INTEGER REFERENCES a (id))", "CREATE INDEX i ON a (x)", "ALTER TABLE b ADD CONSTRAINT f FOREIGN KEY (a_id) REFERENCES a (id)", "ALTER TABLE a ADD CONSTRAINT p PRIMARY KEY (id)", "SELECT pg_catalog.setval('s', 5)", "CREATE PUBLICATION p"]
    p = ddl.phases(dump)
    assert (p.pre, p.post, p.cutover, p.after) == ([dump[0], dump[1], dump[4]], dump[2:4], [dump[5]], [dump[6]])
    assert ddl.widening(dump) == [("a", "id", "bigint"), ("b", "a_id", "bigint")]
    assert ddl.next_positions({"a": (spark.range(7), "id"), "b": (spark.range(0), "id")}) == {"a": 7, "b": 1}
    assert ddl.setting("SET shard TO 3") == ("shard", "3") and ddl.setting("select pg_catalog.set_config('app.key', 'it''s', false)") == ("app.key", "it's")
    assert ddl.setting("SET LOCAL role = 'primary';") == ("role", "primary") and ddl.setting("SELECT 1") is None


def test_ddl_reloads_the_cache(spark, tmp_path):
    c = Catalog(4, columns={"fresh": ["old"]})
    ddl.run_ddl(spark, c, f"CREATE TABLE fresh (a INT, b STRING) USING parquet LOCATION '{tmp_path / 'fresh'}'")
    assert c.columns["fresh"] == ["a", "b"]
    ddl.run_ddl(spark, c, "DROP TABLE fresh")
    assert "fresh" not in c.columns


def test_admin_views(spark, tmp_path):
    e = Engine(spark, C, settings={"shards": "4"}, slots=[("s", 100, 60)], copies=TableCopies(spark))
    e.queries.record("SELECT 1", route(spark, C, "t", "id = 1"))
    assert rows(e.show("SHOW replication slot, lag")) == [("s", 40)]
    assert rows(e.show("show query_cache")) == [("SELECT ?", 1, 1, 0)]
    for name in e._views():
        e.show(f"SHOW {name}").collect()
    for bad in ("SHOW nothing", "SHOW config nothing", "SELECT 1"):
        with pytest.raises(RoutingError):
            e.show(bad)
    assert e.copies.run("t", spark.range(100), T, str(tmp_path / "copy")) == 100
    got = e.show("SHOW table_copies table, rows, status").collect()
    assert [tuple(r) for r in got] == [("t", 100, "done")]
    text = e.open_metrics()
    assert "tesselar_queries_total 1" in text and "tesselar_replication_lag 40" in text and text.endswith("# EOF\n")
    spark.range(3).createOrReplaceTempView("seen_view")
    assert system_tables(spark).where("name = 'seen_view' and temporary").count() == 1
    assert rows(system_columns(spark).where("table_name = 'seen_view'").select("column_name", "data_type")) == [("id", "bigint")]


def test_admin_commands(spark, tmp_path):
    from tesselar.streaming.orchestrator import Followed, Reshard
    from tesselar.streaming.reshard import CutoverPolicy

    old, new = (Store(spark, str(tmp_path / str(n)), Catalog(n, [ShardedTable("acc", "id", n)])) for n in (2, 3))
    old.create("acc", spark.createDataFrame([(i, "a", 0.5) for i in range(20)], "id long, status string, amount double"))
    kind = "table string, lsn long, seq int, op string, key long, old_key long, new struct<status:string,amount:double>, unchanged array<string>"
    log = [("acc", 1, 0, "U", 3, None, ("b", 1.0), []), ("acc", 2, 0, "D", 4, None, None, []), ("acc", 3, 0, "I", 99, None, ("c", 2.0), []), ("acc", 4, 0, "U", 98, 99, ("d", 2.0), [])]
    changes = spark.createDataFrame(log, kind)
    at = {"lsn": 0}
    e = Engine(spark, C, moves={"m": Reshard(spark, old, new, [Followed("acc", "id", ["status", "amount"])], lambda after: changes.where(F.col("lsn") > after), lambda: at["lsn"], CutoverPolicy(3600, 0, 60))})
    for command in ("SCHEMA_SYNC PRE m", "COPY_DATA m", "SCHEMA_SYNC POST m"):
        e.run(command)
    at["lsn"] = 3
    assert new.read("acc").count() == 20 and rows(e.run("CUTOVER m")) == [("cutover", "")]  # changes are left
    before = new.manifest("acc").folders
    e.run("REPLICATE m")
    touched = {s for s in before if before[s] != new.manifest("acc").folders.get(s)}
    assert touched <= {str(s) for k in (3, 4, 99) for s in ShardedTable("acc", "id", 3).shards_of(k)}
    at["lsn"] = 4
    e.run("REPLICATE m")
    e.run("REPLICATE m")  # nothing twice
    assert rows(e.run("CUTOVER m")) == [("cutover", "lag")]
    got = {r.id: r.status for r in spark.table("acc").collect()}
    assert got == {**{i: "a" for i in range(20) if i not in (3, 4)}, 3: "b", 98: "d"}
    with pytest.raises(RoutingError):
        e.run("SCHEMA_SYNC PRE m")  # the target holds rows
    assert [t[2] for t in e.tasks].count("failed") == 1 and e.show("SHOW schema_sync").count() > 3
    e.run("SET role = 'primary'")
    assert e.settings["role"] == "primary" and rows(e.run("RESET QUERY_CACHE"))
    with pytest.raises(RoutingError):
        e.run("RESHARD nothing")


def test_messages():
    r = pgoutput.Relation(5, "public", "t", "f", ((True, "id", 20), (False, "x", 25)))
    assert pgoutput.decode(pgoutput.relation(r)) == {"kind": "relation", "relation": r}
    assert pgoutput.decode(pgoutput.begin(7, 3, 9)) == {"kind": "begin", "lsn": 7, "micros": 9, "xid": 3}
    assert pgoutput.decode(pgoutput.commit(7))["end"] == 8
    assert pgoutput.decode(pgoutput.insert(5, ["1", None])) == {"kind": "insert", "oid": 5, "old": None, "which": None, "new": ["1", None]}
    assert pgoutput.decode(pgoutput.update(5, ["2", ...], ["1", "é"], "O")) == {"kind": "update", "oid": 5, "old": ["1", "é"], "which": "O", "new": ["2", ...]}
    assert pgoutput.decode(pgoutput.delete(5, ["1", None]))["old"] == ["1", None]
    assert pgoutput.decode(pgoutput.truncate([5, 6]))["oids"] == [5, 6]
    assert pgoutput.decode(b"S" + bytes([0, 0, 0, 4, 1])) == {"kind": "stream_start", "xid": 4, "first": True}
    messages = [(1, pgoutput.begin(9)), (2, pgoutput.insert(5, ["1", "a"]))]
    assert list(pgoutput.from_file(pgoutput.to_file(messages))) == messages


def test_events_of_messages(spark):
    r = pgoutput.Relation(5, "public", "t", "d", ((True, "id", 20), (False, "x", 25)))
    wide = pgoutput.Relation(5, "public", "t", "d", ((True, "id", 20), (False, "x", 25), (False, "y", 25)))
    one = pgoutput.to_file([(1, pgoutput.begin(10)), (1, pgoutput.relation(r)), (2, pgoutput.insert(5, ["1", "a"])), (3, pgoutput.update(5, ["2", ...], ["1", None])), (10, pgoutput.commit(10))])
    two = pgoutput.to_file([(11, pgoutput.begin(20)), (12, pgoutput.relation(wide)), (13, pgoutput.delete(5, ["2", None, None])), (14, pgoutput.truncate([5])), (20, pgoutput.commit(20))])
    files = spark.createDataFrame([(one,), (two,)], "content binary")
    got = rows(pgoutput.events(files, pgoutput.relations_of(files)).select("table", "lsn", "seq", "op", "key", "old_key", F.map_entries("new").cast("string"), "unchanged"))
    assert got == [
        ("public.t", 10, 0, "I", "1", None, "[{id, 1}, {x, a}]", []),
        ("public.t", 10, 1, "U", "2", "1", "[{id, 2}]", ["x"]),
        ("public.t", 20, 0, "D", "2", None, "[]", []),
        ("public.t", 20, 1, "T", None, None, "[]", []),
    ]


def test_message_files_are_bounded_and_whole(spark, tmp_path):
    """A file holds so many transactions at most, however dense their positions are; a position is in one file."""
    ids = [*range(40), *range(1000, 1003), 1003, 1003, 10**9]
    kinds = ["click", "view"]
    events = [(i, i % 7, kinds[n % 2], None if n == 5 else float("nan") if n == 6 else n / 3) for n, i in enumerate(ids)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    folder = str(tmp_path / "log")
    streams._log(spark, str(tmp_path), folder, most=4)
    names = [n for n in os.listdir(folder) if not n.endswith(".crc")]
    assert all(re.fullmatch(r"\d+\.log", n) for n in names)
    held = []
    for last, name in sorted((int(n[:-4]), n) for n in names):
        with open(f"{folder}/{name}", "rb") as f:
            begun = [lsn for lsn, m in pgoutput.from_file(f.read()) if m[:1] == b"B"]
        assert begun == sorted(begun) and begun[-1] == last and len(begun) <= 5 and len(set(begun)) <= 4
        held += begun
    assert held == [i + 1 for i in ids]
    got = streams._decoded(spark.read.format("binaryFile").load(folder), spark)
    have = [(r.lsn, r.op, r.key, *(r.new or (None, None)), r.unchanged) for r in got.orderBy("lsn").collect()]
    op = {9: "I", 8: "D"}
    want = [(i + 1, op.get(i % 10, "U"), k, *((None, None) if i % 10 == 8 else (t, None if i % 10 in (6, 7) else v)), ["amount"] if i % 10 in (6, 7) else []) for i, k, t, v in events]
    assert sorted(map(repr, have)) == sorted(map(repr, want))


def test_decoded_batches_are_bounded():
    """A file of many events is decoded in batches, none of which grows with it."""
    r = pgoutput.Relation(5, "public", "t", "d", ((True, "id", 20), (False, "x", 25)))
    said = [(1, pgoutput.begin(10)), (1, pgoutput.relation(r))] + [(2, pgoutput.insert(5, [str(i), "a" * 30])) for i in range(25_000)] + [(10, pgoutput.commit(10))]
    large = [(1, pgoutput.begin(20))] + [(2, pgoutput.insert(5, [str(i), "b" * (3 << 20)])) for i in range(4)] + [(20, pgoutput.commit(20))]
    run = []

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            run.append(f)

    pgoutput.events(Files(), [(1, r)])
    contents = pa.RecordBatch.from_arrays([pa.array([pgoutput.to_file(said), b"", pgoutput.to_file(large)], pa.binary())], ["content"])
    batches = list(run[0](iter([contents])))
    assert sum(b.num_rows for b in batches) == 25_004 and max(b.num_rows for b in batches) == 10_000
    assert max(b.nbytes for b in batches) < 8 << 20


def test_followed_files_come_in_pieces(spark, tmp_path):
    """A large message file is read in batches of whole transactions, not as one."""
    from tesselar.sources import replication

    r = pgoutput.relation(pgoutput.Relation(5, "public", "t", "d", ((True, "id", 20), (False, "x", 25))))
    said = lambda lsn, n, x: pgoutput.to_file([(lsn, pgoutput.begin(lsn)), (lsn, r)] + [(lsn, pgoutput.insert(5, [str(i), x])) for i in range(n)] + [(lsn, pgoutput.commit(lsn))])
    whole = b"".join(said(lsn, 3, "C" * 50_000) for lsn in range(1, 101)) + said(101, 200, "b" * 50_000) + said(102, 1, "")
    (tmp_path / "102.log").write_bytes(whole)
    reader = replication._Reader(str(tmp_path), 0)
    (one,) = reader.partitions({"lsn": 0}, {"lsn": 102})
    got = list(reader.read(one))
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows == 1 for b in got)
    contents = [b.column("content")[0].as_py() for b in got]
    assert b"".join(contents) == whole and {b.column("lsn")[0].as_py() for b in got} == {102}
    kinds = [[m[:1] for _, m in pgoutput.from_file(c)] for c in contents]
    assert all(k[0] == b"B" and k[-1] == b"C" for k in kinds)
    assert len(got) > 4 and max(map(len, contents)) < len(said(101, 200, "b" * 50_000)) + (8 << 20)
    spark.dataSource.register(replication.ReplicationSource)
    out = []
    files = spark.readStream.format("replication").load(str(tmp_path))
    put = lambda batch, _: out.append(pgoutput.events(batch, pgoutput.relations_of(batch)).groupBy("lsn").agg(F.count("*"), F.max("seq")).collect())
    files.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(x) for b in out for x in b) == [*((lsn, 3, 2) for lsn in range(1, 101)), (101, 200, 199), (102, 1, 0)]


def test_sketch_is_not_kept_by_key(spark, tmp_path):
    for name, keys, want in (("some", [*range(5000), *range(3000), None], True), ("none", [None], False)):
        spark.createDataFrame([(k,) for k in keys], "l_orderkey long").write.parquet(str(tmp_path / name / "lineitem.parquet"))
        got = relational.agg_approx_distinct(spark, str(tmp_path / name))
        assert got.columns == ["close"] and rows(got) == [(want,)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    sketches = [x for x in plan.splitlines() if "approx_count_distinct" in x and "Aggregate" in x]
    assert sketches and all("keys=[]" in x for x in sketches)


def test_retry_and_unique(spark):
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 4:
            raise OSError
        return "done"

    assert with_retry(fails, sleep=waits.append) == "done" and waits == [1, 2, 4]
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=8, sleep=waits.append)
    assert waits[-1] == 32
    with pytest.raises(RoutingError):
        check_unique(spark.createDataFrame([(1,), (1,)], "id long"), ["id"])


def test_sharded_sequence(spark, tmp_path):
    from tesselar.functions.partition import shard_of
    from tesselar.plans import install

    spark.range(1).createOrReplaceTempView("seq_table")
    c = Catalog(4)
    seq = install.install_sharded_sequence(spark, c, "seq_table", "id", str(tmp_path), block=50)
    assert c.sharded("seq_table").column == "id"
    first, second = ([r.id for r in seq.ids(2).collect()] for _ in range(2))
    assert first and second and max(first) <= 50 < min(second) and all(shard_of(i, "bigint", 4) == 2 for i in first + second)
    for bad in (("nothing", "id"), ("seq_table", "nothing")):
        with pytest.raises(RoutingError):
            install.install_sharded_sequence(spark, c, *bad, str(tmp_path))
    assert install.forced_shards("SELECT install_sharded_sequence('a', 'b')") is None and install.forced_shards("SELECT 1") is False


def test_notify(spark):
    m = spark.createDataFrame([("a", "x", 1, True), ("a", "y", 2, False), ("b", "z", 1, True)], "channel string, payload string, transaction long, committed boolean")
    to = spark.createDataFrame([("l1", "a"), ("l2", "a"), ("l2", "b")], "listener string, channel string")
    assert rows(pubsub.notify(m, to)) == [("l1", "a", "x"), ("l2", "a", "x"), ("l2", "b", "z")]
