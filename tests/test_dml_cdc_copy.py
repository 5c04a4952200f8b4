import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselar.operators import dml
from tesselar.operators.bulk import read_binary
from tesselar.plans.catalog import RoutingError, ShardedTable, one_copy, read_sharded, with_shard, write_sharded
from tesselar.plans.planner import pruned
from tesselar.sources.copy import encode_binary, read_csv, read_text, to_text, write_csv
from tesselar.streaming import cdc
from tesselar.streaming.reshard import CutoverPolicy, copy_tables, reshard

T = ShardedTable("t", "id", 3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark):
    return with_shard(spark.createDataFrame([(i, i * 10) for i in range(8)], "id long, v long"), T)


def test_move_row_guards(spark):
    t = table(spark)
    for predicate, fk in ((None, False), ("id < 3", False), ("id = 3", True)):
        with pytest.raises(RoutingError):
            dml.move_row(t, T, predicate, 99, fk)
    got = {r.id: r.shard for r in dml.move_row(t, T, "id = 3", 99).collect()}
    assert 3 not in got and len(got) == 8
    assert got[99] == with_shard(spark.createDataFrame([(99,)], "id long"), T).first().shard
    with pytest.raises(RoutingError):
        dml.update(t, T, "id = 1", {"id": F.lit(2)})


def test_auto_id_error(spark):
    with pytest.raises(Exception, match="missing"):
        dml.auto_id(spark.createDataFrame([(None,)], "id long"), "id", "error").collect()


def test_pruned_scan_reads_one_partition(spark, tmp_path):
    write_sharded(spark.range(100).withColumn("v", F.col("id") * 2), ShardedTable("t", "id", 4), str(tmp_path / "t"))
    got = pruned(spark.read.parquet(str(tmp_path / "t")), ShardedTable("t", "id", 4), "id = 42")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and rows(got.select("id", "v")) == [(42, 84)]


def test_copy_round_trips(spark, tmp_path):
    data = [(1, 'a\tb\\n "q", ;'), (2, None), (3, ""), (4, "line\nend"), (5, "\\N"), (6, "é\r\x08\x0b\x0c")]
    df = spark.createDataFrame(data, "id long, t string")
    to_text(df).write.text(str(tmp_path / "text"))
    assert rows(read_text(spark, str(tmp_path / "text"), "id long, t string")) == rows(df)
    plain = df.where("id <> 6")
    write_csv(plain, str(tmp_path / "csv"), header=True)
    assert rows(read_csv(spark, str(tmp_path / "csv"), "id long, t string", header=True)) == rows(plain)
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a").write_bytes(encode_binary(iter(data), ["bigint", "string"]))
    assert rows(read_binary(spark, str(tmp_path / "bin"), "id long, t string")) == rows(df)


def test_fold_is_the_replay(spark):
    rng = random.Random(4)
    base = {k: {"a": k, "b": -k} for k in range(0, 12, 2)}
    events, state = [], {k: dict(v) for k, v in base.items()}
    for lsn in range(300):
        k, op = rng.randrange(14), rng.choice("IUUUPPD")
        new = {"a": rng.choice([None, lsn]), "b": lsn}
        if op == "D":
            state.pop(k, None)
        elif op == "I":
            state[k] = dict(new)
        elif k in state:
            state[k] |= new if op == "U" else {"a": new["a"]}
        events.append(("t", lsn, 0, "U" if op == "P" else op, k, None, (new["a"], new["b"]), ["b"] if op == "P" else []))
    schema = "table string, lsn long, seq int, op string, key long, old_key long, new struct<a:long,b:long>, unchanged array<string>"
    b = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], "id long, a long, b long")
    got = cdc.fold(b, spark.createDataFrame(events, schema), "id", ["a", "b"])
    assert rows(got) == sorted(((k, v["a"], v["b"]) for k, v in state.items()), key=repr)


def test_key_change_needs_the_whole_row(spark):
    schema = "table string, lsn long, seq int, op string, key long, old_key long, new struct<a:long>, unchanged array<string>"
    e = spark.createDataFrame([("t", 1, 0, "U", 2, 1, (5,), ["a"])], schema)
    with pytest.raises(Exception, match="unsent"):
        cdc.expand_key_changes(e).collect()
    with pytest.raises(RoutingError):
        cdc.check_identity("nothing", [], ["a"])


def test_rows_without_a_shard_are_read_once(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (None, 2), (7, 3), (None, 4)], "id long, v long")
    write_sharded(df, T, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 + 2 * 3
    once = read_sharded(spark, T, str(tmp_path / "t"))
    assert rows(once.select("id", "v")) == rows(df)
    more = reshard(spark.read.parquet(str(tmp_path / "t")), ShardedTable("t", "id", 5), T)
    assert more.count() == 2 + 2 * 5 and rows(one_copy(more, ShardedTable("t", "id", 5)).select("id", "v")) == rows(df)
    mapped = ShardedTable("t", "id", 2, ranges=((0, 5, 0),))
    assert rows(one_copy(with_shard(df, mapped), mapped).select("id", "v")) == rows(df)
    with pytest.raises(Exception, match="without a shard"):
        with_shard(df, T, strict=True).collect()


@given(st.lists(st.lists(st.one_of(st.none(), st.text(alphabet="a\\\t\n\r.N\b\ufdd0", max_size=6)), min_size=2, max_size=2), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None)
def test_copy_text_round_trip(spark, data):
    import tempfile

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id long, a string, b string")
    with tempfile.TemporaryDirectory() as d:
        to_text(df).coalesce(1).write.text(d + "/t")
        assert rows(read_text(spark, d + "/t", "id long, a string, b string")) == rows(df)


def test_copy_text_by_hand(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1\ta\\\\\tb\n2\ta\\\tb\tc\n3\t\\N\t\\\\N\n4\t\\x\t\\t\n\\.\n5\tno\tno\n")
    (tmp_path / "b").write_bytes(b"6\t\t\n")
    got = {r.id: (r.a, r.b) for r in read_text(spark, str(tmp_path), "id long, a string, b string").collect()}
    assert got == {1: ("a\\", "b"), 2: ("a\tb", "c"), 3: (None, "\\N"), 4: ("x", "\t"), 6: ("", "")}


def test_reshard_and_cutover(spark, tmp_path):
    n = copy_tables(spark, {"t": (table(spark), ShardedTable("t", "id", 5))}, str(tmp_path))
    assert n.agg(F.sum("rows")).first()[0] == 8
    p = CutoverPolicy(10, 100, 5)
    assert [p.ready(*x) for x in ((11, 900, 0), (1, 100, 0), (1, 900, 6), (1, 900, 5))] == ["timeout", "lag", "idle", None]
