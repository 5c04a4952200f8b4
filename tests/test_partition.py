"""Golden values of the partition functions, and agreement of the column and plan-time forms."""

import uuid

from pyspark.sql import functions as F

from tesselar.functions import partition as P
from tesselar.functions.ids import unique_id
from tesselar.plans.catalog import ShardedTable, with_shard


def test_golden_hash():
    assert P.shard_of("test_value", "varchar", 2) == 1
    assert [P.shard_of(v, "bigint", 3) for v in (1, 2, 3, 4, 5, 10, 12, -1, 1234)] == [2, 0, 1, 0, 2, 1, 2, 2, 0]
    assert [P.shard_of(v, "bigint", 2) for v in (4, 5, 10, 12, -1, 1234)] == [1, 1, 1, 0, 1, 0]


def test_golden_sha1():
    assert [P.shard_of(i, "bigint", 12, "sha1") for i in range(20)] == [4, 7, 8, 3, 6, 0, 0, 10, 3, 11, 1, 7, 4, 4, 11, 2, 5, 0, 8, 3]


def test_columns_agree_with_plan_time(spark):
    keys = [0, 1, -1, 7, 2**31, -(2**31), 2**62, -(2**63), 2**63 - 1]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", P.hash_bigint(F.col("k"), 7).alias("s"), P.sha1_shard(F.col("k"), 7).alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [(P.shard_of(k, "bigint", 7), P.shard_of(k, "bigint", 7, "sha1")) for k in keys]
    texts = ["", "a", "abc", "é" * 5, "x" * 11, "y" * 12, "z" * 13, "long " * 20, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(P.hash_varchar(F.col("t"), 5).alias("s")).collect()
    assert [r.s for r in got] == [None if t is None else P.shard_of(t, "varchar", 5) for t in texts]
    ids = [str(uuid.UUID(int=i * 10**30)) for i in range(5)]
    got = spark.createDataFrame([(t,) for t in ids], "t string").select(P.hash_uuid(F.col("t"), 5).alias("s")).collect()
    assert [r.s for r in got] == [P.shard_of(t, "uuid", 5) for t in ids]


def test_mapping_order(spark):
    got = spark.createDataFrame([(k,) for k in (1, 2, 150, 999, None)], "k long").select(P.mapping_shard(F.col("k"), [((1, 2), 0), ((2,), 1)], [(100, 200, 1), (None, 500, 0)]).alias("s")).collect()
    assert [r.s for r in got] == [0, 1, 1, None, None]


def test_rows_without_shard_are_everywhere(spark):
    t = ShardedTable("t", "k", 3)
    got = with_shard(spark.createDataFrame([(1,), (None,)], "k long"), t).collect()
    assert sorted((r.k is None, r.shard) for r in got) == [(False, 2), (True, 0), (True, 1), (True, 2)]


def test_shards_hold_all_rows_once(spark):
    df = spark.range(1000)
    for n in (1, 2, 3, 4, 12):
        parts = with_shard(df, ShardedTable("t", "id", n))
        assert parts.count() == 1000 and parts.agg(F.min("shard"), F.max("shard")).first() == (0, n - 1)


def test_unique_ids(spark):
    got = [r.id for r in spark.range(0, 20000, 1, 7).select(unique_id().alias("id")).collect()]
    assert len(set(got)) == 20000 and min(got) > 0 and max(got) < 2**63
