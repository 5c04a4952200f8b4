"""Queries of the partition functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import partition as P
from ..functions.ids import unique_id
from ..plans.catalog import ShardedTable, with_shard
from ..plans.planner import Route, Shards, Source, comment_hints, set_hints
from ..session import read
from .registry import query
from .scans import CATALOG, CUSTOMER, centroids_of


def _hash_sql(source: str, key: str, shards: int) -> str:
    """DuckDB SQL: the seeded hash as chained CTEs over BIGINT; the last one is `hashed` with columns k and shard."""
    s = P._seeded(4)
    m = P._M
    sql = f"WITH s0 AS (SELECT {key} AS k, (({key} & {m}) # 0) AS lo, (({key} >> 32) & {m}) AS hi FROM {source}),\n".replace("# 0", "| 0")
    sql += f"s1 AS (SELECT k, ((xor(lo, CASE WHEN k >= 0 THEN hi ELSE xor(hi, {m}) END)) + {s['a']}) & {m} AS a, {s['b']}::BIGINT AS b, {s['c']}::BIGINT AS c FROM s0),\n"
    for i, (t, other, k) in enumerate(P.FINAL, 2):
        turned = f"((({other} << {k}) | ({other} >> {32 - k})) & {m})"
        cols = ", ".join(f"((xor({t}, {other})) - {turned}) & {m} AS {t}" if n == t else n for n in "abc")
        sql += f"s{i} AS (SELECT k, {cols} FROM s{i - 1}),\n"
    return sql + f"hashed AS (SELECT k, ((((b::HUGEINT << 32) + c + {P.COMBINE}::HUGEINT) % 18446744073709551616::HUGEINT) % {shards})::INTEGER AS shard FROM s8)\n"


def _hash_bytes_sql(source: str, keep: str, hexed: str, length: int, shards: int) -> str:
    """DuckDB SQL: the seeded hash of `length` bytes, given in hexadecimal; the last CTE is `hashed` with columns `keep` and shard."""
    m, state = P._M, P._seeded(length)

    def word(at: int, size: int) -> str:
        """Little-endian number of `size` bytes."""
        digits = " || ".join(f"substr(x, {2 * (at + j) + 1}, 2)" for j in reversed(range(size)))
        return f"('0x' || {digits})::BIGINT" if size > 0 else "0"

    ctes = [f"s0 AS (SELECT {keep}, {hexed} AS x, {state['a']}::BIGINT AS a, {state['b']}::BIGINT AS b, {state['c']}::BIGINT AS c FROM {source})"]

    def step(**new: str) -> None:
        ctes.append(f"s{len(ctes)} AS (SELECT {keep}, x, {', '.join(f'{new.get(n, n)} AS {n}' for n in 'abc')} FROM s{len(ctes) - 1})")

    turned = lambda v, k: f"((({v} << {k}) | ({v} >> {32 - k})) & {m})"
    at = 0
    while length - at >= 12:
        step(**{n: f"({n} + {word(at + 4 * j, 4)}) & {m}" for j, n in enumerate("abc")})
        for t, minus, k, plus in P.MIX:
            step(**{t: f"xor(({t} - {minus}) & {m}, {turned(minus, k)})", minus: f"({minus} + {plus}) & {m}"})
        at += 12
    left = length - at
    step(a=f"(a + {word(at, min(left, 4))}) & {m}", b=f"(b + {word(at + 4, min(max(left - 4, 0), 4))}) & {m}", c=f"(c + (({word(at + 8, max(left - 8, 0))}) << 8)) & {m}")
    for t, other, k in P.FINAL:
        step(**{t: f"(xor({t}, {other}) - {turned(other, k)}) & {m}"})
    ctes.append(f"hashed AS (SELECT {keep}, ((((b::HUGEINT << 32) + c + {P.COMBINE}::HUGEINT) % 18446744073709551616::HUGEINT) % {shards})::INTEGER AS shard FROM s{len(ctes) - 1})")
    return "WITH " + ",\n".join(ctes) + "\n"


_UUID_SQL = "(SELECT c_custkey, u, substr(u, 1, 8) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) || '-' || substr(u, 17, 4) || '-' || substr(u, 21, 12) AS id_uuid FROM (SELECT c_custkey, md5(c_custkey::VARCHAR) AS u FROM customer))"


@query("shard_hash_bigint", _hash_sql("orders", "o_orderkey", 12) + "SELECT k AS o_orderkey, shard FROM hashed")
def shard_hash_bigint(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", P.hash_bigint(F.col("o_orderkey"), 12).alias("shard"))


@query("shard_hash_uuid", _hash_bytes_sql(_UUID_SQL, "c_custkey, id_uuid", "u", 16, 12) + "SELECT * FROM hashed")
def shard_hash_uuid(spark, sf_dir):
    u = F.md5(F.col("c_custkey").cast("string"))
    dashed = F.concat_ws("-", u.substr(1, 8), u.substr(9, 4), u.substr(13, 4), u.substr(17, 4), u.substr(21, 12))
    return read(spark, sf_dir, "customer").select("c_custkey", dashed.alias("id_uuid")).withColumn("shard", P.hash_uuid(F.col("id_uuid"), 12))


# names have 18 bytes, 'Customer#' and nine digits; any that had not would differ
@query("shard_hash_varchar", _hash_bytes_sql("customer", "c_custkey, c_name", "hex(encode(c_name))", 18, 12) + "SELECT * FROM hashed")
def shard_hash_varchar(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", P.hash_varchar(F.col("c_name"), 12).alias("shard"))


@query("shard_sha1", "SELECT o_orderkey, (('0x' || right(sha1(o_orderkey::VARCHAR), 8))::UBIGINT % 12)::INTEGER AS shard FROM orders")
def shard_sha1(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", P.sha1_shard(F.col("o_orderkey"), 12).alias("shard"))


@query("shard_list", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') THEN 1 END AS shard FROM customer")
def shard_list(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", P.mapping_shard(F.col("c_mktsegment"), [(("BUILDING", "MACHINERY"), 0), (("AUTOMOBILE", "FURNITURE"), 1)]).alias("shard"))


@query("shard_range", "SELECT o_orderkey, CASE WHEN o_orderkey < 100 THEN 0 WHEN o_orderkey < 1000 THEN 1 WHEN o_orderkey >= 1000 THEN 2 END AS shard FROM orders")
def shard_range(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", P.mapping_shard(F.col("o_orderkey"), (), [(None, 100, 0), (100, 1000, 1), (1000, None, 2)]).alias("shard"))


@query("shard_mapping_hierarchy", "SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2, 3) THEN 0 WHEN o_orderkey IN (4, 5, 6) THEN 1 WHEN o_orderkey >= 100 AND o_orderkey < 200 THEN 0 WHEN o_orderkey >= 200 AND o_orderkey < 300 THEN 1 ELSE 0 END AS shard FROM orders")
def shard_mapping_hierarchy(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", P.mapping_shard(F.col("o_orderkey"), [((1, 2, 3), 0), ((4, 5, 6), 1)], [(100, 200, 0), (200, 300, 1)], 0).alias("shard"))


_CENTROID_SQL = """
WITH c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) AS i, embedding AS e FROM embeddings ORDER BY vec_id LIMIT 8),
d AS (SELECT v.vec_id, c.i, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], c.e::DOUBLE[]), c.i) AS r FROM embeddings v, c)
"""


@query("shard_centroid", _CENTROID_SQL + "SELECT vec_id, string_agg(DISTINCT (i % 4)::VARCHAR, ',' ORDER BY (i % 4)::VARCHAR) AS shards FROM d WHERE r <= 3 GROUP BY vec_id")
def shard_centroid(spark, sf_dir):
    c = centroids_of(spark, sf_dir)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(P.centroid_shards(F.col("embedding"), c, 4), ",").alias("shards"))


@query("join_centroid", _CENTROID_SQL + "SELECT i::INTEGER AS centroid, count(*) AS n FROM d WHERE r = 1 GROUP BY i")
def join_centroid(spark, sf_dir):
    """Nearest centroid of each vector, and how many vectors each has."""
    from ..functions.vector import l2

    c = centroids_of(spark, sf_dir)
    far = F.array(*(F.struct(l2(F.col("embedding"), F.array(*(F.lit(float(x)) for x in v))).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(c)))
    return read(spark, sf_dir, "embeddings").select(F.array_min(far)["i"].alias("centroid")).groupBy("centroid").agg(F.count("*").alias("n"))


@query("shard_schema", "SELECT r_regionkey, CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 ELSE 2 END AS shard FROM region")
def shard_schema(spark, sf_dir):
    return read(spark, sf_dir, "region").select("r_regionkey", P.schema_shard(F.col("r_name"), {"ASIA": 0, "EUROPE": 1}, 2).alias("shard"))


_LOOKUP = "(SELECT c_custkey, n_regionkey::BIGINT AS region FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query("shard_lookup_value", _hash_sql(_LOOKUP, "region", 3).replace("SELECT region AS k,", "SELECT region AS k,") + ", per AS (SELECT DISTINCT k, shard FROM hashed) SELECT c_custkey, shard FROM " + _LOOKUP + " t JOIN per ON per.k = t.region")
def shard_lookup_value(spark, sf_dir):
    """A customer's shard is the hash of the region that a lookup table gives for its nation; a missing nation raises."""
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # a replicated dimension of a few rows
    j = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    known = F.when(F.col("n_regionkey").isNull(), F.raise_error(F.lit("lookup has no row"))).otherwise(F.col("n_regionkey"))
    return j.select("c_custkey", P.hash_bigint(known.cast("long"), 3).alias("shard"))


@query("shard_lookup_shard", "SELECT c_custkey, (n_regionkey % 5)::INTEGER AS shard FROM customer JOIN nation ON c_nationkey = n_nationkey")
def shard_lookup_shard(spark, sf_dir):
    """The looked-up value is the shard itself; it must be one of the shards."""
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("int").alias("s")))
    j = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.select("c_custkey", F.when(F.col("s").between(0, 4), F.col("s")).otherwise(F.raise_error(F.lit("lookup gives no shard"))).cast("int").alias("shard"))


@query("shard_null_key", "SELECT s AS shard, count(*) AS n FROM customer, (SELECT unnest(range(4))::INTEGER AS s) GROUP BY s")
def shard_null_key(spark, sf_dir):
    """Rows without a key are on every shard."""
    c = read(spark, sf_dir, "customer").withColumn("c_custkey", F.lit(None).cast("long"))
    return with_shard(c, CUSTOMER).groupBy("shard").agg(F.count("*").alias("n"))


@query("unique_id", "SELECT count(*) AS n, count(*) AS distinct_ids, TRUE AS positive FROM orders")
def unique_ids(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(unique_id().alias("id"))
    return o.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), (F.min("id") > 0).alias("positive"))


@query("next_id_for_shard", _hash_sql("(SELECT unnest(range(1, 1001)) AS id)", "id", 4) + "SELECT k AS id FROM hashed WHERE shard = 2")
def next_id_for_shard(spark, sf_dir):
    """Ids that hash to their own shard: the sequence is drawn and filtered."""
    return spark.range(1, 1001).where(P.hash_bigint(F.col("id"), 4) == 2)


def _winners() -> str:
    """The rule in other words: the larger source wins; of equal ones the larger shard, as 2 is beside 1."""
    return ", ".join(f"('{a.name}', '{b.name}', '{max(a, b).name}', {2 if b >= a else 1})" for a in Source for b in Source)


@query("route_priority", f"SELECT * FROM (VALUES {_winners()}) t(first, second, winner, shard)")
def route_priority(spark, sf_dir):
    """The winning source of each pair of sources, a comment against a session setting among them."""
    rows = []
    for a in Source:
        for b in Source:
            r = Route()
            r.offer(Shards({1}), a, a.name)
            r.offer(Shards({2}), b, b.name)
            rows.append((a.name, b.name, r.source.name, min(r.shards) if r.shards else None))
    return spark.createDataFrame(rows, "first string, second string, winner string, shard int")


_HINTS = ("/* tesselar_shard: 3 */ SELECT 1", "SELECT 1 -- tesselar_sharding_key: 7", '/* tesselar_sharding_key: "12" tesselar_role: primary */ SELECT 1', "/* max_shard: 2 */ SELECT 1", "SELECT 1")


@query("hint_comment", _hash_sql("(SELECT unnest([7, 12]::BIGINT[]) AS n)", "n", 4) + f", v(\"sql\", key, given, read) AS (VALUES ('{_HINTS[0]}', NULL, 3, true), ('{_HINTS[1]}', 7, NULL, true), ('{_HINTS[2]}', 12, NULL, false), ('{_HINTS[3]}', NULL, NULL, true), ('{_HINTS[4]}', NULL, NULL, true)) SELECT \"sql\", coalesce(given, shard)::INTEGER AS shard, read FROM v LEFT JOIN hashed ON v.key = hashed.k")
def hint_comment(spark, sf_dir):
    rows = []
    for sql in _HINTS:
        r = Route()
        comment_hints(CATALOG, sql, r)
        rows.append((sql, None if r.shards is None else min(r.shards), r.read))
    return spark.createDataFrame(rows, "sql string, shard int, read boolean")


@query("hint_set", _hash_sql("(SELECT 5::BIGINT AS n)", "n", 4) + "SELECT * FROM (VALUES ('{''shard'': ''1''}', 1, true), ('{''role'': ''primary''}', NULL, false), ('{}', NULL, true)) t(settings, shard, read) UNION ALL SELECT '{''sharding_key'': ''5''}', shard, true FROM hashed")
def hint_set(spark, sf_dir):
    rows = []
    for settings in ({"shard": "1"}, {"sharding_key": "5"}, {"role": "primary"}, {}):
        r = Route()
        set_hints(CATALOG, settings, r)
        rows.append((str(settings), None if r.shards is None else min(r.shards), r.read))
    return spark.createDataFrame(rows, "settings string, shard int, read boolean")


@query("reshard_counts", _hash_sql("orders", "o_orderkey", 6) + "SELECT shard, count(*) AS n FROM hashed GROUP BY shard")
def reshard_counts(spark, sf_dir):
    """Rows per shard after a move from 4 to 6 shards."""
    from ..streaming.reshard import reshard

    o = with_shard(read(spark, sf_dir, "orders"), ShardedTable("orders", "o_orderkey", 4))
    return reshard(o, ShardedTable("orders", "o_orderkey", 6)).groupBy("shard").agg(F.count("*").alias("n"))


@query("reshard_omni", "SELECT n_nationkey, n_name FROM nation")
def reshard_omni(spark, sf_dir):
    """Each destination gets every row once, from the source that owns it."""
    from ..streaming.reshard import reshard_omni

    copies = read(spark, sf_dir, "nation").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return reshard_omni(copies, 4, 6).where("shard = 5").select("n_nationkey", "n_name")
