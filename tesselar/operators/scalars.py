"""Scalar function families, text forms of types, and user-defined functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..session import read, views
from ..types import array_to_text, binary_to_timestamp, interval_key, parse_interval, parse_timestamp, text_to_array, timestamp_to_binary
from .registry import query, sql_query

sql_query(
    "fn_string", "customer",
    "SELECT c_custkey, lower(trim(c_name)) AS a, concat_ws('', c_name, NULL, '!') AS b, substr(c_name, 3, 4) AS c, lpad(CAST(c_custkey AS STRING), 8, '0') AS d, repeat('ab', 2) AS e, md5(c_name) AS f, length(c_name) AS g, replace(c_name, 'C', 'k') AS h, split_part(c_name, '#', 2) AS i, format_string('%s-%d', c_mktsegment, c_nationkey) AS j FROM customer",
    "SELECT c_custkey, lower(trim(c_name)) AS a, concat(c_name, NULL, '!') AS b, substr(c_name, 3, 4) AS c, lpad(c_custkey::VARCHAR, 8, '0') AS d, repeat('ab', 2) AS e, md5(c_name) AS f, length(c_name) AS g, replace(c_name, 'C', 'k') AS h, split_part(c_name, '#', 2) AS i, c_mktsegment || '-' || c_nationkey AS j FROM customer",
)
sql_query(
    "fn_date", "orders",
    "SELECT o_orderkey, date_trunc('month', o_orderdate) AS a, year(o_orderdate) * 100 + month(o_orderdate) AS b, dayofyear(o_orderdate) AS c, date_add(CAST(o_orderdate AS DATE), 30) AS d, o_orderdate + INTERVAL 2 HOURS AS e FROM orders",
    "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS a, year(o_orderdate) * 100 + month(o_orderdate) AS b, dayofyear(o_orderdate) AS c, (o_orderdate::DATE + 30)::DATE AS d, o_orderdate + INTERVAL 2 HOURS AS e FROM orders",
)
sql_query("fn_math", "orders", "SELECT o_orderkey, round(o_totalprice, 1) AS a, floor(o_totalprice) AS b, ceil(o_totalprice) AS c, round(sqrt(o_totalprice), 6) AS d, round(ln(o_totalprice + 1), 6) AS e, o_orderkey % 7 AS f, least(o_orderkey, 50) AS g, greatest(o_orderkey, 50) AS h, abs(50 - o_orderkey) AS i FROM orders")
sql_query(
    "fn_array", "embeddings",
    "SELECT vec_id, size(embedding) AS n, round(element_at(embedding, 1), 5) AS first, size(slice(embedding, 2, 3)) AS s, array_contains(array(1, 2, 3), label) AS has, array_join(transform(sequence(1, 3), x -> x * label), ',') AS t FROM embeddings",
    "SELECT vec_id, len(embedding) AS n, round(embedding[1], 5) AS first, len(embedding[2:4]) AS s, list_contains([1, 2, 3], label) AS has, array_to_string(list_transform(range(1, 4), lambda x: x * label), ',') AS t FROM embeddings",
)
sql_query(
    "fn_map", "nation",
    "SELECT n_nationkey, element_at(map('r', n_regionkey, 'n', n_nationkey), 'r') AS r, array_join(array_sort(map_keys(map('r', n_regionkey, 'n', n_nationkey))), ',') AS k FROM nation",
    "SELECT n_nationkey, MAP {'r': n_regionkey, 'n': n_nationkey}['r'] AS r, 'n,r' AS k FROM nation",
)
sql_query("fn_json", "events", "SELECT event_id, get_json_object(concat('{\"a\":{\"b\":', CAST(user_id AS STRING), '},\"t\":\"', event_type, '\"}'), '$.a.b') AS b, length(props) AS n FROM events", "SELECT event_id, json_extract_string('{\"a\":{\"b\":' || user_id || '},\"t\":\"' || event_type || '\"}', '$.a.b') AS b, length(props) AS n FROM events")
sql_query("fn_conditional", "orders", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS b FROM orders")


sql_query(
    "fn_codes", "nation",
    "SELECT n_nationkey, chr(65 + CAST(n_nationkey AS INT)) AS a, decode(unhex(hex(n_name)), 'UTF-8') AS b, to_json(named_struct('k', CAST(n_nationkey AS BIGINT), 'n', n_name)) AS c, lower(hex(encode(n_name, 'UTF-8'))) AS d, ascii(n_name) AS e FROM nation",
    "SELECT n_nationkey, chr((65 + n_nationkey)::INTEGER) AS a, n_name AS b, '{\"k\":' || n_nationkey || ',\"n\":' || to_json(n_name)::VARCHAR || '}' AS c, lower(hex(encode(n_name))) AS d, ascii(n_name) AS e FROM nation",
)
sql_query("fn_volatile", "nation", "SELECT n_nationkey, rand() >= 0 AND rand() < 1 AS r, length(uuid()) AS u, now() > TIMESTAMP'2020-01-01 00:00:00' AS t FROM nation", "SELECT n_nationkey, random() >= 0 AND random() < 1 AS r, length(uuid()::VARCHAR)::INTEGER AS u, now() > TIMESTAMP '2020-01-01' AS t FROM nation")


@query("fn_json_set", "SELECT n_nationkey, '{\"a\":' || n_regionkey || ',\"name\":' || to_json(n_name)::VARCHAR || '}' AS j FROM nation")
def fn_json_set(spark, sf_dir):
    """A field of a JSON object is set or added."""
    n = read(spark, sf_dir, "nation").withColumn("j", F.to_json(F.struct(F.lit(0).alias("a"), F.col("n_name").alias("name"))))
    return n.select("n_nationkey", json_set(F.col("j"), "a", F.col("n_regionkey").cast("string")).alias("j"))


def json_set(json, key: str, value):
    """A JSON object with a top-level field set to a JSON value; fields come sorted by name."""
    fields = F.from_json(json, "map<string,variant>")
    new = F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(value)))
    return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(new)), lambda k: F.struct(k, F.element_at(new, k)))))


@query("agg_array_agg_nulls", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS nulls FROM orders GROUP BY o_orderstatus")
def agg_array_agg_nulls(spark, sf_dir):
    """array_agg that keeps nulls."""
    o = read(spark, sf_dir, "orders").withColumn("k", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")))
    return o.groupBy("o_orderstatus").agg(array_agg(F.col("k")).alias("a")).select("o_orderstatus", F.size("a").cast("long").alias("n"), F.size(F.filter("a", lambda x: x.isNull())).cast("long").alias("nulls"))


def array_agg(value):
    """All values of a group, nulls too; a group's array must fit a row."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])


@query("execute_immediate", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < 50 GROUP BY o_orderstatus")
def execute_immediate(spark, sf_dir):
    views(spark, sf_dir, "orders")
    return spark.sql("EXECUTE IMMEDIATE 'SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < ? GROUP BY o_orderstatus' USING 50")


@query("fn_generate_series", "SELECT o_orderkey, unnest(range(o_orderkey, o_orderkey + 3)) AS v FROM orders")
def fn_generate_series(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence("o_orderkey", F.col("o_orderkey") + 2)).alias("v"))


@query("array_text_roundtrip", "SELECT n_nationkey, '{' || CASE WHEN regexp_matches(n_name, '^[^\\s{}\",]+$') THEN n_name ELSE '\"' || n_name || '\"' END || ',\"a,\\\"b\\\\c {d}\",NULL,\"null\",\"\",\" x \"}' AS literal, 2 AS n, n_name AS first FROM nation")
def array_text_roundtrip(spark, sf_dir):
    """Elements with commas, quotes, backslashes, braces, white space, NULL and the word null survive."""
    odd = F.array(F.col("n_name"), F.lit('a,"b\\c {d}'), F.lit(None).cast("string"), F.lit("null"), F.lit(""), F.lit(" x "))
    n = read(spark, sf_dir, "nation").select("n_nationkey", odd.alias("a")).withColumn("literal", array_to_text(F.col("a"))).withColumn("back", text_to_array(F.col("literal")))
    n = n.withColumn("first", F.when(F.col("a").eqNullSafe(F.col("back")), F.element_at("back", 1)))
    return n.select("n_nationkey", "literal", F.size(F.filter("back", lambda x: F.lower(x).isin("null", ""))).alias("n"), "first")


@query("array_text_multidim", "SELECT n_nationkey, '{{' || n_nationkey || ',2},{NULL,' || n_regionkey || '}}' AS literal, n_regionkey::INTEGER AS last, 2 AS n FROM nation")
def array_text_multidim(spark, sf_dir):
    """Arrays of arrays, with and without bounds, of numbers and null."""
    a = F.array(F.array(F.col("n_nationkey").cast("int"), F.lit(2)), F.array(F.lit(None).cast("int"), F.col("n_regionkey").cast("int")))
    n = read(spark, sf_dir, "nation").select("n_nationkey", array_to_text(a, 2).alias("literal"))
    back = text_to_array(F.concat(F.lit("[0:1][1:2]="), F.col("literal")), "array<array<int>>")
    return n.select("n_nationkey", "literal", F.element_at(F.element_at(back, 2), 2).alias("last"), F.size(back).alias("n"))


_INTERVALS = [("1 year 2 mons 3 days -04:05:06.7", 14, 3, -14706700000), ("-3 days", 0, -3, 0), ("10:00:00", 0, 0, 36000000000), ("2 years", 24, 0, 0), ("-1 years +2 mons -3 days +04:05:06", -10, -3, 14706000000), ("-1 year -2 mons +3 days -00:00:00.000001", -14, 3, -1), ("1 mon", 1, 0, 0), ("100:00:00", 0, 0, 360000000000), ("00:00:00", 0, 0, 0), ("-00:30:00", 0, 0, -1800000000), ("1 day 00:00:01", 0, 1, 1000000)]


@query("interval_parse", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {m}, {d}, {u})" for t, m, d, u in _INTERVALS) + ") t(txt, months, days, micros)")
def interval_parse(spark, sf_dir):
    t = spark.createDataFrame([(x[0],) for x in _INTERVALS], "txt string")
    return t.select("txt", parse_interval(F.col("txt")).alias("i")).orderBy(interval_key(F.col("i"))).select("txt", "i.months", "i.days", "i.micros")


@query("timestamp_roundtrip", "SELECT o_orderkey, epoch_us(o_orderdate::TIMESTAMP) - 946684800000000 AS binary_form, o_orderdate::TIMESTAMP AS back FROM orders")
def timestamp_roundtrip(spark, sf_dir):
    """Microseconds since 2000-01-01, the binary form, and back."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", timestamp_to_binary(F.col("o_orderdate").cast("timestamp")).alias("binary_form"))
    return o.select("o_orderkey", "binary_form", binary_to_timestamp(F.col("binary_form")).cast("timestamp_ntz").alias("back"))


_STAMPS = [("2000-01-01 00:00:00", "TIMESTAMP '2000-01-01'"), ("1999-12-31 23:59:59.5", "TIMESTAMP '1999-12-31 23:59:59.5'"), ("infinity", None), ("-infinity", None), ("0044-03-15 12:00:00 BC", "make_timestamp(-43, 3, 15, 12, 0, 0.0)"), ("0001-01-01 00:00:00", "TIMESTAMP '0001-01-01'"), ("2024-02-29 01:02:03.000004+02", "TIMESTAMP '2024-02-28 23:02:03.000004'"), ("1600-02-29 00:00:00-07:30", "TIMESTAMP '1600-02-29 07:30:00'")]
_STAMPS_SQL = ", ".join(f"('{t}', epoch_us({x}) - 946684800000000)" if x else f"('{t}', {'-9223372036854775807 - 1' if t[0] == '-' else '9223372036854775807'})" for t, x in _STAMPS)


@query("timestamp_text", f"SELECT txt, micros::BIGINT AS micros FROM (VALUES {_STAMPS_SQL}) t(txt, micros)")
def timestamp_text(spark, sf_dir):
    """Timestamps before Christ, infinite ones, and ones with a zone."""
    t = spark.createDataFrame([(x[0],) for x in _STAMPS], "txt string")
    return t.select("txt", parse_timestamp(F.col("txt")).alias("micros"))


@query("udf_scalar", "SELECT c_custkey, reverse(c_name) AS r FROM customer")
def udf_scalar(spark, sf_dir):
    """A user's scalar function over Arrow batches."""

    @F.pandas_udf("string")
    def turned(x: pd.Series) -> pd.Series:
        return x.str[::-1]

    return read(spark, sf_dir, "customer").select("c_custkey", turned("c_name").alias("r"))


@query("udaf_grouped", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY c_nationkey")
def udaf_grouped(spark, sf_dir):
    """A user's aggregate function; one group's column must fit a task, so built-in aggregates come first where they can say it."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 4).alias("spread"))


@query("udtf_basic", "SELECT n_nationkey, i, substr(n_name, i + 1, 1) AS ch FROM (SELECT n_nationkey, n_name, unnest(range(length(n_name)))::INTEGER AS i FROM nation) t")
def udtf_basic(spark, sf_dir):
    """A user's table function, joined laterally."""

    @F.udtf(returnType="i int, ch string")
    class Letters:
        def eval(self, text: str):
            for i, ch in enumerate(text):
                yield i, ch

    spark.udtf.register("letters", Letters)
    read(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, i, ch FROM nation, LATERAL letters(n_name)")
