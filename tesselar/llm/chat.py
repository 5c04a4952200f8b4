"""Tool-call linking (DataFrame functions only).

Calls and results are hash-joined by identifier.  Calls are put into topological
order: a call's level is one more than the largest level of the calls it depends
on.  Chains are resolved by pointer doubling, what branches by Kahn's rounds, until
a round places nothing.  Arguments are validated against schemas, and calls are
serialised as canonical JSON: keys sorted, no white space.

Edge cases: arguments that are not a JSON object are invalid and serialised as a
JSON string.  A dependency on an unknown call is ignored.  Calls on or behind a
cycle get no level.  Repeated identifiers: each call gives one row, with the number
of its identifier's results and the smallest of their contents (by its bytes; null if
all are), and results without a call give one row to an identifier, so that rows never
multiply; a call's level is that of its identifier.  A null identifier links with
nothing: its calls are open and of level 0, its results are orphans, one row in all.
Empty tables give no rows.  Long texts are kept whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Names of JSON Schema types, and those that schema_of_variant gives for them.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def canonical(json: Column) -> Column:
    """Canonical JSON of a JSON text; null where it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def violations(arguments: Column, schema: dict) -> Column:
    """Sorted array of what an arguments text breaks in a schema: properties (type, enum, minimum, maximum, maxLength), required, additionalProperties."""
    v = F.try_parse_json(arguments)
    bad = [F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not an object"))]
    raw = F.from_json(arguments, "map<string,string>")
    for name in schema.get("required", []):
        bad.append(F.when(~F.coalesce(F.map_contains_key(raw, F.lit(name)), F.lit(False)), F.lit(f"{name}: missing")))
    for name, rule in schema.get("properties", {}).items():
        at = F.try_variant_get(v, f"$['{name}']", "variant")
        text, number = F.try_variant_get(v, f"$['{name}']", "string"), F.try_variant_get(v, f"$['{name}']", "double")
        if "type" in rule:
            bad.append(F.when(at.isNotNull() & ~F.schema_of_variant(at).rlike(f"^({_TYPES[rule['type']]})"), F.lit(f"{name}: type")))
        if "enum" in rule:
            bad.append(F.when(at.isNotNull() & ~text.isin(*map(str, rule["enum"])), F.lit(f"{name}: enum")))
        if "minimum" in rule:
            bad.append(F.when(number < rule["minimum"], F.lit(f"{name}: minimum")))
        if "maximum" in rule:
            bad.append(F.when(number > rule["maximum"], F.lit(f"{name}: maximum")))
        if "maxLength" in rule:
            bad.append(F.when(F.length(text) > rule["maxLength"], F.lit(f"{name}: maxLength")))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.map_keys(raw), F.array(*map(F.lit, schema.get("properties", {"": 0}))))
        bad.append(F.when(F.size(F.coalesce(extra, F.array())) > 0, F.lit("additional properties")))
    return F.array_sort(F.array_compact(F.array(*bad)))


def levels(depends: DataFrame) -> DataFrame:
    """depends (call_id, on_id) -> call_id, level of every call that depends on something; null level on and behind a cycle.

    Calls with one dependency form chains: pointers are doubled until each chain's
    head is found, so a chain of n calls takes log2 n rounds.  Calls with several are
    then placed by Kahn's rounds over the contracted graph.  Each round is stored.
    """
    edges = stored(depends.select("call_id", "on_id").where("call_id is not null and on_id is not null").distinct(), "depends")
    degree = edges.groupBy("call_id").agg(F.count("on_id").alias("n"), F.min("on_id").alias("up"))
    chain = stored(degree.where("n = 1").select(F.col("call_id").alias("v"), "up", F.lit(1).cast("long").alias("d")), "chain").withColumn("done", F.lit(False))
    before = None
    while True:
        # done: the pointer has left the chains; those that never do run in a cycle, and then a round resolves nothing
        nxt = chain.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        moved = chain.join(nxt, "up", "left").select("v", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("up2").isNull().alias("done"))
        chain = stored(moved, "chain")
        still = chain.where("not done").count()
        if not still or still == before:
            break
        before = still
    heads = chain.where("done").select("v", F.col("up").alias("head"), "d")
    several = degree.where("n > 1").select("call_id")
    if not several.limit(1).count():
        known = heads.select(F.col("v").alias("call_id"), F.col("d").cast("int").alias("level"))
        return known.unionByName(chain.where("not done").select(F.col("v").alias("call_id"), F.lit(None).cast("int").alias("level")))
    # dependencies of the calls with several, as (head, distance); one that runs in a cycle has no head and stays open
    left = edges.join(several, "call_id", "left_semi").join(chain.select(F.col("v").alias("on_id"), F.when(F.col("done"), F.col("up")).alias("head"), F.col("d"), F.lit(True).alias("chained")), "on_id", "left")
    left = stored(left.select("call_id", F.when(F.col("chained"), F.col("head")).otherwise(F.col("on_id")).alias("head"), F.coalesce("d", F.lit(0)).alias("d")), "left")
    level = several.withColumn("level", F.lit(None).cast("long"))
    placed = stored(level.where("level is not null"), "placed")
    count = 0
    while True:
        open_calls = several.join(placed, "call_id", "left_anti")
        at = left.join(open_calls, "call_id", "left_semi").join(placed.select(F.col("call_id").alias("head"), F.col("level").alias("l")), "head", "left")
        at = at.join(several.select(F.col("call_id").alias("head"), F.lit(True).alias("inner")), "head", "left")
        known = F.when(F.col("head").isNotNull(), F.when(F.col("inner"), F.col("l")).otherwise(F.lit(0)))
        now = at.groupBy("call_id").agg(F.max(known + F.col("d") + 1).alias("level"), F.sum(known.isNull().cast("int")).alias("missing")).where("missing = 0").select("call_id", "level")
        placed = stored(placed.unionByName(now), "placed")
        n = placed.count()
        if n == count:
            break
        count = n
    all_heads = heads.join(placed.select(F.col("call_id").alias("head"), "level"), "head", "left").join(several.select(F.col("call_id").alias("head"), F.lit(True).alias("inner")), "head", "left")
    single = all_heads.select(F.col("v").alias("call_id"), F.when(F.col("inner"), F.col("level") + F.col("d")).otherwise(F.col("d")).cast("int").alias("level"))
    single = single.unionByName(chain.where("not done").select(F.col("v").alias("call_id"), F.lit(None).cast("int").alias("level")))
    return single.unionByName(several.join(placed, "call_id", "left").select("call_id", F.col("level").cast("int").alias("level")))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls (call_id, name, arguments, on_ids array) full-joined with results (call_id, content).

    Returns call_id, name, status (linked, open: no result, orphan: no call),
    level, errors (array; of a name without schema: unknown tool), n_results and json.
    """
    lv = levels(calls.select("call_id", F.explode("on_ids").alias("on_id")).join(calls.select(F.col("call_id").alias("on_id")).distinct(), "on_id", "left_semi"))
    checks = F.array("-")
    for i, (name, schema) in enumerate(sorted(schemas.items())):
        checks = F.when(F.col("name") == name, violations(F.col("arguments"), schema)) if i == 0 else checks.when(F.col("name") == name, violations(F.col("arguments"), schema))
    errors = checks.otherwise(F.array(F.lit("unknown tool"))) if schemas else F.array(F.lit("unknown tool"))
    c = calls.select("call_id", "name", F.coalesce("arguments", F.lit("")).alias("arguments")).withColumn("errors", errors).withColumn("arguments", F.coalesce(canonical(F.col("arguments")), F.to_json(F.array("arguments")).substr(F.lit(2), F.length(F.to_json(F.array("arguments"))) - 2)))
    c = c.withColumn("has_call", F.lit(True))
    r = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results")).withColumn("has_result", F.lit(True))
    both = c.join(r, "call_id", "full").join(lv.withColumn("known", F.lit(True)), "call_id", "left")
    status = F.when(F.col("has_call").isNull(), "orphan").when(F.col("has_result").isNull(), "open").otherwise("linked")
    text = lambda x: F.when(x.isNull(), "null").otherwise(F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))
    json = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"call_id":'), text(F.col("call_id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("content")), F.lit("}"))
    level = F.when(F.col("has_call"), F.when(F.col("known"), F.col("level")).otherwise(F.lit(0)))
    return both.select("call_id", "name", status.alias("status"), level.alias("level"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), json.alias("json"))


#: What an assistant turn is called with when a conversation is read as tool calls.
SCHEMAS = {"reply": {"properties": {"conv": {"type": "integer", "minimum": 0}, "turn": {"type": "integer", "minimum": 0}, "text": {"type": "string", "maxLength": 1500}}, "required": ["conv", "turn", "text"], "additionalProperties": False}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations: an assistant turn calls `reply` and depends on the assistant turn two places before it; a user turn is the result of the turn before it."""
    key = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    said = turns.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    calls = said.select(key(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("turn"), F.col("text"), F.col("conv_id").alias("conv"))).alias("arguments"), F.array(key(2)).alias("on_ids"))
    heard = turns.where((F.col("role") == "user") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    return calls, heard.select(key(1).alias("call_id"), F.col("text").alias("content"))


def op6_chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(*conversation_calls(table(spark, sf_dir, "conversations")), SCHEMAS)
    return out.withColumn("errors", F.array_join("errors", ","))


#: DuckDB SQL for op6_chat_linking.
ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, "text" FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, "text" FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id || ':' || (turn - 1) AS call_id, min("text") AS content, count(*) AS n_results FROM t WHERE role = 'user' GROUP BY 1),
lv(conv_id, turn, level) AS (
    SELECT DISTINCT a.conv_id, a.turn, 0 FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2)
    UNION SELECT DISTINCT a.conv_id, a.turn, lv.level + 1 FROM c a JOIN lv ON a.conv_id = lv.conv_id AND a.turn = lv.turn + 2)
SELECT coalesce(c.call_id, r.call_id) AS call_id, CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS name, coalesce(r.n_results, 0)::BIGINT AS n_results,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'open' ELSE 'linked' END AS status,
    CASE WHEN c.call_id IS NOT NULL THEN lv.level END::INTEGER AS level,
    CASE WHEN c.call_id IS NULL THEN '' WHEN c."text" IS NULL THEN 'text: missing' WHEN length(c."text") > 1500 THEN 'text: maxLength' ELSE '' END AS errors,
    '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{"conv":' || c.conv_id || CASE WHEN c."text" IS NULL THEN '' ELSE ',"text":' || to_json(c."text")::VARCHAR END || ',"turn":' || c.turn || '}' END
        || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
        || ',"result":' || CASE WHEN r.content IS NULL THEN 'null' ELSE to_json(r.content)::VARCHAR END || '}' AS json
FROM c FULL JOIN r ON c.call_id = r.call_id LEFT JOIN lv ON lv.conv_id = c.conv_id AND lv.turn = c.turn
"""
