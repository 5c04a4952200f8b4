"""Benchmark decontamination by a hash set of normalised n-grams (DataFrame functions only).

Each benchmark item yields its windows of 13 consecutive words; an item of
fewer words, but not none, yields one window of all its words.  The distinct
windows form the build side of a hash join.  It is broadcast when its measured
size is proven small and joined by shuffle otherwise.  The window's own words
are the join key, so a hash hit is verified by comparing the words.

A set of bits, one for the hash of each window's first two, middle and last words,
goes into the scan: a training window is only put together where its bit is set.  So a
text's array holds the windows that may hit and not all.  The set has a fixed bound;
beyond it more windows are put together, with the same result.

Edge cases: null and empty texts have no words and no hits; items without words
yield no window; an item whose id is null counts as the item ''.  Rows of equal
doc_id and text give equal results and all of them are returned.  Long texts are
scanned whole; empty tables give no rows or no hits.  Ids of any type pass through
unchanged; other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_words, bit_set, has_bit, small_side, stored, table

WIDTH = 13
MOST_BITS = 1 << 22


def _window(words: Column, at: Column, k: Column) -> Column:
    """The k words from place `at` (from 0)."""
    return F.array_join(F.slice(words, at + 1, k), " ")


def benchmark_windows(items: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: w string, k int (its words), items array<string> (sorted ids that have it), h (the hash of some of its words)."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), ascii_words(F.col(text_col)).alias("words")).where("size(words) > 0")
    k = F.least(F.size("words"), F.lit(width))
    runs = words.select("item", "words", k.alias("k"), F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("p"))
    runs = runs.select("item", "k", _window(F.col("words"), F.col("p"), F.col("k")).alias("w"), _some(F.col("words"), F.col("p"), F.col("k")).alias("h"))
    return runs.groupBy("w", "k", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _some(words: Column, at: Column, k: Column) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in (F.lit(0), F.least(F.lit(1), k - 1), F.floor(k / 2).cast("int"), k - 1)))


def _may_hit(words: Column, k: Column, bits: Column, n: int):
    """Of a place: is the bit of its window's hash set?"""
    return lambda p: has_bit(bits, n, _some(words, p, k))


def _placed(words: Column, k: Column):
    return lambda p: F.struct(p.alias("p"), _window(words, p, k).alias("w"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated and hits (merged [start, end) word spans)."""
    windows = stored(benchmark_windows(items, width), "windows")
    widths = {r.k: r["count"] for r in windows.groupBy("k").count().collect()}  # at most `width` rows
    side = small_side(windows.drop("h"), limit)
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), ascii_words(F.col(text_col)).alias("words"))
    runs = []
    for k, count in sorted(widths.items()):
        places = F.filter(F.sequence(F.lit(0), F.size("words") - k), _may_hit(F.col("words"), F.lit(k), *bit_set(windows.where(F.col("k") == k), count, MOST_BITS)))
        places = F.when(F.size("words") >= k, places).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(places, _placed(F.col("words"), F.lit(k))))
    mark = F.array(F.struct(F.lit(-1).alias("p"), F.lit("").alias("w")))
    runs = words.select("id", "fp", F.size("words").alias("n_words"), F.explode(F.concat(mark, *runs)).alias("r"))
    runs = runs.select("id", "fp", "n_words", F.col("r.p").alias("p"), F.col("r.w").alias("w"))
    found = runs.join(side, "w", "left").where("p = -1 or k is not null")
    span = F.when(F.col("k").isNotNull(), F.struct(F.col("p").alias("s"), (F.col("p") + F.col("k")).alias("e")))
    per = found.groupBy("id", "fp", "n_words").agg(F.sum((F.col("p") == -1).cast("int")).alias("copies"), F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("items").alias("sets"))
    # spans come sorted by start, then end: one pass merges them
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,e:int>>"),
        lambda a, x: F.when((F.size(a) > 0) & (x["s"] <= F.try_element_at(a, F.lit(-1))["e"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(a, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(a, F.lit(-1))["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(x))),
    )
    ids = F.array_sort(F.array_distinct(F.flatten("sets")))
    per = per.select("id", "fp", "n_words", "copies", merged.alias("hits"), ids.alias("ids"))
    n_hit = F.aggregate("hits", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    per = per.select("id", "fp", "n_words", n_hit.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), "hits", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return per.select(F.col("id").alias(id_col), "fp", F.col("n_words").cast("long").alias("n_words"), "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "hits")


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "drop", width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents (mode 'drop'), or with their hit words removed (mode 'spans').

    In mode 'spans' the text of a contaminated document becomes its remaining
    normalised words.  Columns and their order stay; all other rows stay as they are.
    """
    bad = contamination(docs, items, width, id_col, text_col).where("contaminated").select(F.col(id_col).alias("__id"), F.col("fp").alias("__fp"), F.col("hits").alias("__hits"))
    bad = bad.dropDuplicates(["__id", "__fp"])
    bad = stored(bad.select("__id", "__fp") if mode == "drop" else bad, "contaminated")
    side = small_side(bad)
    on = docs[id_col].eqNullSafe(side["__id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == side["__fp"])
    if mode == "drop":
        return docs.join(side, on, "left_anti")
    if mode != "spans":
        raise ValueError(f"mode {mode!r}: 'drop' or 'spans'")
    words = ascii_words(F.col(text_col))
    kept = F.filter(words, lambda w, i: ~F.exists("__hits", lambda h: (i >= h["s"]) & (i < h["e"])))
    new = F.when(F.col("__hits").isNotNull(), F.array_join(kept, " ")).otherwise(F.col(text_col))
    return docs.join(side, on, "left").select(*(new.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("fp", "hits")


#: DuckDB SQL for op10_decontamination.
ORACLE = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(words), {WIDTH}) AS k, unnest(list_transform(range(len(words) - least(len(words), {WIDTH}) + 1), lambda i: array_to_string(words[i + 1 : i + least(len(words), {WIDTH})], ' '))) AS win FROM b WHERE len(words) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, unnest(range(len(words) - k + 1)) AS p, unnest(list_transform(range(len(words) - k + 1), lambda i: array_to_string(words[i + 1 : i + k], ' '))) AS win FROM w, ks WHERE len(words) >= k),
hit AS (SELECT dw.r, dw.p, dw.k, item FROM dw JOIN bw USING (k, win)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN ids USING (r)
"""
