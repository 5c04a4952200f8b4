"""License scan with a positional rare-token index (DataFrame functions only).

A template is a run of words that identifies a license, with a mandatory key
phrase inside it; templates are a table, of any number.  Document frequencies of their
words are counted over the whole corpus; the rarest words (highest IDF) of a key
phrase are its anchors.  The index maps the rarest anchor to its postings: template,
relative position, and the other anchors with theirs.  In each text the anchors are
looked up: a set of bits finds the places that may hold one, which travel with the
words around them and are joined with the postings by the word.  A place stays where
all anchors of a template stand at their relative positions; there the key phrase is
verified word by word.  All anchors of a phrase lie in every occurrence of it, so no
occurrence is lost.

A place scores the share of template words that stand where the template has
them; a template's label is given from MIN_SCORE on.  Base phrases are templates
that consist of their key phrase alone.

Edge cases: null and empty texts have no words, no labels and score 0.  Every
input row gives one row; repeated rows give equal rows, and rows of equal id are told
apart by their texts.  Long texts are scanned whole; empty tables give no rows, empty
templates no labels.  Places that two templates of one label share count once in each
list.  Ids of any type pass through unchanged; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, bit_set, has_bit, small_side, stored, table

# Phrases that count as base places, with their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Usual wording of license notices: template words, key phrase in it, label.
TEMPLATES = [
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license version 2 0", "apache license version 2", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2", "gpl-2"),
    ("this work is licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3", "lgpl-3"),
    ("this work is licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("this work is licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "agpl-3"),
    ("subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software", "isc"),
    ("licensed under cc by nc 4 0", "cc by nc", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc by sa", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc by nd", "cc-by-nd"),
    ("this is free and unencumbered software released into the public domain", "released into the public domain", "unlicense"),
    ("all rights reserved", "all rights reserved", "all-rights-reserved"),
]

ANCHORS = 2
MIN_SCORE = 0.5


def _entries() -> list[dict]:
    out = [{"words": p.split(), "key": 0, "n_key": len(p.split()), "label": label, "base": True} for p, label in BASE]
    for text, key, label in TEMPLATES:
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        out.append({"words": w, "key": at, "n_key": len(k), "label": label, "base": False})
    return out


def built_in(spark: SparkSession) -> DataFrame:
    """The templates of this module as a table: words, key (place of the key phrase), n_key (its words), label, base."""
    words = lambda w: "array(" + ", ".join(f"'{x}'" for x in w) + ")"
    rows = ", ".join(f"({words(e['words'])}, {e['key']}, {e['n_key']}, '{e['label']}', {str(e['base']).lower()})" for e in _entries())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(words, key, n_key, label, base)")


def _some_words(words: DataFrame) -> tuple[Column, int]:
    """A set of bits of the words of a small table (column w)."""
    return bit_set(words.select(F.xxhash64("w").alias("h")), words.count())


def word_frequencies(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """w, n: in how many texts of the whole corpus each word of the vocabulary (column w) stands."""
    bits = _some_words(vocabulary)
    have = F.array_distinct(F.filter(ascii_words(F.col(text_col)), lambda w: has_bit(*bits, F.xxhash64(w))))
    found = docs.select(F.explode(have).alias("w")).join(small_side(vocabulary), "w").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.join(found, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))


def postings_of(templates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row per template: w (its rarest anchor), r (the anchor's place in the template), anchors (array of place and word), and the template."""
    t = templates.withColumn("t", F.monotonically_increasing_id())
    phrase = F.slice("words", F.col("key") + 1, F.col("n_key"))
    # the first place of each distinct word of the phrase; of equal counts the first by letters
    first = F.transform(F.array_distinct(phrase), lambda w: F.struct(w.alias("w"), (F.col("key") + F.array_position(phrase, w) - 1).cast("int").alias("r")))
    each = t.select("t", F.explode(first).alias("a")).select("t", "a.w", "a.r").join(frequencies, "w")
    rare = each.groupBy("t").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "w", "r"))), 1, ANCHORS).alias("rare"))
    rare = rare.select("t", F.element_at("rare", 1)["w"].alias("w"), F.element_at("rare", 1)["r"].alias("r"), F.transform("rare", lambda a: F.struct(a["r"].alias("r"), a["w"].alias("w"))).alias("anchors"))
    return t.withColumn("phrase", phrase).join(rare, "t").drop("t")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and places (array of label, start, score, base)."""
    templates = stored(built_in(docs.sparkSession) if templates is None else templates, "templates")
    if frequencies is None:
        vocabulary = stored(templates.select(F.explode("words").alias("w")).distinct(), "vocabulary")
        frequencies = word_frequencies(docs, vocabulary, text_col)
    postings = stored(postings_of(templates, frequencies), "postings")
    bits = _some_words(postings.select("w").distinct())
    reach = templates.agg(F.max(F.size("words"))).first()[0] or 1

    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), ascii_words(F.col(text_col)).alias("words"))
    # a place that may hold an anchor, with the words that a template can reach from there
    at = F.filter(F.transform("words", lambda w, i: F.when(has_bit(*bits, F.xxhash64(w)), i)), lambda i: i.isNotNull())
    lo = lambda i: F.greatest(i - reach, F.lit(0))
    places = F.transform(at, lambda i: F.struct(i.alias("i"), F.get("words", i).alias("w"), lo(i).alias("lo"), F.slice("words", lo(i) + 1, i - lo(i) + reach + 1).alias("near")))
    mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("w"), F.lit(0).alias("lo"), F.array().cast("array<string>").alias("near")))
    hits = words.select("id", "fp", F.size("words").alias("n_words"), F.explode(F.concat(mark, places)).alias("h")).select("id", "fp", "n_words", "h.*")
    met = hits.join(small_side(postings.withColumnRenamed("words", "whole")), "w", "left").where("i = -1 or r is not null").withColumn("d", F.col("i") - F.col("r"))
    # word j of the template stands at d + j of the text
    stands = lambda j: F.when(F.col("d") + j >= F.col("lo"), F.get("near", F.col("d") + j - F.col("lo")))
    agreed = F.forall("anchors", lambda a: F.coalesce(stands(a["r"]) == a["w"], F.lit(False)))
    verified = F.slice("near", F.greatest(F.col("d") + F.col("key") - F.col("lo") + 1, F.lit(1)), F.col("n_key")) == F.col("phrase")
    kept = (F.col("d") + F.col("key") >= F.col("lo")) & agreed & verified
    share = F.size(F.filter("whole", lambda w, j: F.coalesce(stands(j) == w, F.lit(False)))) / F.size("whole")
    place = F.when(F.col("r").isNotNull() & kept & (F.round(share, 6) >= MIN_SCORE), F.struct(F.col("label"), F.col("d").alias("start"), F.round(share, 6).alias("score"), F.col("base")))
    a = met.select("id", "fp", "n_words", (F.col("i") == -1).alias("mark"), place.alias("place"))
    a = a.groupBy("id", "fp", "n_words").agg(F.sum(F.col("mark").cast("int")).alias("copies"), F.sort_array(F.collect_set("place")).alias("places"))
    base = F.transform(F.filter("places", lambda p: p["base"]), lambda p: F.struct(p["start"].alias("start"), p["label"].alias("label")))
    a = a.withColumn("b", base).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda p: p["label"]))), ",")
    starts = F.transform("b", lambda p: p["start"])
    return a.select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("b").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        names("b").alias("base_labels"),
        names("places").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
        "places",
    )


def oracle() -> str:
    """DuckDB SQL for scan() without places."""
    rows = ",\n    ".join(f"({i}, {e['words']!r}, {e['key']}, {e['words'][e['key'] : e['key'] + e['n_key']]!r}, '{e['label']}', {str(e['base']).lower()})" for i, e in enumerate(_entries()))
    return f"""
WITH spec(t, words, key, phrase, label, base) AS (VALUES
    {rows}),
docs AS (
    SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
pos AS (SELECT r, unnest(range(len(words))) AS i, unnest(words) AS w FROM docs),
hits AS (
    SELECT d.r, s.t, s.label, s.base, p.i - s.key AS start,
        round(len(list_filter(range(len(s.words)), lambda j: p.i - s.key + j >= 0 AND coalesce(d.words[p.i - s.key + j + 1] = s.words[j + 1], false)))::DOUBLE / len(s.words), 6) AS score
    FROM pos p JOIN spec s ON p.w = s.phrase[1] JOIN docs d ON d.r = p.r
    WHERE d.words[p.i + 1 : p.i + len(s.phrase)] = s.phrase),
per AS (
    SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
    FROM hits WHERE score >= {MIN_SCORE} GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN per USING (r)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("places")
