"""Corpus pipeline: toxicity, near copies, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), with docs the table that the stage before
it kept, and its result is written as Parquet before the next one reads it.  Each begins with
executors that have returned the heap of the work before.

Odd rows, in every stage: null and empty texts are kept by the filtering stages (they
have no hits, no words and no spans), and are packed as the end id alone.  Rows without
id are kept.  Repeated rows are judged alike; the near-copy stage keeps one of them, the
other stages all.  Long texts are judged whole.  An empty table gives an empty one.
Columns beyond id, text and n_chars are passed through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselar.llm import decontaminate, jaccard, packing, secrets, toxicity
from tesselar.llm.common import heap_back, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labelled training rows among docs."""
    heap_back(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that five-word shingles link at 0.75 or more."""
    heap_back(spark)
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    heap_back(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind; n_chars follows the new text."""
    heap_back(spark)
    clean = secrets.redact(docs.withColumn("__old", F.col("text")))
    n = F.when(F.col("text").eqNullSafe(F.col("__old")), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", n).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence."""
    heap_back(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages run models, components and a packing heuristic, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
