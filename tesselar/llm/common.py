"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Arrow batches between Spark and Python hold at most this many bytes, unless the session sets a size.
BATCH_BYTES = 4 << 20
#: A side below this many bytes may be broadcast; its size is always counted first.
BROADCAST_BYTES = 16 << 20

# Lower-case A-Z, and every ASCII character that is neither a letter nor a digit becomes a space.
_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_BREAKS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured a local one is set, on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tesselar-shared-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tesselar-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages survive a lost executor without recomputing."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows: texts differ in length by orders of magnitude."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes_of(value: Column, kind: DataType) -> Column:
    """Bytes that a value takes in a row, about; null takes none beyond its place."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
            return F.coalesce(F.aggregate(value, F.lit(24), lambda a, x: (a + _bytes_of(x, kind.elementType)).cast("int")), F.lit(0))
        return F.coalesce(F.size(value), F.lit(0)) * 8 + 24
    if isinstance(kind, StructType):
        return sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(16 if kind.simpleString().startswith("decimal") else 8)


def measured(df: DataFrame) -> int:
    """Bytes of all rows of df as rows of a hash table, about; a job that reads df once."""
    return df.agg(F.sum(sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24)).cast("long"))).first()[0] or 0


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def whole_partitions(spark: SparkSession) -> AbstractContextManager:
    """While it holds, AQE joins shuffle partitions up to the advisory size, whatever the number of cores: an operator of many small jobs then starts few tasks and writes few files."""
    return _settings(spark, **{"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"})


def short_jobs(spark: SparkSession) -> AbstractContextManager:
    """For rounds of jobs over few rows: no stage is compiled as a whole, which would take driver and executors longer than the rows, and fill their memory with classes."""
    return _settings(spark, **{"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.codegen.wholeStage": "false"})


#: Of each operator that keeps something in a Python worker between tasks: how to let go of it.
worker_caches: dict[str, Callable[[], None]] = {}
_owner = ""


def _give_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def worker_of(operator: str) -> None:
    """A Python worker serves many operators in turn: what the others keep is dropped."""
    global _owner
    if _owner != operator:
        _owner = operator
        for name, clear in worker_caches.items():
            if name != operator:
                clear()
        _give_back()


def in_worker(operator: str, run: Callable) -> Callable:
    """run(batches) of an operator's task, in a worker that holds nothing of other operators and, after the task, nothing that is free."""

    def task(batches: Iterator) -> Iterator:
        worker_of(operator)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def heap_back(spark: SparkSession) -> None:
    """Executors collect their garbage and return the heap that is free then to the system.

    A heap that a large job has stretched keeps that size through small ones, beside the
    Python workers and buffers of each.  For the borders of stages: one task on each core.
    """
    n = 1 if spark.sparkContext._jsc.sc().isLocal() else spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))).collect()


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured bytes stay below limit, else df for a shuffled join.

    df should be stored or cheap: it is read once here.
    """
    return F.broadcast(df) if measured(df) <= limit else df


def ascii_words(text: Column) -> Column:
    """Lower-cased words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null or empty text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(flat, " "), "")


def bit_set(hashes: DataFrame, n: int, most: int = 1 << 22) -> tuple[Column, int]:
    """A set of bits for the about n numbers of hashes' column h: an array of 64 bits to a number, and how many bits there are.

    32 bits to a number, but `most` (a power of two) at most: the array is part of the plan.
    Beyond that more numbers than those have a bit that is set.
    """
    bits = min(most, max(1 << 16, 1 << (32 * n - 1).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    got = {r.i: r.b for r in hashes.select(F.shiftright(at, 6).alias("i"), one.alias("one")).groupBy("i").agg(F.bit_or("one").alias("b")).collect()}  # at most bits / 64 rows
    return F.split(F.lit(",".join(str(got.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>"), bits


def has_bit(bits: Column, n: int, h: Column) -> Column:
    at = h.bitwiseAND(F.lit(n - 1))
    return F.call_function("shiftright", F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
