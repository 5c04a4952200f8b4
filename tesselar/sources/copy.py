"""Bulk load and unload in PostgreSQL's COPY formats: text, CSV and binary."""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the binary format.
SIGNATURE = b"PGCOPY\n\xff\r\n\x00"
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
#: Spark type -> (struct format, to and from Python).
_BINARY = {"bigint": "q", "int": "i", "smallint": "h", "double": "d", "float": "f", "boolean": "?"}


def read_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    r"""COPY text format: tabs divide, \N is null, backslash escapes, no quotes; a line \. ends its file's data.

    Lines are split in the JVM.  Where a line holds a backslash, pairs of them and
    escaped tabs are first put out of the way, so that a plain split finds the fields.
    """
    fields = StructType.fromDDL(schema)
    place = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(place.alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    # lines behind the mark go, wherever the file was split; hardly a file has one
    ends = lines.where(F.col("value") == "\\.").groupBy("file").agg(F.min("at").alias("end"))
    if ends.limit(1).count():
        lines = lines.join(ends, "file", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    away, back = "\ufdd0", "\\"
    hidden = F.col("value")
    for old, new in ((away, away + "0"), (back + back, away + "1"), (back + "\t", away + "2")):
        hidden = F.replace(hidden, F.lit(old), F.lit(new))
    odd = F.contains("value", F.lit(back))
    lines = lines.select(odd.alias("odd"), F.split(F.when(odd, hidden).otherwise(F.col("value")), "\t").alias("cells"))

    def plain(x):
        for old, new in (*((back + c, ch) for c, ch in _ESCAPES.items()), (back, ""), (away + "2", "\t"), (away + "1", back), (away + "0", away)):
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    cell = lambda i: F.get("cells", F.lit(i))
    return lines.select(*(F.when(cell(i) != "\\N", F.when(F.col("odd"), plain(cell(i))).otherwise(cell(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


def to_text(df: DataFrame) -> DataFrame:
    """One column, value: rows in COPY text format; line ends and backslashes in cells are escaped, so a line is a row."""

    def cell(f):
        x = F.regexp_replace(F.col(f"`{f.name}`").cast("string"), r"\\", r"\\\\")
        for code, ch in _ESCAPES.items():
            x = F.regexp_replace(x, ch if ch not in "\b" else "\\x08", "\\\\" + code)
        return F.coalesce(x, F.lit("\\N"))

    return df.select(F.concat_ws("\t", *(cell(f) for f in df.schema)).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = ",", null: str = "", lines: bool = False) -> DataFrame:
    """COPY CSV format: an unquoted null string is null, doubled quotes escape, fields may hold line ends.

    lines: no field holds a line end, so that large files are split over tasks.
    """
    empty = "\x01"  # a quoted empty field; the reader would take an empty string for the null string
    df = spark.read.csv(path, schema=schema, header=header, sep=sep, nullValue=null, emptyValue=empty, quote='"', escape='"', multiLine=not lines)
    return df.select(*(F.when(F.col(f"`{f.name}`") == empty, "").otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema))


def write_csv(df: DataFrame, path: str, header: bool = False, sep: str = ",", null: str = "", mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=header, sep=sep, nullValue=null, emptyValue='""', quote='"', escape='"')


def encode_row(row: tuple, types: list[str]) -> bytes:
    out = [struct.pack(">h", len(types))]
    for v, kind in zip(row, types, strict=True):
        if v is None:
            out.append(struct.pack(">i", -1))
            continue
        raw = struct.pack(">" + _BINARY[kind], v) if kind in _BINARY else bytes(v) if kind == "binary" else str(v).encode()
        out += [struct.pack(">i", len(raw)), raw]
    return b"".join(out)


def encode_binary(rows: Iterator[tuple], types: list[str]) -> bytes:
    return b"".join([SIGNATURE, struct.pack(">ii", 0, 0), *(encode_row(r, types) for r in rows), struct.pack(">h", -1)])


def decode_binary(data: bytes, types: list[str]) -> Iterator[tuple]:
    yield from decode_stream(io.BytesIO(data), types)


def decode_stream(f, types: list[str]) -> Iterator[tuple]:
    """Rows of a binary COPY file, read field by field: memory holds one row."""

    def take(n: int) -> bytes:
        got = f.read(n)
        if len(got) != n:
            raise ValueError("the file ends within a row")
        return got

    if f.read(11) != SIGNATURE:
        raise ValueError("not a binary COPY file")
    take(4)
    take(struct.unpack(">i", take(4))[0])
    while True:
        (n,) = struct.unpack(">h", take(2))
        if n == -1:
            return
        if n != len(types):
            raise ValueError(f"a row has {n} fields, the schema {len(types)}")
        row = []
        for kind in types:
            (size,) = struct.unpack(">i", take(4))
            if size == -1:
                row.append(None)
                continue
            raw = take(size)
            row.append(struct.unpack(">" + _BINARY[kind], raw)[0] if kind in _BINARY else raw if kind == "binary" else raw.decode())
        yield tuple(row)


class _BinaryReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.types, self.path = [f.dataType.simpleString() for f in schema], path

    def partitions(self) -> list[InputPartition]:
        """One per file."""
        from pyarrow import fs

        uri = self.path if re.match(r"[a-z0-9+.-]+:", self.path) else f"file://{self.path}"
        where, path = fs.FileSystem.from_uri(uri)
        info = where.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path))
        scheme = uri.split(":", 1)[0]
        return [InputPartition((scheme, f.path)) for f in files if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        scheme, path = partition.value
        where, path = fs.FileSystem.from_uri(f"{scheme}://{path}")
        with where.open_input_stream(path, compression=None, buffer_size=1 << 20) as f:
            yield from decode_stream(f, self.types)


class BinaryCopySource(DataSource):
    """spark.read.format("copy_binary").schema(...).load(path): binary COPY files, one task per file."""

    @classmethod
    def name(cls) -> str:
        return "copy_binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BinaryReader(schema, self.options["path"])


def to_binary(df: DataFrame, group: list[str]) -> DataFrame:
    """group columns and data: a binary COPY file for each task's rows of each group, as a column; rows are streamed, never gathered per group."""
    import pandas as pd

    types = [f.dataType.simpleString() for f in df.schema if f.name not in group]
    names = [f.name for f in df.schema if f.name not in group]
    keys = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, part in b.groupby(group, dropna=False, sort=False):
                rows = (tuple(None if pd.isna(v) else v for v in r) for r in part[names].itertuples(index=False))
                out.append((*key, encode_binary(rows, types)))
            yield pd.DataFrame(out, columns=[*group, "data"])

    return df.select(*group, *names).mapInPandas(run, f"{keys}, data binary")


def write_binary(df: DataFrame, path: str) -> None:
    """One binary COPY file per task under path, written row by row; a task that runs again writes a file of the same name."""
    from pyspark import TaskContext

    types = [f.dataType.simpleString() for f in df.schema]
    uri = path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}"

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(uri)
        where.create_dir(folder, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}", 0
        aside = f"{folder}/.{name}.{uuid.uuid4().hex}"  # moved when it is whole
        with where.open_output_stream(aside, compression=None) as f:
            f.write(SIGNATURE + struct.pack(">ii", 0, 0))
            for b in batches:
                rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
                f.write(b"".join(encode_row(r, types) for r in rows))
                n += b.num_rows
            f.write(struct.pack(">h", -1))
        where.move(aside, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()
