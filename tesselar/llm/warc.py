"""WARC archives with a two-level capture index.

Write: one gzip member per record.  Of records with equal payloads of MIN_REVISIT
bytes or more, that with the smallest id is a response and the others revisit it.

Index: captures are sorted by their reversed-host URL key and id, and written in
compressed blocks of PER_BLOCK lines.  Each index file ends with its sparse block
directory (first key, place and length of each block); the list of the files'
first keys is the upper level and has one entry per file.

Read: a key is searched by bisection in the list of files, then in a file's
directory; only the blocks that can hold it are read and unpacked.  A key with many
captures lies in many blocks, which are dealt to tasks one by one.  Records are then
read by range, in the order of their places, READ_BYTES to a task.  A revisit gets the
length and digest of the response it refers to, as read; one without such a response
raises.

Archives and index lie in the folder that all executors share and are reached by
its URI.  A task that runs again writes new files; only files that a stored
table names are read.

Edge cases: null html is an empty payload, null url an empty key.  Of repeated
rows with the smallest id each is a response.  A null id is only a response where
no equal payload has an id.  Ids of 64 bits pass through unchanged.  Long payloads are
written and read whole; a batch holds one at least.  An empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, small_side, stored, table

MIN_REVISIT = 100
PER_BLOCK = 3000
ROLL_BYTES = 1 << 30
#: Bytes of records that a task reads, and of payloads that a batch holds.
READ_BYTES = 64 << 20
BATCH = 4 << 20
_DATE = "1970-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://m.example.net/a?b -> net,example,m)/a?b."""
    if not url:
        return ""
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return url
    if not host:
        return url
    extra = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(host.split("."))) + f"{extra}){p.path or '/'}" + (f"?{p.query}" if p.query else "")


def _open(uri: str, mode: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        where.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(path, compression=None)
    return where.open_input_file(path)


def _uri(path: str) -> str:
    return path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}"


def record(page: int | None, url: str | None, body: bytes, digest: str, refers: int | None) -> bytes:
    """One record as a gzip member."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(0x21, 0x7F))))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(body)}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
        block = http
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers (the response's page_id, null for responses)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    again = p.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = small_side(stored(again.select("digest", "first"), "repeats"))
    return p.join(again, "digest", "left").withColumn("refers", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


_CAPTURE = "url_key string, page_id long, file string, place long, length long"
_CAPTURES = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("length", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records; returns a capture per record (stored)."""
    base = _uri(folder)
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, place, rows = None, "", 0, []
        try:
            for page, url, html, digest, refers in _rows(batches):
                if out is None or place >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = _open(f"{base}/{name}", "w")
                data = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers)
                out.write(data)
                rows.append((url_key(url), page, name, place, len(data)))
                place += len(data)
                if len(rows) == 10_000:
                    yield _batch(rows, _CAPTURES)
                    rows = []
            yield _batch(rows, _CAPTURES)
        finally:
            if out is not None:
                out.close()

    return stored(pages.select("page_id", "url", "html", "digest", "refers").mapInArrow(run, _CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes the sorted blocks; returns the upper level: (first key, file), sorted, one entry per index file."""
    base = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, place, directory, held, first = f"{uuid.uuid4().hex}.idx", None, 0, [], [], None

        def flush() -> None:
            nonlocal place, held
            data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            directory.append([json.loads(held[0])[0], place, len(data)])
            place += len(data)
            held = []

        for row in _rows(batches):
            if out is None:
                out, first = _open(f"{base}/{name}", "w"), row[0]
            held.append(json.dumps(row, ensure_ascii=False))
            if len(held) == PER_BLOCK:
                flush()
        if out is not None:
            if held:
                flush()
            data = zlib.compress(json.dumps(directory).encode("utf-8", "surrogatepass"))
            out.write(data + struct.pack("<QQ", place, len(data)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([name])], ["first", "file"])

    ordered = captures.repartitionByRange(F.col("url_key"), F.col("page_id")).sortWithinPartitions("url_key", "page_id", "file", "place")
    files = stored(ordered.select("url_key", "page_id", "file", "place", "length").mapInArrow(run, "first string, file string"), "index")
    return sorted((r.first, r.file) for r in files.select("first", "file").collect())


class Index:
    """Reads the two levels; the directories of the last FILES files are kept, which is enough for sorted keys."""

    FILES = 4

    def __init__(self, base: str, files: list[tuple[str, str]]):
        self.base, self.first, self.names = base, [k for k, _ in files], [f for _, f in files]
        self.open: dict[str, tuple] = {}

    def _file(self, name: str) -> tuple:
        if name not in self.open:
            if len(self.open) == self.FILES:
                self.open.pop(next(iter(self.open)))[0].close()
            f = _open(f"{self.base}/{name}", "r")
            size = f.size()
            at, n = struct.unpack("<QQ", f.read_at(16, size - 16))
            directory = json.loads(zlib.decompress(f.read_at(n, at)))
            self.open[name] = (f, [d[0] for d in directory], directory)
        return self.open[name]

    def blocks(self, key: str) -> Iterator[tuple[str, int]]:
        """(file, block) of all blocks that can hold the key: bisect the files, then a file's directory."""
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            keys = self._file(self.names[i])[1]
            for k in range(max(0, bisect.bisect_left(keys, key) - 1), bisect.bisect_right(keys, key)):
                yield self.names[i], k

    def captures(self, name: str, k: int) -> tuple[list[tuple], list[str]]:
        """Captures of a block and their keys, sorted."""
        f, _, directory = self._file(name)
        _, at, n = directory[k]
        rows = [tuple(json.loads(x)) for x in zlib.decompress(f.read_at(n, at)).decode("utf-8", "surrogatepass").split("\n")]
        return rows, [r[0] for r in rows]


def lookup(urls: DataFrame, folder: str, files: list[tuple[str, str]]) -> DataFrame:
    """All captures of the distinct urls, found through the index (stored)."""
    base = _uri(folder)
    small_batches(urls.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list({url_key(u) for u in b.column(0).to_pylist()}), pa.string())], ["url_key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, schema = Index(base, files), pa.schema([("file", pa.string()), ("block", pa.int32()), ("url_key", pa.string())])
        found = ((*at, key) for (key,) in _rows(batches) for at in index.blocks(key))
        while rows := list(itertools.islice(found, 10_000)):
            yield _batch(rows, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(base, files)
        for at, group in itertools.groupby(_rows(batches), lambda r: r[:2]):
            rows, own = index.captures(*at)
            yield _batch([x for _, _, key in group for x in rows[bisect.bisect_left(own, key) : bisect.bisect_right(own, key)]], _CAPTURES)

    # a count of its own, for what tasks read is larger than the keys that they are dealt by
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = urls.select("url").mapInArrow(keys, "url_key string").distinct().repartitionByRange(parts, "url_key").sortWithinPartitions("url_key")
    found = named.mapInArrow(find, "file string, block int, url_key string")
    return stored(found.repartition(parts, "file", "block").sortWithinPartitions("file", "block", "url_key").mapInArrow(read, _CAPTURE), "found")


_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])


def read_records(captures: DataFrame, folder: str, payload: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri and payload of the captured records (a stored table); a damaged payload raises.

    Of revisits bytes and digest are those of the response, and the payload is null.
    """
    base = _uri(folder)
    spark = captures.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, rows, size = None, None, [], 0
        for file, place, length in _rows(batches):
            if file != name:
                name, f = file, _open(f"{base}/{file}", "r")
            fields, body = parse(f.read_at(length, place))
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"digest differs: {file} at {place}")
            page, ref = (x[len("<urn:page:") : -1] for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To", "<urn:page:>")))
            full = kind == "response"
            rows.append((int(page) if page else None, len(body) if full else None, digest, kind, int(ref) if ref else None, fields["WARC-Target-URI"], body if full and payload else None))
            size += 200 + (len(body) if payload else 0)
            if size >= BATCH:
                yield _batch(rows, _RECORD)
                rows, size = [], 0
        yield _batch(rows, _RECORD)

    parts = max(-(-(captures.agg(F.sum("length")).first()[0] or 0) // read_bytes), spark.sparkContext.defaultParallelism)
    ordered = captures.select("file", "place", "length").repartitionByRange(parts, F.col("file"), F.col("place")).sortWithinPartitions("file", "place")
    read = ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary")
    if not payload:
        read = read.drop("payload")
    read = stored(read, "records")
    response, revisit = read.where("record_type = 'response'"), read.where("record_type <> 'response'")
    wanted = revisit.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    known = response.select("page_id", "payload_digest", "payload_bytes").join(wanted, ["page_id", "payload_digest"], "left_semi").distinct()
    known = small_side(stored(known.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full_bytes")), "referred"))
    full = F.coalesce("full_bytes", F.raise_error(F.concat(F.lit("no response for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long"))
    resolved = revisit.drop("payload_bytes").join(known, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", full).select(read.columns)
    return response.unionByName(resolved)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), fresh_path(spark, "warc")
    files = write_index(write_archives(with_revisits(pages), folder), folder)
    return read_records(lookup(pages, folder, files), folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for op1_warc.
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {MIN_REVISIT} AND first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {MIN_REVISIT} AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
