"""Logical replication messages (pgoutput, protocol version 1): decoding, encoding, and folding into change events.

A message file holds whole transactions, in order: for each message its lsn (8 bytes),
length (4) and bytes.  Row messages name their table by the number that an earlier
Relation message gave it; relations of all files are gathered first (one per table
and change of its columns), so files are decoded side by side.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    oid: int
    schema: str
    name: str
    identity: str  # d default, n nothing, f full, i index
    columns: tuple[tuple[bool, str, int], ...]  # part of the key, name, type's oid


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        got = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def values(self) -> list:
        """A row's values: text, None, or ... for a value that was not sent."""
        out = []
        for _ in range(self.take("H")):
            kind = self.take("c")
            if kind == b"n":
                out.append(None)
            elif kind == b"u":
                out.append(...)
            else:
                n = self.take("I")
                out.append(self.data[self.at : self.at + n].decode())
                self.at += n
        return out


def decode(message: bytes) -> dict:
    """A message as a dictionary; kind is one of begin, commit, relation, insert, update, delete, truncate, stream_start, other."""
    b = _Bytes(message)
    kind = b.take("c")
    if kind == b"B":
        lsn, micros, xid = b.take("QqI")
        return {"kind": "begin", "lsn": lsn, "micros": micros, "xid": xid}
    if kind == b"C":
        _, lsn, end, micros = b.take("BQQq")
        return {"kind": "commit", "lsn": lsn, "end": end, "micros": micros}
    if kind == b"R":
        oid = b.take("I")
        schema, name, identity = b.text(), b.text(), b.take("c").decode()
        columns = []
        for _ in range(b.take("H")):
            part = b.take("B")
            column = b.text()
            oid_of, _ = b.take("Ii")
            columns.append((part == 1, column, oid_of))
        return {"kind": "relation", "relation": Relation(oid, schema, name, identity, tuple(columns))}
    if kind in (b"I", b"U", b"D"):
        oid, old, which, new = b.take("I"), None, None, None
        tag = b.take("c")
        if tag in (b"K", b"O"):
            which, old = tag.decode(), b.values()
            tag = b.take("c") if kind == b"U" else None
        if tag == b"N":
            new = b.values()
        return {"kind": {b"I": "insert", b"U": "update", b"D": "delete"}[kind], "oid": oid, "old": old, "which": which, "new": new}
    if kind == b"T":
        n, options = b.take("IB")
        return {"kind": "truncate", "cascade": bool(options & 1), "restart": bool(options & 2), "oids": [b.take("I") for _ in range(n)]}
    if kind == b"S":
        xid, first = b.take("IB")
        return {"kind": "stream_start", "xid": xid, "first": first == 1}
    return {"kind": "other", "tag": kind.decode("latin1")}


def _values(row: list) -> bytes:
    out = [struct.pack(">H", len(row))]
    for v in row:
        out.append(b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">I", len(str(v).encode())) + str(v).encode())
    return b"".join(out)


def begin(lsn: int, xid: int = 1, micros: int = 0) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, micros, xid)


def commit(lsn: int, micros: int = 0) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, lsn + 1, micros)


def relation(r: Relation) -> bytes:
    columns = b"".join(struct.pack(">B", part) + name.encode() + b"\0" + struct.pack(">Ii", oid, -1) for part, name, oid in r.columns)
    return b"R" + struct.pack(">I", r.oid) + r.schema.encode() + b"\0" + r.name.encode() + b"\0" + r.identity.encode() + struct.pack(">H", len(r.columns)) + columns


def insert(oid: int, new: list) -> bytes:
    return b"I" + struct.pack(">I", oid) + b"N" + _values(new)


def update(oid: int, new: list, old: list | None = None, which: str = "K") -> bytes:
    return b"U" + struct.pack(">I", oid) + (which.encode() + _values(old) if old is not None else b"") + b"N" + _values(new)


def delete(oid: int, old: list, which: str = "K") -> bytes:
    return b"D" + struct.pack(">I", oid) + which.encode() + _values(old)


def truncate(oids: list[int]) -> bytes:
    return b"T" + struct.pack(">IB", len(oids), 0) + b"".join(struct.pack(">I", o) for o in oids)


def to_file(messages: list[tuple[int, bytes]]) -> bytes:
    return b"".join(struct.pack(">QI", lsn, len(m)) + m for lsn, m in messages)


def from_file(data: bytes | memoryview) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        lsn, n = struct.unpack_from(">QI", data, at)
        yield lsn, bytes(data[at + 12 : at + 12 + n])
        at += 12 + n


def pieces(file, size: int = 4 << 20) -> Iterator[bytes]:
    """An open message file in pieces of whole transactions, of about size bytes or one transaction."""
    rest, at, end = bytearray(), 0, 0
    while chunk := file.read(size):
        rest += chunk
        while at + 12 <= len(rest):
            (n,) = struct.unpack_from(">I", rest, at + 8)
            if at + 12 + n > len(rest):
                break
            commits = rest[at + 12 : at + 13] == b"C" and n > 0
            at += 12 + n
            if commits:
                end = at
        if end:
            yield bytes(rest[:end])
            del rest[:end]
            at, end = at - end, 0
    if rest:
        yield bytes(rest)


def _contents(b: pa.RecordBatch) -> Iterator[memoryview]:
    """Files of a batch one by one, where they lie."""
    for data in b.column("content"):
        yield memoryview(data.as_buffer())


_EVENT = pa.schema([("table", pa.string()), ("lsn", pa.int64()), ("seq", pa.int32()), ("op", pa.string()), ("key", pa.string()), ("old_key", pa.string()), ("new", pa.map_(pa.string(), pa.string())), ("unchanged", pa.list_(pa.string()))])
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20  # decoded events leave in batches of so many, whatever their file's size
EVENT = "table string, lsn long, seq int, op string, key string, old_key string, new map<string,string>, unchanged array<string>"


def relations_of(files: DataFrame) -> list[tuple[int, Relation]]:
    """(lsn, relation) of all Relation messages in files (content); one per table and change of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {}
            for data in _contents(b):
                for lsn, m in from_file(data):
                    if m[:1] == b"R":
                        found[m] = min(lsn, found.get(m, lsn))
            yield pa.RecordBatch.from_arrays([pa.array(found.values(), pa.int64()), pa.array(found.keys(), pa.binary())], ["lsn", "message"])

    rows = files.select("content").mapInArrow(run, "lsn long, message binary").groupBy("message").agg(F.min("lsn").alias("lsn")).orderBy("lsn").collect()
    return [(r.lsn, decode(bytes(r.message))["relation"]) for r in rows]


def events(files: DataFrame, known: list[tuple[int, Relation]]) -> DataFrame:
    """Change events of message files (column content): rows of a transaction have its commit lsn, seq counts them.

    op is I, U, D or T (truncate, without a row).  key is the text of the key columns,
    joined by commas where there are several; new has the sent columns as text.
    """
    by_oid: dict[int, list[tuple[int, Relation]]] = {}
    for lsn, r in known:
        by_oid.setdefault(r.oid, []).append((lsn, r))

    def at(oid: int, lsn: int) -> Relation:
        if oid not in by_oid:
            raise ValueError(f"no relation message for table {oid}")
        return max(((x, r) for x, r in by_oid[oid] if x <= lsn), key=lambda x: x[0], default=by_oid[oid][0])[1]

    def one(data: memoryview) -> Iterator[tuple[int, tuple]]:
        """Events with the bytes of their messages."""
        commit_lsn, seq = 0, 0
        for lsn, raw in from_file(data):
            m = decode(raw)
            if m["kind"] == "begin":
                commit_lsn, seq = m["lsn"], 0
            elif m["kind"] == "truncate":
                for oid in m["oids"]:
                    r = at(oid, lsn)
                    yield len(raw), (f"{r.schema}.{r.name}", commit_lsn, seq, "T", None, None, [], [])
                    seq += 1
            elif m["kind"] in ("insert", "update", "delete"):
                r = at(m["oid"], lsn)
                parts = [i for i, c in enumerate(r.columns) if c[0]] or list(range(len(r.columns)))
                key_of = lambda row: None if row is None else ",".join("" if row[i] is None or row[i] is ... else row[i] for i in parts)  # noqa: E731, B023
                new, old = m["new"], m["old"]
                key = key_of(new if new is not None else old)
                moved = key_of(old) if m["kind"] == "update" and old is not None else None
                sent = [(c[1], v) for c, v in zip(r.columns, new or [], strict=False) if v is not ...]
                yield len(raw), (f"{r.schema}.{r.name}", commit_lsn, seq, m["kind"][0].upper(), key, moved, sent, [c[1] for c, v in zip(r.columns, new or [], strict=False) if v is ...])
                seq += 1

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _EVENT.types, strict=True)], schema=_EVENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for data in _contents(b):
                for n, row in one(data):
                    rows.append(row)
                    held += n
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return files.select("content").mapInArrow(run, EVENT)
