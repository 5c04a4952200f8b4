"""Partition functions: value -> shard number, as Column expressions.

The hash functions agree with PostgreSQL's hash partitioning (Jenkins' lookup3
with the partition seed), so rows land where `PARTITION BY HASH` puts them.
32-bit arithmetic is done on BIGINT with a mask; nothing overflows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of PostgreSQL's hash partitioning.
SEED = 0x7A5B22367996DCFD
INITIAL = 0x9E3779B9 + 3923095
COMBINE = 0x49A0F4DD15E5A8E3
# lookup3: (target, source, rotation) of the mixing and of the final steps.
MIX = (("a", "c", 4, "b"), ("b", "a", 6, "c"), ("c", "b", 8, "a"), ("a", "c", 16, "b"), ("b", "a", 19, "c"), ("c", "b", 4, "a"))
FINAL = (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24))

_M = 0xFFFFFFFF


def _rot(x, k):
    return ((x << k) | (x >> (32 - k))) & _M


def _mix(s: dict) -> dict:
    for t, minus, k, plus in MIX:
        s[t] = ((s[t] - s[minus]) & _M) ^ _rot(s[minus], k)
        s[minus] = (s[minus] + s[plus]) & _M
    return s


def _final(s: dict) -> dict:
    for t, other, k in FINAL:
        s[t] = ((s[t] ^ s[other]) - _rot(s[other], k)) & _M
    return s


def _seeded(length: int) -> dict:
    a = (INITIAL + length) & _M
    return _mix({"a": (a + (SEED >> 32)) & _M, "b": (a + (SEED & _M)) & _M, "c": a})


def hash_bytes(data: bytes) -> int:
    """Seeded 64-bit hash of bytes."""
    s = _seeded(len(data))
    at = 0
    while len(data) - at >= 12:
        for j, n in enumerate("abc"):
            s[n] = (s[n] + int.from_bytes(data[at + 4 * j : at + 4 * j + 4], "little")) & _M
        s = _mix(s)
        at += 12
    tail = data[at:]
    # the lowest byte of c is left to the length
    for n, part in (("a", tail[:4]), ("b", tail[4:8]), ("c", b"\0" + tail[8:] if len(tail) > 8 else b"")):
        s[n] = (s[n] + int.from_bytes(part, "little")) & _M
    s = _final(s)
    return s["b"] << 32 | s["c"]


def hash_int(value: int) -> int:
    low, high = value & _M, (value >> 32) & _M
    s = _seeded(4)
    s["a"] = (s["a"] + (low ^ (high if value >= 0 else high ^ _M))) & _M
    s = _final(s)
    return s["b"] << 32 | s["c"]


def shard_of_hash(h: int, shards: int) -> int:
    return ((h + COMBINE) & 0xFFFFFFFFFFFFFFFF) % shards


def shard_of(value, kind: str, shards: int, function: str = "hash") -> int:
    """Shard of a literal at plan time."""
    if function == "sha1":
        raw = uuid.UUID(str(value)).bytes if kind == "uuid" else str(value).encode()
        return int.from_bytes(hashlib.sha1(raw).digest()[-4:], "big") % shards
    if kind == "bigint":
        return shard_of_hash(hash_int(int(value)), shards)
    return shard_of_hash(hash_bytes(uuid.UUID(str(value)).bytes if kind == "uuid" else str(value).encode()), shards)


def _modulo(high: Column, low: Column, shards: int) -> Column:
    """(high * 2^32 + low) % shards of unsigned halves, without overflow."""
    return (((high % shards) * ((1 << 32) % shards) + low % shards) % shards).cast("int")


def _combined(b: Column, c: Column, shards: int) -> Column:
    low = c + (COMBINE & _M)
    high = (b + (COMBINE >> 32) + F.shiftright(low, 32)).bitwiseAND(_M)
    return _modulo(high, low.bitwiseAND(_M), shards)


def _final_step(t: str, other: str, k: int):
    def step(s: Column) -> Column:
        turned = F.shiftleft(s[other], k).bitwiseOR(F.shiftrightunsigned(s[other], 32 - k)).bitwiseAND(_M)
        new = (s[t].bitwiseXOR(s[other]) - turned).bitwiseAND(_M)
        return F.struct(*((new if n == t else s[n]).alias(n) for n in "abc"))

    return step


def hash_bigint(key: Column, shards: int) -> Column:
    """PostgreSQL hash partition of a BIGINT; one projection of integer steps, null for null.

    The steps are chained through nested single-element transforms, so each one is
    worked out once although the next uses it several times.
    """
    key = key.cast("long")
    start = _seeded(4)
    low, high = key.bitwiseAND(_M), F.shiftrightunsigned(key, 32).bitwiseAND(_M)
    folded = low.bitwiseXOR(F.when(key >= 0, high).otherwise(high.bitwiseXOR(F.lit(_M))))
    state = F.struct((folded + start["a"]).bitwiseAND(_M).alias("a"), F.lit(start["b"]).cast("long").alias("b"), F.lit(start["c"]).cast("long").alias("c"))
    cell = F.array(state)
    for step in FINAL:
        cell = F.transform(cell, _final_step(*step))
    out = F.element_at(F.transform(cell, lambda s: _combined(s["b"], s["c"], shards)), 1)
    return F.when(key.isNotNull(), out)


def _hash_many(values: Iterable[bytes | None], shards: int) -> list[int | None]:
    """Shards of byte strings; those of equal length are hashed together, as numpy vectors."""
    values = list(values)
    out: list[int | None] = [None] * len(values)
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            by_length.setdefault(len(v), []).append(i)
    for n, rows in by_length.items():
        data = np.frombuffer(b"".join(values[i] for i in rows), np.uint8).reshape(len(rows), n).astype(np.int64)
        s = {k: np.full(len(rows), v, np.int64) for k, v in _seeded(n).items()}
        word = lambda at, size: sum(data[:, at + j] << (8 * j) for j in range(size)) if size > 0 else 0
        at = 0
        while n - at >= 12:
            for j, name in enumerate("abc"):
                s[name] = (s[name] + word(at + 4 * j, 4)) & _M
            s = _mix(s)
            at += 12
        left = n - at
        s["a"] = (s["a"] + word(at, min(left, 4))) & _M
        s["b"] = (s["b"] + word(at + 4, min(max(left - 4, 0), 4))) & _M
        s["c"] = (s["c"] + (word(at + 8, max(left - 8, 0)) << 8)) & _M
        s = _final(s)
        low = s["c"] + (COMBINE & _M)
        high = (s["b"] + (COMBINE >> 32) + (low >> 32)) & _M
        for i, x in zip(rows, (((high % shards) * ((1 << 32) % shards) + (low & _M) % shards) % shards).tolist(), strict=True):
            out[i] = x
    return out


def hash_varchar(key: Column, shards: int) -> Column:
    """PostgreSQL hash partition of text: the length varies by row, so an Arrow batch is hashed with numpy."""

    @F.pandas_udf("int")
    def shard(values: pd.Series) -> pd.Series:
        return pd.Series(_hash_many((v.encode() if isinstance(v, str) else None for v in values), shards), dtype="Int32")

    return shard(key.cast("string"))


def hash_uuid(key: Column, shards: int) -> Column:
    """PostgreSQL hash partition of a UUID in text form."""

    @F.pandas_udf("int")
    def shard(values: pd.Series) -> pd.Series:
        return pd.Series(_hash_many((uuid.UUID(v).bytes if isinstance(v, str) else None for v in values), shards), dtype="Int32")

    return shard(key)


def sha1_shard(key: Column, shards: int, is_uuid: bool = False) -> Column:
    """The last four digest bytes, big-endian, modulo shards."""
    raw = F.unhex(F.regexp_replace(key, "-", "")) if is_uuid else key.cast("string").cast("binary")
    return (F.conv(F.right(F.sha1(raw), F.lit(8)), 16, 10).cast("long") % shards).cast("int")


def mapping_shard(key: Column, lists: Sequence[tuple[Sequence, int]] = (), ranges: Sequence[tuple] = (), default: int | None = None) -> Column:
    """List, then half-open ranges (None: open end, the first match wins), then default; null: no shard, that is all of them.

    Of a value listed twice the last shard holds.
    """
    where: dict = {}
    for values, shard in lists:
        where.update(dict.fromkeys(values, shard))
    out = None
    case = lambda cond, s: F.when(cond, F.lit(s)) if out is None else out.when(cond, F.lit(s))
    for shard in dict.fromkeys(where.values()):
        out = case(key.isin(*[v for v, s in where.items() if s == shard]), shard)
    for start, end, shard in ranges:
        cond = F.lit(True) & key.isNotNull()
        cond = cond if start is None else cond & (key >= F.lit(start))
        out = case(cond if end is None else cond & (key < F.lit(end)), shard)
    if default is not None:
        out = case(key.isNotNull(), default)
    return (out if out is not None else F.lit(None)).cast("int")


def default_probes(centroids: int) -> int:
    return math.ceil(math.sqrt(centroids))


def centroid_shards(vector: Column, centroids: Sequence[Sequence[float]], shards: int, probes: int | None = None) -> Column:
    """Sorted distinct shards of the nearest centroids (their index modulo shards); ties by index."""
    from .vector import l2

    probes = probes or default_probes(len(centroids))
    far = F.array(*(F.struct(l2(vector, F.array(*(F.lit(float(x)) for x in c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)))
    return F.array_sort(F.array_distinct(F.transform(F.slice(F.array_sort(far), 1, probes), lambda x: (x["i"] % shards).cast("int"))))


def schema_shard(schema: Column, shards: dict[str, int | None], catch_all: int | None = None) -> Column:
    """Shard of a schema name; None stands for all shards; a name of its own beats the catch-all."""
    out = F.lit(catch_all).cast("int")
    for name, shard in shards.items():
        out = F.when(schema == name, F.lit(shard).cast("int")).otherwise(out)
    return out


def guess_kind(value) -> tuple[str, object]:
    """bigint, else uuid, else varchar."""
    try:
        return "bigint", int(str(value))
    except ValueError:
        pass
    try:
        return "uuid", str(uuid.UUID(str(value)))
    except ValueError:
        return "varchar", str(value)
