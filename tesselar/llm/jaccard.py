"""N-gram Jaccard join: size-banded tiles, hashed bitmap bounds, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (of the
whole word sequence if it has fewer words).  Two sets link when 100 * shared >=
75 * union.  No link between different sets is lost:

* Equal sets form a class; one row stands for it, and everything below is between
  classes, known by a row number.
* Groups of near copies become connected first, at a cost in proportion to their
  size: members of a bucket (equal least hash under one of MINS orders) meet a pivot
  only, for ROUNDS rounds; pivots go by a hash, so buckets agree on them.
* Prefix.  In one global order of shingles, linked sets share a shingle within
  their first n - ceil(0.75 n) + 1.  The order is by hash, with shingles that many
  texts have at its end, so shared passages rarely get into a prefix.  Any order
  gives the same links; this one keeps candidate lists short.  Prefixes are kept as
  48 bits a shingle and meet as sorted blocks of differences (see _shared_places):
  most shingles stand in one prefix only and go no further.  Of the others those
  that classes of different components have are followed.
* Tiles.  A tile holds the prefix places of one shingle and one size band (sizes
  within a factor 4/3, so linked sets lie in the same or neighbouring bands).
  Its members first meet PIVOTS pivots; then those of short lists that are still
  not connected meet each other by a join, those of long lists as matrices of
  bitmaps, of which only pairs within the bound become rows.
* Bound.  Parity bitmaps of one to two bits per shingle: the bits that differ bound
  the shared shingles from above, pairs that cannot reach the threshold go.
* The rest is decided by intersecting the sorted arrays.

Lists are counted by aggregations that combine before they shuffle, and met by
joins, which can split a hot key; no shingle's whole list has to fit one task.

Edge cases: null and empty texts, and texts of white space, have an empty set and
link with nothing.  A null id gets a null component and links with nothing.  Rows of
equal id and text get equal results; rows of equal id and different texts are told
apart.  Long texts are read whole; an empty table gives no rows.  Ids of any type
pass through unchanged.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, short_jobs, small_batches, small_side, stored, table, whole_partitions
from .graph import merged
from .words import binary_parts, mix, text_chunks, word_hashes

K = 5
PERCENT = 75
#: Shingles that at least so many texts have (as counted in batches) go to the end of the order, at most HEAVY_MOST of them.
HEAVY = 64
HEAVY_MOST = 300_000
MINS, ROUNDS, PIVOTS = 6, 2, 2
#: Members from which a shingle's list is compared as matrices of bitmaps, in blocks of BLOCK.
LARGE, BLOCK = 32, 2048
GROUP_BYTES = 8 << 20
#: Leaves that meet a hub's set in one group.
GROUP = 200
FLUSH = 500_000
#: Bytes of a prefix place, and places of a range in which they meet.  Of one shingle a batch sends OFTEN places to the range.
PLACE, RANGE, OFTEN = 6, 1 << 20, 16

_rng = np.random.default_rng(20240501)
_PLACE = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _rng.integers(1, 2**63, K + 1, dtype=np.uint64)
_SEEDS = [0, *_rng.integers(1, 2**62, ROUNDS + PIVOTS - 1).tolist()]
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ORDER = _rng.integers(1, 2**63, MINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: bytes, at: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk (see text_chunks)."""
    words, first = word_hashes(data, at)
    n = max(0, len(words) - K + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(K):
        runs += words[j : j + n] * _PLACE[j]
    runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= K:
            s = np.sort(runs[a : b - K + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            yield mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _SHORT[b - a])
        else:
            yield np.zeros(0, np.uint64)


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def least_shared(n: int) -> int:
    """Shingles that a set of n must share with any set it links with."""
    return -(-PERCENT * n // 100)


def bitmap(values: np.ndarray) -> bytes:
    """Parity of the values on each of one to two bits per value (a power of two, 64 at least)."""
    bits = max(64, 1 << (len(values) - 1).bit_length()) if len(values) else 64
    return np.packbits(np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def most_shared(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """Upper bound of the shared shingles: sets that differ in d places differ in at most d bits of equal parity bitmaps."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x.reshape(2, -1)[0] ^ x.reshape(2, -1)[1]
    while len(y) > len(x):
        y = y.reshape(2, -1)[0] ^ y.reshape(2, -1)[1]
    return min(n_a, n_b, (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2)


def _packed(values: np.ndarray) -> bytes:
    """PLACE bytes of each value; which shingles share them is all that a prefix has to tell, so a rare clash gives a pair too many and never loses one."""
    return (values * _SPREAD).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - PLACE :].tobytes()


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // PLACE, 8), np.uint8)
    out[:, :PLACE] = raw.reshape(-1, PLACE)
    return out.view("<u8")[:, 0]


def _planes(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, all first bytes first: Spark's compression then finds the empty ones."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _heavy(slim: DataFrame) -> np.ndarray:
    """Shingles that many texts have, sorted.  Every text is counted; within a batch only those seen twice are passed on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], ["s", "n"])

        for b in batches:
            for _, _, data, at in text_chunks(b.column("text")):
                for s in shingle_sets(data, at):
                    held.append(s)
                    size += len(s)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    many = slim.select("text").mapInArrow(in_worker("jaccard", count), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= HEAVY)
    got = many.orderBy(F.desc("n"), "s").limit(HEAVY_MOST).toPandas()["s"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def _signed(slim: DataFrame, heavy: np.ndarray) -> DataFrame:
    """id, key, n, fp (128-bit digest of the set), bits, mins and prefix of every row."""
    held = slim.sparkSession.sparkContext.broadcast(heavy)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = held.value
        for b in batches:
            for a, z, data, at in text_chunks(b.column("text")):
                n, fp, bits, mins, prefix = [], [], [], [], []
                for s in shingle_sets(data, at):
                    n.append(len(s))
                    fp.append(_digest(s.tobytes()))
                    bits.append(bitmap(s))
                    mins.append((s[:, None] * _ORDER).min(axis=0).view(np.int64) if len(s) else np.zeros(MINS, np.int64))
                    take = len(s) - least_shared(len(s)) + 1 if len(s) else 0
                    if len(heavy) and take:
                        last = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                        s = np.concatenate([s[~last][:take], s[last][:take]])
                    prefix.append(_packed(s[:take]))
                mins = pa.ListArray.from_arrays(pa.array(np.arange(0, MINS * (z - a) + 1, MINS), pa.int32()), pa.array(np.concatenate(mins)))
                yield pa.RecordBatch.from_arrays([b.column("id").slice(a, z - a), b.column("key").slice(a, z - a), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(bits, pa.binary()), mins, pa.array(prefix, pa.binary())], ["id", "key", "n", "fp", "bits", "mins", "prefix"])

    kind, key = (slim.schema[c].dataType.simpleString() for c in ("id", "key"))
    return slim.mapInArrow(in_worker("jaccard", sign), f"id {kind}, key {key}, n int, fp binary, bits binary, mins array<long>, prefix binary")


def _verified(pairs: DataFrame, reps: DataFrame, slim: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, as (u, v)."""
    pairs = stored(pairs, "pairs")
    with short_jobs(slim.sparkSession):
        return _linked(pairs, reps, slim)


def _linked(pairs: DataFrame, reps: DataFrame, slim: DataFrame) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    info = stored(reps.select("node", "n", "bits", "id", "fp").join(small_side(nodes), "node"), "info")
    known, sizes = small_side(info.select("node", "bits")), small_side(info.select("node", "n"))
    with_size = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    with_bits = lambda x: known.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}"))

    @F.pandas_udf("boolean")
    def may_link(n_a: pd.Series, x: pd.Series, n_b: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([100 * (m := most_shared(p, i, q, j)) >= PERCENT * (i + j - m) for i, p, j, q in zip(n_a, x, n_b, y, strict=True)], dtype=bool)

    size = lambda x: F.col(f"n_{x}") * 100 >= F.col(f"n_{'b' if x == 'a' else 'a'}") * PERCENT
    left = pairs.join(with_size("a"), "a").join(with_size("b"), "b").where(size("a") & size("b"))
    left = left.join(with_bits("a"), "a").join(with_bits("b"), "b").where(may_link("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")
    left = stored(left, "bounded")

    # of a pair the set of the leaf, the class of fewer pairs, travels to that of the hub; a hub of many pairs is dealt over groups of about GROUP leaves
    ends = [left.groupBy(F.col(x).alias("node")).agg(F.count(F.lit(1)).alias("deg")) for x in ("a", "b")]
    degree = small_side(stored(ends[0].union(ends[1]).groupBy("node").agg(F.sum("deg").alias("deg")), "degree"))
    of = lambda x: degree.select(F.col("node").alias(x), F.col("deg").alias(f"deg_{x}"))
    turned = F.col("deg_a") < F.col("deg_b")
    one = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    star = left.join(of("a"), "a").join(of("b"), "b").select(one("a", "b").alias("hub"), one("b", "a").alias("leaf"), F.ceil(F.greatest("deg_a", "deg_b") / GROUP).alias("salts"), F.ceil(F.least("deg_a", "deg_b") / GROUP).alias("parts"))
    star = stored(star.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.col("salts")).cast("int")), "star")
    leaves = star.groupBy(F.col("leaf").alias("node"), F.pmod(F.xxhash64("hub"), F.col("parts"))).agg(F.collect_list(F.struct("hub", "salt", "leaf")).alias("to")).select("node", "to")
    hubs = star.select(F.col("hub").alias("node"), "salts").distinct().select("node", F.transform(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")), lambda k: F.struct(F.col("node").alias("hub"), k.alias("salt"), F.lit(None).cast("long").alias("leaf"))).alias("to"))
    # texts are known by id, sets by their digest: a text that shares its id with a wanted one has another digest
    need = small_side(info.select("node", "id", "fp").join(leaves.unionByName(hubs), "node").select("id", "fp", "to"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, at in text_chunks(b.column("text")):
                out = []
                wanted = zip(b.column("fp").slice(a, z - a).to_pylist(), b.column("to").slice(a, z - a).to_pylist(), strict=True)
                for s, (fp, to) in zip(shingle_sets(data, at), wanted, strict=True):
                    raw = s.tobytes()
                    if _digest(raw) == fp:
                        out += [(x["hub"], x["salt"], x["leaf"], raw) for x in to]
                columns = zip(*out, strict=True) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["hub", "salt", "leaf", "s"])

    def meet(t: pa.Table) -> pa.Table:
        hub, leaf, raw = t.column("hub")[0].as_py(), t.column("leaf").to_pylist(), t.column("s")
        own = np.frombuffer(raw[leaf.index(None)].as_py(), np.uint64)
        found = []
        for i, x in enumerate(leaf):
            if x is not None and len(own):
                s = np.frombuffer(raw[i].as_py(), np.uint64)
                m = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if len(s) and 100 * m >= PERCENT * (len(own) + len(s) - m):
                    found.append(x)
        return pa.table({"u": pa.array([hub] * len(found), pa.int64()), "v": pa.array(found, pa.int64())})

    sets = slim.select("id", "text").join(need, "id").select("text", "fp", "to").mapInArrow(in_worker("jaccard", send), "hub long, salt int, leaf long, s binary")
    return stored(sets.groupBy("hub", "salt").applyInArrow(meet, "u long, v long").distinct(), "links")


def _pivot_pairs(p: DataFrame, tile: list[str], seeds: list[int], roots: DataFrame | None) -> DataFrame:
    """Each member of a tile with the tile's pivots, where they are not yet connected; a pivot is the member that is smallest when the seed's bits are turned over."""
    pivots = F.array(*(F.min(F.col("node").bitwiseXOR(F.lit(s))).bitwiseXOR(F.lit(s)) for s in seeds))
    tiles = p.groupBy(*tile).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pivots.alias("ps")).where("lo <> hi").drop("lo", "hi")
    tiles = small_side(stored(tiles, "pivots"))
    met = p.join(tiles, tile).select("node", "root", F.explode(F.array_distinct("ps")).alias("pivot")).where("pivot <> node").distinct()
    if roots is not None:
        met = met.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("r")), "pivot", "left").where(F.coalesce("r", "pivot") != F.col("root"))
    return met.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()


def _rooted(p: DataFrame, roots: DataFrame) -> DataFrame:
    """p with `root`, the smallest class of the component that a class lies in so far."""
    return p.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _matrix_pairs(n: np.ndarray, roots: np.ndarray, block: np.ndarray, bits: list[bytes], across: bool) -> list[np.ndarray]:
    """Pairs of places of a tile that are not connected and whose bitmaps let them link; across: of different blocks only."""
    size = np.array([len(b) for b in bits])
    out = []
    for width in np.unique(size).tolist():
        rows = np.flatnonzero(size == width)
        x = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), -1)
        for other in (width, 2 * width):
            cols = np.flatnonzero(size == other)
            if not len(cols):
                continue
            y = np.frombuffer(b"".join(bits[i] for i in cols), np.uint64).reshape(len(cols), -1)
            if other != width:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, (1 << 20) // max(1, y.size))
            for at in range(0, len(rows), step):
                i = rows[at : at + step]
                differ = np.bitwise_count(x[at : at + step, None, :] ^ y[None]).sum(axis=2, dtype=np.int64)
                total = n[i][:, None] + n[cols][None]
                shared = np.minimum((total - differ) // 2, np.minimum(n[i][:, None], n[cols][None]))
                ok = (100 * shared >= PERCENT * (total - shared)) & (roots[i][:, None] != roots[cols][None])
                if across:
                    ok &= block[i][:, None] != block[cols][None]
                if other == width:
                    ok &= i[:, None] < cols[None]
                p, q = np.nonzero(ok)
                out.append(np.stack([i[p], cols[q]], axis=1))
    return out


def _blocks(node: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int, int, bool, bytes, bytes]]:
    """(part, salt, base, sure, t, row) of places: those of one range by t, rows numbered from base.

    Those that are sure to be shared have a salt, so that a range's groups are many.
    """
    base = node >> 32
    order = np.lexsort((t, base))
    node, t, base = node[order], t[order], base[order]
    first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (base[1:] != base[:-1])))
    nth = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    for sure in (False, True):
        take = (nth >= OFTEN) == sure
        if not take.any():
            continue
        n, x, b = node[take], t[take], base[take]
        part = (x >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (b[1:] != b[:-1]))).tolist()
        for i, j in zip(cut, [*cut[1:], len(x)], strict=True):
            steps = np.diff(x[i:j] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0))
            yield int(part[i]), int(n[i]) if sure else -1, int(b[i]), sure, _planes(steps), _planes(n[i:j] & 0xFFFFFFFF)


def _shared_places(reps: DataFrame) -> DataFrame:
    """t and node of the prefix places whose t (the top bits of a packed shingle) another class has too.

    Most shingles stand in one prefix only.  They meet by ranges of t, as sorted blocks of
    differences and rows that take some 5 bytes a place; of a t that a batch holds more
    than OFTEN times its range gets OFTEN places, the others need no answer and are dealt
    elsewhere, so a frequent shingle burdens no range.
    """
    total = reps.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    ranges = min(8 * PLACE - 32, max(8, (total // PLACE // RANGE).bit_length()))  # bits of their number

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, values, size = [], [], 0

        def out() -> pa.RecordBatch:
            columns = zip(*_blocks(np.concatenate(nodes), np.concatenate(values)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["part", "salt", "base", "sure", "t", "row"])

        for b in batches:
            data, at = binary_parts(b.column("prefix"))
            values.append(_unpacked(data) >> np.uint64(8 * PLACE - 32 - ranges))
            nodes.append(np.repeat(b.column("node").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at) // PLACE))
            size += len(nodes[-1])
            if size > FLUSH:
                yield out()
                nodes, values, size = [], [], 0
        if size:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        part, sure = table.column("part")[0].as_py(), table.column("sure")[0].as_py()
        t = np.concatenate([np.cumsum(_unplaned(x.as_py()), dtype=np.uint64) for x in table.column("t")])
        node = np.concatenate([_unplaned(x.as_py()).astype(np.int64) + (b.as_py() << 32) for x, b in zip(table.column("row"), table.column("base"), strict=True)])
        if not sure:
            order = np.argsort(t, kind="stable")
            t, node = t[order], node[order]
            same = t[1:] == t[:-1]
            several = np.append(same, False) | np.append(False, same)
            t, node = t[several], node[several]
        return pa.table({"t": pa.array(t.astype(np.int64) + (part << 32)), "node": pa.array(node)})

    met = reps.select("node", "prefix").mapInArrow(in_worker("jaccard", pack), "part int, salt long, base long, sure boolean, t binary, row binary")
    return met.groupBy("part", "salt").applyInArrow(meet, "t long, node long")


def _tile_pairs(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of long lists: a tile holds one list, or two blocks of it, and is compared as matrices; only pairs within the bound become rows."""
    # lists of one smallest member go to one group, which gives a pair once; GROUP_BYTES and more of them are dealt to several by shingle
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = rows.withColumn("k", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = stored(rows.withColumn("lo", F.least("k", "j")).withColumn("hi", F.greatest("k", "j")), "blocks")
    size = F.greatest(F.lit(64.0), F.pow(F.lit(2.0), F.ceil(F.log2("n")))) / 8 + 64  # of a row with its bitmap
    weight = rows.groupBy("least").agg(F.sum(size).alias("size"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((weight.agg(F.sum("size")).first()[0] or 0) // GROUP_BYTES) + 1)
    rows = rows.join(small_side(weight.select("least", F.ceil(F.col("size") / GROUP_BYTES).alias("salts"))), "least")
    rows = rows.withColumn("g", F.pmod(F.xxhash64("least", "lo", "hi", F.pmod(F.xxhash64("t"), F.col("salts"))), F.lit(parts))).drop("least", "salts")
    wanted = small_side(rows.select("node").distinct())
    rows = rows.join(stored(reps.select("node", "bits").join(wanted, "node"), "bits"), "node")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), np.int64)]
        for (_, lo, hi), tile in b.groupby(["t", "lo", "hi"], sort=False):
            nodes = tile["node"].to_numpy()
            out += [nodes[x] for x in _matrix_pairs(tile["n"].to_numpy(np.int64), tile["root"].to_numpy(), tile["k"].to_numpy(), tile["bits"].tolist(), lo != hi)]
        got = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    return rows.groupBy("g").applyInPandas(compare, "a long, b long")


def _components(reps: DataFrame, slim: DataFrame) -> DataFrame:
    """node and root of the classes whose component has a smaller class."""
    p = reps.select("node", F.posexplode("mins").alias("j", "t")).withColumn("root", F.col("node"))
    roots = None
    for r in range(ROUNDS):
        roots = merged(roots, _verified(_pivot_pairs(p, ["j", "t"], _SEEDS[r : r + 1], roots), reps, slim))
        p = _rooted(p, roots)

    # shingles that different components have in their prefixes; a list of two is its smallest and largest member
    shared = stored(_shared_places(reps), "shared")
    lists = _rooted(shared, roots).groupBy("t").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("c"))
    lists = stored(lists.where("lo <> hi").select("t", "a", "b", "c"), "lists")
    pairs = lists.where("c = 2").select("a", "b").distinct()
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int").alias("band")
    places = shared.join(small_side(lists.where("c > 2").select("t")), "t")
    places = stored(_rooted(places.join(reps.select("node", "n"), "node"), roots).select("t", "node", "n", "root", band), "places")
    pairs = pairs.union(_pivot_pairs(places, ["t", "band"], _SEEDS[ROUNDS:], roots))
    roots = merged(roots, _verified(pairs.distinct(), reps, slim))

    p = _rooted(places, roots)
    lists = p.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("node").alias("c"), F.min("node").alias("least")).where("lo <> hi").select("t", "c", "least")
    p = stored(p.join(small_side(stored(lists, "lists")), "t").select("t", "node", "n", "root", "band", "c", "least"), "open")
    large_pairs = _tile_pairs(p.where(F.col("c") > LARGE), reps)
    p = p.where(F.col("c") <= LARGE)
    small = p.select("t", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    large = p.select("t", "band", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    open_pairs = large.join(small, ["t", "band"]).where((F.col("root_a") != F.col("root_b")) & (F.struct("n_a", "a") > F.struct("n_b", "b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a")))
    return merged(roots, _verified(open_pairs.select("a", "b").union(large_pairs).distinct(), reps, slim))


def _rows(docs: DataFrame, id_col: str, text_col: str, key) -> DataFrame:
    """row (a number of its own), id, key, n, node (the class; null for rows without id or words), low (smallest id of the component) and first (the first row that has it)."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    signed = stored(_signed(slim, _heavy(slim)).withColumn("row", F.monotonically_increasing_id()), "signed")
    known = signed.where("id is not null and n > 0")
    with whole_partitions(docs.sparkSession):
        classes = stored(known.groupBy("fp").agg(F.min("row").alias("node")), "classes")
        of_row = stored(known.select("row", "id", "fp").join(classes, "fp").select("row", "id", "node"), "rows")
        reps = known.join(small_side(of_row.where("row <> node").select("row")), "row", "left_anti").withColumnRenamed("row", "node")
        of_row = stored(of_row.join(_components(reps, slim), "node", "left").withColumn("root", F.coalesce("root", "node")), "rows")
    lows = of_row.groupBy("root").agg(F.min("id").alias("low"))
    firsts = of_row.join(lows, "root").where("id = low").groupBy("root").agg(F.min("row").alias("first"))
    of_row = of_row.join(lows, "root").join(firsts, "root").select("row", "node", "low", "first")
    return signed.select("row", "id", "key", "n").join(of_row, "row", "left")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links) and class_id (a number that rows of equal sets share; null without words or id) of every row."""
    rows = _rows(docs, id_col, text_col, F.lit(None).cast("string"))
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"), F.col("node").alias("class_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the first that has its smallest id; columns stay.

    Rows without words or id all stay.  Rows are known by id and text: of rows that
    repeat the kept one in both, one stays; a row of its id and another text is
    judged by its own text.
    """
    text = F.md5(F.col(text_col).cast("binary"))
    rows = stored(_rows(docs, id_col, text_col, text).where("node is not null").select("row", "first", F.col("id").alias("__id"), F.col("key").alias("__text")), "found")
    chosen = rows.where("row = first").select("__id", "__text")
    drop = rows.where("row <> first").select("__id", "__text").distinct().join(chosen, ["__id", "__text"], "left_anti")
    again = rows.join(chosen, ["__id", "__text"]).groupBy("__id", "__text").count().where("count > 1").drop("count")
    sides = [small_side(stored(x, "keys")) for x in (drop, again)]
    on = [docs[id_col] == F.col("__id"), text == F.col("__text")]
    kept = docs.join(sides[0], on, "left_anti")
    if not again.limit(1).count():
        return kept
    return kept.join(sides[1], on, "left_anti").unionByName(kept.join(sides[1], on, "left_semi").dropDuplicates([id_col, text_col]))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")
