"""Best-fit packing with certified bin counts.

Texts are tokenised, an end id is added, and documents of more than `width`
ids are cut into pieces of `width`; the first piece may be shorter.  Pieces of
full width are sequences of their own.  The others are dealt to partitions by a
hash of a number that each piece gets for itself, and each partition runs best-fit
decreasing.  A dual-feasible function gives a lower bound on the sequences that any
packing of a partition needs; a partition that meets its bound is certified.  From
partitions with a gap the pieces of the worst-filled sequences go to a pool, are dealt
anew (so partitions exchange documents) and packed again with best-fit decreasing, for
ROUNDS rounds.  Filled sequences never move again, so the pool shrinks and the last
round packs it as it is.  Each piece carries the certificate of the partition that
packed it: the sequences it kept and the bound for the pieces in them; where both are
equal, no packing of these pieces needs fewer.

Each round is a stored table: a lost executor repeats a task, not the job.
Sequence ids are numbers unique over the table; they have no further meaning.

Edge cases: null and empty texts give one piece, the end id.  Rows of equal doc_id,
repeated rows and rows without id are packed as rows of their own, each with its pieces;
pieces of equal length are packed in the order in which they come.  An empty table
gives no rows.  Long texts are cut into as many pieces as they need.  Ids of any type
pass through unchanged; only the id and text columns are read, whatever the others' names.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, small_batches, stored, table, worker_caches

WIDTH = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
ROUNDS = 2
#: Pieces dealt to one packing task.
PER_TASK = 60_000

_UNCOMMON = r"[^\n\x20-\x7e\xa1-\u024f]"


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The ids are those of `tokenizers`.  Texts of common characters (line end, ASCII,
    Latin letters), on which pre-tokenizers cannot differ, are encoded by `tiktoken`
    where the folder has the same vocabulary as ranks: it gives the same ids in a fifth
    of the time.  All other texts, and those that hold an added token such as the end
    mark, are encoded by `tokenizers`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.uncommon = re.compile("|".join([_UNCOMMON, *map(re.escape, added)]))
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = [line.split() for line in f if line.strip()]
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(t): int(n) for t, n in pairs}, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        rest = [i for i, t in enumerate(texts) if self.fast is None or self.uncommon.search(t)]
        for i, e in zip(rest, self.tok.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids).tobytes()
        skip = set(rest)
        for i, t in enumerate(texts):
            if i not in skip:
                out[i] = array("I", self.fast.encode_ordinary(t)).tobytes()
        return out


_NAMES, _TYPES = ["piece", "start", "length", "ids_crc32"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_COLUMNS = "piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, Encoder] = {}
worker_caches["packing"] = _encoders.clear


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str | None) -> Encoder:
    """One per Python worker; None: the installed vocabulary, looked up where the task runs."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what is left over."""
    first = n % width or min(n, width)
    return [(0, first)] + [(s, width) for s in range(first, n, width)]


def pieces(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = _encoder(path), np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for i, ids in enumerate(enc.encode([t or "" for t in b.column("text").to_pylist()])):
                ids += end
                rows += [(i, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, width))]
            row, *columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), *map(pa.array, columns, _TYPES)], ["id", *_NAMES])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(in_worker("packing", run), f"id {kind}, {_COLUMNS}")


def lower_bound(lengths: np.ndarray, width: int = WIDTH) -> int:
    """Sequences that any packing needs: the best of the dual-feasible functions u_t(x) = width if x > width - t, 0 if x < t, else x, for all t up to width/2."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=width + 1).astype(np.int64)
    size = np.arange(width + 1)
    n_from, mass = np.append(np.cumsum(count[::-1])[::-1], 0), np.append(0, np.cumsum(count * size))
    t = np.arange(0, width // 2 + 1)
    large = n_from[width - t + 1]
    middle = mass[width - t + 1] - mass[t]
    return int((large + -(-middle // width)).max())


def best_fit_decreasing(lengths: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the fill of each sequence.

    Sequences are kept by the room they have; a bit set of the rooms that occur
    gives the tightest one that is large enough.
    """
    seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    rooms = 0
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, k = width, len(fill)
            fill.append(0)
        seq[i], off[i] = k, fill[k]
        fill[k] += n
        if left := room - n:
            by_room[left].append(k)
            rooms |= 1 << left
    return seq, off, np.array(fill, dtype=np.int64)


def pack(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rounds: int = ROUNDS, per_task: int = PER_TASK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the certificate group_id, group_sequences, group_bound."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {_COLUMNS}, row long, seq long, offset long, full boolean, group_id long, sequences long, bound long"

    def task(last: bool, base: int):
        def run(key: tuple, b: pa.Table) -> pa.Table:
            lengths = b.column("length").to_numpy().astype(np.int64)
            seq, off, fill = best_fit_decreasing(lengths, width)
            gap = len(fill) - lower_bound(lengths, width)
            # certified, or the last round: all stays; else the worst-filled sequences, more of them the larger the gap, go to the pool
            keep = np.ones(len(fill), bool)
            if gap and not last:
                keep[np.argsort(fill, kind="stable")[: max(4 * gap, len(fill) // 8)]] = False
            full = keep[seq]
            group = (np.int64(key[0].as_py()) << 32) + base
            for name, value in (("seq", group + seq), ("offset", off), ("full", full), ("group_id", np.full(len(seq), group)), ("sequences", np.full(len(seq), keep.sum())), ("bound", np.full(len(seq), lower_bound(lengths[full], width)))):
                b = b.append_column(name, pa.array(value))
            return b.drop_columns(["g"])

        return run

    all_pieces = stored(pieces(docs, width, id_col, text_col, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == width
    one, own = F.lit(1).cast("long"), -1 - F.col("row")
    done = [all_pieces.where(whole).select("*", own.alias("seq"), F.lit(0).cast("long").alias("offset"), own.alias("group_id"), one.alias("sequences"), one.alias("bound"))]
    pool = all_pieces.where(~whole)
    for r in range(rounds + 1):
        n = pool.count()
        if not n:
            break
        parts = -(-n // per_task)
        dealt = pool.withColumn("g", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(parts)).cast("int"))
        got = stored(dealt.groupBy("g").applyInArrow(task(r == rounds, r << 28), schema), "packed")
        done.append(got.where("full").drop("full"))
        pool = got.where("not full").select(all_pieces.columns)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias(id_col), *_NAMES, F.col("seq").alias("sequence_id"), "offset", "group_id", F.col("sequences").alias("group_sequences"), F.col("bound").alias("group_bound"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
