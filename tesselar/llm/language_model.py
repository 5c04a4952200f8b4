"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words (white space divides; A-Z lower-cased) and one end per text.
Counts cover all training texts: those whose id's crc32 modulo 10 is not 0.

Levels.  Words are sorted by a 64-bit hash and numbered; the hashes are an
Elias-Fano sequence.  A level of the trie holds, for each entry of the level
above it (its context), the numbers of the words that follow.  They are made one
rising sequence by adding the context's base, which is itself a rising sequence
(the monotone pointers); both are Elias-Fano coded.  A search adds the base of the
context to the word's number and looks for the sum among the successors.

Kept are all words, and all bigrams and trigrams that occur MIN_COUNT times, by
their own counts only.  Smoothing is interpolated absolute discounting: an entry
keeps log10 of its discounted share, a context the weight that it leaves to the
level below.  Both are rounded down to a byte, so that the probabilities that
follow a context never sum to more than 1.

Counting.  A task sorts the keys that it has gathered, adds equal ones up and
passes on, per range of keys, one block of differences.  Ranges are cut by the counts
of the level above, so a frequent word or bigram is dealt over several; the weight of
a context that lies in two ranges or more is put together from their sums.

Files.  The levels lie in the shared folder and are mapped into memory by readers.
A task writes a file of a new name, and only the names that tasks return are read:
a task that runs twice does no harm.  The number of files follows the token count up
to FILES, then their size does.

Edge cases: null and empty texts consist of the end.  Without training texts all
scores are 0.  A null id counts as training.  Every input row gives one row, repeated
rows and ids too; ids of any type pass through unchanged.  Long texts are read whole;
a batch holds one at least.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, in_worker, stored, table, worker_caches
from .elias_fano import EliasFano, read_arrays, write_arrays
from .words import binary_parts, runs, text_chunks, word_hashes

MIN_COUNT = 2
DISCOUNT = 0.75
ADD = 0.1
STEP = 1 / 20  # of quantised log10 values
FLUSH = 2_000_000
PER_RANGE = 4_000_000  # tokens whose counts are added up at once
FILES = 256
TOKENS = 400_000  # looked up at once
END = np.uint64(0xE5D0000000000001)
_NONE = np.uint32(0xFFFFFFFF)


def _quantise(p: np.ndarray) -> np.ndarray:
    """A byte for each probability, of the next lower one; what rounding leaves above is the next."""
    with np.errstate(divide="ignore"):
        return np.clip(np.ceil(-np.log10(p) / STEP - 1e-9), 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (-STEP * np.arange(256))


def _unsigned(count: np.ndarray) -> np.ndarray:
    return count.astype(np.uint32 if not len(count) or count.max() < 1 << 32 else np.uint64)


# ---------------------------------------------------------------- blocks of sorted keys and their counts


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    """Bytes that the largest value needs, and the values' first bytes, second bytes, ..."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return width, x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplane(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def pack(keys: np.ndarray, counts: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Sorted distinct keys and their counts as differences, byte by byte, compressed."""
    (k, a), (c, b) = _planes(np.diff(keys, prepend=np.uint64(0))), _planes(counts.astype(np.uint64))
    return bytes([k, c]) + len(keys).to_bytes(4, "little") + squeeze.compress(a + b)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, c, n = block[0], block[1], int.from_bytes(block[2:6], "little")
    data = zstandard.ZstdDecompressor().decompress(block[6:], max_output_size=n * (k + c) + 1)
    return np.cumsum(_unplane(data[: n * k], n, k)), _unplane(data[n * k :], n, c).astype(np.int64)


def _blocks(keys: Iterator[np.ndarray], starts: np.ndarray, per_file: int) -> Iterator[pa.RecordBatch]:
    """file, part (range of keys) and block of all keys, summed over about FLUSH of them."""
    squeeze = zstandard.ZstdCompressor(level=1)

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        u, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.append(np.searchsorted(u, starts), len(u))
        part = np.flatnonzero(np.diff(cut))
        blocks = [pack(u[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]], squeeze) for i in part.tolist()]
        return pa.RecordBatch.from_arrays([pa.array((part // per_file).astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(blocks, pa.binary())], ["file", "part", "block"])

    held, size = [], 0
    for k in keys:
        held.append(k)
        size += len(k)
        if size >= FLUSH:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


_BLOCKS = "file int, part int, block binary"


def _merged(blocks: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a file and their counts from `least` on; ranges are added up one after another."""
    part = blocks.column("part").to_numpy()
    column = blocks.column("block")
    keys, counts = [], []
    for p in np.unique(part).tolist():
        got = [unpack(column[i].as_py()) for i in np.flatnonzero(part == p).tolist()]
        k = np.concatenate([x for x, _ in got])
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        n = np.add.reduceat(np.concatenate([x for _, x in got])[order], first)
        keep = n >= least
        keys.append(k[first[keep]])
        counts.append(n[keep])
    return np.concatenate(keys), np.concatenate(counts)


def _cuts(weight: np.ndarray, per: int) -> tuple[list[int], list[float]]:
    """Where to cut entries into ranges of about `per`: entry, and the share of it that lies before the cut (0 but for heavy entries)."""
    total = np.cumsum(weight)
    k = int(total[-1]) // per if len(weight) else 0
    mark = total[-1] * np.arange(1, k + 1) // (k + 1) if k else np.zeros(0, np.int64)
    i = np.searchsorted(total, mark, "right")
    share = (mark - (total[i] - weight[i])) / weight[i] if k else np.zeros(0)
    share = np.where(weight[i] > per // 4, share, 0.0) if k else share
    return i.tolist(), share.tolist()


# ---------------------------------------------------------------- the model


@dataclass(frozen=True)
class Level:
    """Files of a level: where each range of keys and of entry numbers begins; the weights of contexts that lie in several files."""

    names: tuple = ()  # None: no entries
    starts: tuple = ()  # first key
    before: tuple = ()  # entries before each file, and all
    contexts: tuple = ()
    weights: tuple = ()


@dataclass(frozen=True)
class Spec:
    """Where the levels lie; a few numbers per file, passed to every task."""

    base: str = ""
    words: Level = field(default_factory=Level)
    bigrams: Level = field(default_factory=Level)
    trigrams: Level = field(default_factory=Level)
    tokens: int = 0
    texts: int = 0
    distinct: int = 0
    order: int = 1

    @property
    def bits(self) -> int:
        """Of a word's number in a key; all ones is a word that no entry has."""
        return max(1, (self.distinct + 1).bit_length())


_opened: dict[str, dict] = {}  # of one model, in each worker
worker_caches["language_model"] = _opened.clear


class Trie:
    """Reads the levels of a Spec.  Word numbers: rank by hash; `start` (one more than all) is the start of a text; -1 is unknown."""

    def __init__(self, spec: Spec):
        self.spec, self.start, self.bits = spec, spec.distinct, np.uint64(spec.bits)
        self.no_word = np.uint64((1 << spec.bits) - 1)
        self.norm = spec.tokens + ADD * (spec.distinct + 1)
        if spec.distinct >= (1 << 32) - 1 or (spec.bigrams.before and (spec.bigrams.before[-1] << spec.bits) >= 1 << 64):
            raise ValueError("too many distinct words or bigrams for keys of 64 bits")
        if any(not path.startswith(spec.base) for path in _opened):
            _opened.clear()
        self.levels = [None] + [(x, np.array(x.starts, np.uint64), np.array(x.before, np.int64), np.array(x.contexts, np.int64), np.array(x.weights)) for x in (spec.words, spec.bigrams, spec.trigrams)]

    def _file(self, k: int, s: int) -> dict | None:
        name = self.levels[k][0].names[s]
        if name is None:
            return None
        path = f"{self.spec.base}/{name}"
        if path not in _opened:
            a = read_arrays(path)
            _opened[path] = a | {"keys": EliasFano.from_parts(a, "keys")} | ({"bases": EliasFano.from_parts(a, "base")} if k > 1 else {})
        return _opened[path]

    def _files(self, k: int, sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Files that hold sorted keys, and which keys."""
        cut = np.append(np.searchsorted(sorted_keys, self.levels[k][1]), len(sorted_keys))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            yield s, slice(cut[s], cut[s + 1])

    def word_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted distinct hashes."""
        ids, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, part in self._files(1, h):
            if file := self._file(1, s):
                i = file["keys"].find(h[part])
                ids[part] = np.where(i >= 0, i + self.levels[1][2][s], -1)
                count[part] = np.where(i >= 0, file["count"][np.maximum(i, 0)], 0)
        return ids, count

    def counts(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """Counts of sorted numbers of words (k = 1) or bigrams (2); the start of a text counts as often as there are texts."""
        before = self.levels[k][2]
        out = np.full(len(numbers), self.spec.texts, np.int64)
        cut = np.searchsorted(numbers, before)
        for s in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[s], cut[s + 1])
            out[part] = self._file(k, s)["count"][numbers[part] - before[s]]
        return out

    def search(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level k (2 or 3) for sorted keys, context << bits | word: entry numbers (-1: none), discounted shares (0: none), and the weights that the contexts leave.

        Contexts are word numbers (level 2) or bigram numbers (level 3).
        """
        number, share, weight = np.full(len(keys), -1, np.int64), np.zeros(len(keys)), np.ones(len(keys))
        if self.spec.order < k:
            return number, share, weight
        _, starts, before, in_several, their_weights = self.levels[k]
        for s, part in self._files(k, keys):
            if not (file := self._file(k, s)):
                continue
            context, word = keys[part] >> self.bits, keys[part] & self.no_word
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            each = np.diff(np.append(first, len(context)))
            local = (context[first] - (starts[s] >> self.bits)).astype(np.int64)
            inside = local < file["bases"].n - 1  # beyond the last context that has entries here
            at = np.where(inside, local, 0)
            low, high = file["bases"].access(at), file["bases"].access(at + 1)
            high = np.where(inside, high, np.uint64(0))
            want = np.repeat(low, each) + word
            ok = np.flatnonzero(want < np.repeat(high, each))
            i = file["keys"].find(want[ok])
            ok, i = ok[i >= 0], i[i >= 0]
            place = ok + part.start
            number[place] = i + before[s]
            share[place] = _VALUE[file["share"][i]]
            weight[part] = np.repeat(np.where(inside, _VALUE[file["weight"][at]], 1.0), each)
        if len(in_several):
            context = (keys >> self.bits).astype(np.int64)
            i = np.minimum(np.searchsorted(in_several, context), len(in_several) - 1)
            weight = np.where(in_several[i] == context, their_weights[i], weight)
        return number, share, weight

    def keys(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys of known contexts and words (-1: unknown), and which one each place has."""
        return np.unique((contexts.astype(np.uint64) << self.bits) | np.where(words < 0, self.no_word, words.astype(np.uint64)), return_inverse=True)

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The word before each token."""
        before = np.append(np.int64(-1), ids[:-1])
        before[first] = self.start
        return before

    def bigrams(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the number of the bigram that ends with it, its share, and the weight of the word before it."""
        number, share, weight = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
        before = self.contexts(ids, first)
        place = np.flatnonzero(before >= 0)
        key, inv = self.keys(before[place], ids[place])
        for out, got in zip((number, share, weight), self.search(2, key), strict=True):
            out[place] = got[inv]
        return number, share, weight

    def after_bigrams(self, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of tokens that follow a kept bigram of their text."""
        ok = np.append(False, number[:-1] >= 0)
        ok[first] = False
        return np.flatnonzero(ok)

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probabilities of texts, given their tokens and where each text begins."""
        u, inv = np.unique(ids, return_inverse=True)
        count = np.zeros(len(u), np.int64)
        count[u >= 0] = self.counts(1, u[u >= 0])
        p = ((count + ADD) / self.norm)[inv]
        number, share, weight = self.bigrams(ids, first)
        p = share + weight * p
        place = self.after_bigrams(number, first)
        key, inv = self.keys(number[place - 1], ids[place])
        _, share, weight = self.search(3, key)
        p[place] = share[inv] + weight[inv] * p[place]
        return np.add.reduceat(np.log10(p), first) if len(first) else np.zeros(0)


def _tokens(trie: Trie, data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers and counts of the tokens of texts, and where each text begins (one entry more than texts)."""
    h, first = word_hashes(data, at)
    n = len(first) - 1
    u, inv = np.unique(np.append(h, END), return_inverse=True)
    ids, count = trie.word_ids(u)
    end = np.zeros(len(h) + n, bool)
    end[first[1:] + np.arange(n)] = True
    which = np.full(len(end), inv[-1])
    which[~end] = inv[:-1]
    return ids[which], count[which], first + np.arange(n + 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a tokenised table, in runs of about TOKENS: range in the batch, batch, word numbers, where each text begins."""
    for b in batches:
        data, at = binary_parts(b.column("ids"))
        for a, z in runs(np.diff(at) // 4, TOKENS):
            raw = data[at[a] : at[z]].copy().view(np.uint32)
            ids = raw.astype(np.int64)
            ids[raw == _NONE] = -1
            yield a, z, b, ids, (at[a:z] - at[a]) // 4


def _write_level(base: str, label: str, key: tuple[int, int], end: int, bits: int, keys: np.ndarray, count: np.ndarray, of_context: np.ndarray) -> dict:
    """One file of level 2 or 3 from its sorted keys; key: its number and first key; end: the next file's first key; of_context: the counts of the contexts that have entries here."""
    low = np.uint64((1 << bits) - 1)
    s, start = key
    context, word = (keys >> np.uint64(bits)).astype(np.int64), keys & low
    local = context - (start >> bits)
    n = int(local[-1]) + 1
    last = np.flatnonzero(np.append(context[1:] != context[:-1], True))
    most = np.zeros(n + 1, np.uint64)
    most[local[last] + 1] = word[last] + np.uint64(1)
    base_of = np.cumsum(most)
    held = np.add.reduceat(count - DISCOUNT, np.append(0, last[:-1] + 1))
    weight = np.ones(n)
    weight[local[last]] = 1.0 - held / of_context
    each = np.diff(np.append(-1, last))
    name = f"{label}-{s:06d}-{uuid.uuid4().hex}"
    write_arrays(
        f"{base}/{name}",
        EliasFano.of(base_of).parts("base", "ones") | EliasFano.of(base_of[local] + word).parts("keys") | {"share": _quantise((count - DISCOUNT) / np.repeat(of_context, each)), "weight": _quantise(np.maximum(weight, 1e-12)), "count": _unsigned(count)},
    )
    # contexts that may lie in the files before or after, too
    edge = [j for j, inside in ((0, local[0] == 0 and start & int(low)), (len(last) - 1, end & int(low) and context[-1] == end >> bits)) if inside]
    edge = sorted(set(edge))
    return {"file": s, "name": name, "n": len(keys), "edge": [int(context[last[j]]) for j in edge], "held": [float(held[j]) for j in edge], "of": [int(of_context[j]) for j in edge]}


_WRITTEN = "file int, name string, n long, tokens long, cut array<long>, share array<double>, edge array<long>, held array<double>, of array<long>"


def _row(**values) -> pa.Table:
    kinds = {"file": pa.int32(), "name": pa.string(), "n": pa.int64(), "tokens": pa.int64(), "cut": pa.list_(pa.int64()), "share": pa.list_(pa.float64()), "edge": pa.list_(pa.int64()), "held": pa.list_(pa.float64()), "of": pa.list_(pa.int64())}
    return pa.table({k: pa.array([values.get(k, [] if pa.types.is_list(t) else "" if pa.types.is_string(t) else 0)], t) for k, t in kinds.items()})


def _level(written: dict, starts: list[int], n_files: int) -> Level:
    names = tuple(written[s].name if s in written else None for s in range(n_files))
    before = np.append(0, np.cumsum([written[s].n if s in written else 0 for s in range(n_files)])).tolist()
    sums: dict[int, list] = {}
    for r in written.values():
        for c, held, of in zip(r.edge, r.held, r.of, strict=True):
            sums.setdefault(c, [0.0, of])[0] += held
    # quantised as the other weights are
    edge = sorted(sums)
    weight = _VALUE[_quantise(np.maximum([1.0 - sums[c][0] / sums[c][1] for c in edge], 1e-12))].tolist() if edge else []
    return Level(names, tuple(starts), tuple(before), tuple(edge), tuple(weight))


def _ranges(starts: list[int]) -> tuple[np.ndarray, list[int], int]:
    """First keys of all ranges, first keys of the files, and how many ranges a file has."""
    starts = sorted(set(starts))
    per = -(-len(starts) // FILES)
    return np.array(starts, np.uint64), starts[::per], per


def _counted(rows: DataFrame, keys, starts: list[int], write) -> tuple[dict, list[int]]:
    """Counts the keys that keys(batches) yields over rows; write(file, first key, next file's first key, blocks) is run for each file."""
    ranges, files, per = _ranges(starts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(keys(batches), ranges, per)

    def finish(key: tuple, blocks: pa.Table) -> pa.Table:
        s = key[0].as_py()
        return write(s, files[s], files[s + 1] if s + 1 < len(files) else 1 << 64, blocks)

    done = rows.mapInArrow(in_worker("language_model", task), _BLOCKS).groupBy("file").applyInArrow(finish, _WRITTEN).where("n > 0").collect()
    return {r.file: r for r in done}, files


def _with_fold(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))
    return docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))


def _fit_words(slim: DataFrame, folder: str, per_range: int) -> tuple[Spec, list[int]]:
    """Level 1, and the first keys of level 2's ranges."""
    train = slim.where("not held_out").select("text")
    # the size in bytes fixes the number of ranges beforehand; a token has 6 bytes or so
    size, texts = train.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(4, -(-(size or 0) // (6 * per_range)))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for _, _, data, at in text_chunks(b.column("text")):
                yield np.append(word_hashes(data, at)[0], np.full(len(at) - 1, END))

    def write(s: int, start: int, end: int, blocks: pa.Table) -> pa.Table:
        h, count = _merged(blocks, 1)
        name = f"words-{s:06d}-{uuid.uuid4().hex}"
        write_arrays(f"{folder}/{name}", EliasFano.of(h).parts("keys") | {"count": _unsigned(count)})
        cut, share = _cuts(count, per_range)
        return _row(file=s, name=name, n=len(h), tokens=int(count.sum()), cut=cut, share=share)

    done, files = _counted(train, keys, [(i << 64) // n for i in range(n)], write)
    level = _level(done, files, len(files))
    distinct = level.before[-1]
    spec = Spec(folder, level, tokens=sum(r.tokens for r in done.values()), texts=texts, distinct=distinct)
    first = 1 << spec.bits
    starts = [0]
    for s, r in done.items():
        starts += [(level.before[s] + i) * first + int(x * distinct) for i, x in zip(r.cut, r.share, strict=True)]
    starts += [distinct * first + distinct * i // (texts // per_range + 1) for i in range(texts // per_range + 1)]
    return spec, starts


def tokenised(slim: DataFrame, spec: Spec) -> DataFrame:
    """id, held_out, n_tokens, n_known, base_score and ids (word numbers as bytes) of each text; stored, so that texts are read twice in all."""
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(spec)
        for b in batches:
            for a, z, data, at in text_chunks(b.column("text")):
                ids, count, first = _tokens(trie, data, at)
                base = np.add.reduceat(np.log10((count + ADD) / trie.norm), first[:-1])
                known = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
                raw = np.where(ids < 0, _NONE, ids.astype(np.uint32)).tobytes()
                binary = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(a, z - a), b.column("held_out").slice(a, z - a), pa.array(np.diff(first)), pa.array(known), pa.array(base), binary], ["id", "held_out", "n_tokens", "n_known", "base_score", "ids"])

    return stored(slim.mapInArrow(in_worker("language_model", run), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, ids binary"), "tokens")


def fit(docs: DataFrame, order: int = 3, per_range: int = PER_RANGE, id_col: str = "doc_id", text_col: str = "text") -> tuple[Spec, DataFrame | None]:
    """Counts all training texts and writes the levels; the model, and all texts as numbers of its words (None without training texts)."""
    folder = fresh_path(docs.sparkSession, "trie")
    folder = folder if ":" in folder else f"file://{folder}"
    slim = _with_fold(docs, id_col, text_col)
    spec, starts = _fit_words(slim, folder, per_range)
    if not spec.tokens:
        return Spec(), None
    tokens = tokenised(slim, spec)
    if order < 2:
        return spec, tokens
    train = tokens.where("not held_out").select("ids")
    bits = spec.bits

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        trie = Trie(spec)
        for _, _, _, ids, first in _chunks(batches):
            yield (trie.contexts(ids, first).astype(np.uint64) << trie.bits) | ids.astype(np.uint64)

    def write_bigrams(s: int, start: int, end: int, blocks: pa.Table) -> pa.Table:
        keys, count = _merged(blocks, MIN_COUNT)
        if not len(keys):
            return _row(file=s)
        of = Trie(spec).counts(1, np.unique(keys >> np.uint64(bits)).astype(np.int64))
        cut, share = _cuts(count, per_range)
        return _row(cut=cut, share=share, **_write_level(folder, "bigrams", (s, start), end, bits, keys, count, of))

    done, files = _counted(train, bigrams, starts, write_bigrams)
    level = _level(done, files, len(files))
    spec2 = Spec(folder, spec.words, level, Level(), spec.tokens, spec.texts, spec.distinct, 2)
    if order < 3 or not level.before[-1]:
        return spec2, tokens
    starts = [0]
    for s, r in done.items():
        starts += [((level.before[s] + i) << bits) + int(x * spec.distinct) for i, x in zip(r.cut, r.share, strict=True)]

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        trie = Trie(spec2)
        for _, _, _, ids, first in _chunks(batches):
            # a trigram that is kept has two kept bigrams
            number = trie.bigrams(ids, first)[0]
            place = trie.after_bigrams(number, first)
            place = place[number[place] >= 0]
            yield (number[place - 1].astype(np.uint64) << trie.bits) | ids[place].astype(np.uint64)

    def write_trigrams(s: int, start: int, end: int, blocks: pa.Table) -> pa.Table:
        keys, count = _merged(blocks, MIN_COUNT)
        if not len(keys):
            return _row(file=s)
        of = Trie(spec2).counts(2, np.unique(keys >> np.uint64(bits)).astype(np.int64))
        return _row(**_write_level(folder, "trigrams", (s, start), end, bits, keys, count, of))

    done, files = _counted(train, trigrams, starts, write_trigrams)
    return Spec(folder, spec.words, spec2.bigrams, _level(done, files, len(files)), spec.tokens, spec.texts, spec.distinct, 3), tokens


def score(docs: DataFrame, spec: Spec, tokens: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows of docs; tokens: docs as numbers of the model's words, as fit() gives them for its own table."""
    slim = _with_fold(docs, id_col, text_col)
    if not spec.tokens:
        n = F.size(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", " " * 5), " "), lambda w: w != ""))
        none = F.lit(0.0)
        return slim.select(F.col("id").alias(id_col), "held_out", (n + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), none.alias("base_score"), none.alias("score"))
    tokens = tokenised(slim, spec) if tokens is None else tokens
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(spec)
        for a, z, b, ids, first in _chunks(batches):
            keep = ["id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, z - a) for c in keep), pa.array(trie.score(ids, first))], [*keep, "score"])

    out = tokens.mapInArrow(in_worker("language_model", run), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(spec.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs))
