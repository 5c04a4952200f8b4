"""Elias-Fano coding of strictly or weakly increasing integers, with vectorised access and search."""

from __future__ import annotations

import json
import re
import tempfile

import numpy as np

_U = np.uint64
_ONE, _SIX, _63 = _U(1), _U(6), _U(63)
_L = _U(0x0101010101010101)
_H = _U(0x8080808080808080)
# place of the k-th one in a byte, at 8 * byte + k
_BYTE_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], dtype=np.int64).ravel()


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one in each word, by sums of the ones of its bytes."""
    x = words - ((words >> _ONE) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    sums = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _L  # byte i: ones in bytes 0 to i
    k = k.astype(np.uint64)
    at = np.bitwise_count(((k * _L | _H) - sums) & _H).astype(np.uint64) << _U(3)
    rest = k - (((sums << _U(8)) >> at) & _U(0xFF))
    return at.astype(np.int64) + _BYTE_SELECT[((((words >> at) & _U(0xFF)) << _U(3)) + rest).astype(np.int64)]


class EliasFano:
    """n sorted values: the low bits of each in `low`, the high parts in unary in `high` (ones are values, zeros end a bucket).

    zeros: zeros before each word of `high`, the directory of find(); access() needs the
    ones before each word, which are kept instead where a sequence is only accessed.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray | None = None, ones: np.ndarray | None = None):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._zeros, self._ones = zeros, ones

    def _bits_before(self) -> np.ndarray:
        return 64 * np.arange(len(self.high) + 1, dtype=np.int64)

    @property
    def ones(self) -> np.ndarray:
        if self._ones is None:
            self._ones = np.append(0, np.cumsum(np.bitwise_count(self.high).astype(np.int64)))
        return self._ones

    @property
    def zeros(self) -> np.ndarray:
        if self._zeros is None:
            self._zeros = self._bits_before() - self.ones
        return self._zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (v >> _U(bits)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        mark = np.zeros((size // 64 + 2) * 64, np.uint8)  # a word of zeros follows
        mark[high + np.arange(n)] = 1
        low = np.zeros(-(-n * bits // 64) + 2, np.uint64)
        if bits and n:
            part = v & ((_ONE << _U(bits)) - _ONE)
            place = np.arange(n, dtype=np.uint64) * _U(bits)
            word, off = (place >> _SIX).astype(np.int64), place & _63
            # bits of different values do not overlap, so sums are ors
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low[word[start]] = np.add.reduceat(part << off, start)
            over = off + _U(bits) > _U(64)
            low[word[over] + 1] += part[over] >> (_U(64) - off[over])
        return cls(n, bits, low, np.packbits(mark, bitorder="little").view(np.uint64))

    def _low_at(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.uint64) * _U(self.bits)
        word, off = (place >> _SIX).astype(np.int64), place & _63
        # a shift by 64 gives 0
        return (self.low[word] >> off | self.low[word + 1] << (_U(64) - off)) & ((_ONE << _U(self.bits)) - _ONE)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the indices i; fastest for sorted ones."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * word + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << _U(self.bits)) | self._low_at(i)

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """Bit after the k-th (from 0) zero of `high`."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return 64 * word + _select_in_word(~self.high[word], k - self.zeros[word]) + 1

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not there; fastest for sorted values."""
        v = np.asarray(values, np.uint64)
        out = np.full(len(v), -1, np.int64)
        if not self.n or not len(v):
            return out
        high = v >> _U(self.bits)
        last = int(self.zeros[-1]) - 1
        where = np.flatnonzero(high < _U(last))
        h = high[where].astype(np.int64)
        bit = np.zeros(len(h), np.int64)
        later = np.flatnonzero(h)
        bit[later] = self._after_zero(h[later] - 1)
        # the bucket is the run of ones from that bit on
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        none = ~(self.high[word] >> off | self.high[np.minimum(word + 1, len(self.high) - 1)] << (_U(64) - off))
        size = np.bitwise_count((none & (_U(0) - none)) - _ONE).astype(np.int64)
        long = np.flatnonzero(size == 64)
        size[long] = self._after_zero(h[long]) - 1 - bit[long]
        lo = bit - h
        hi = lo + size
        want = v[where] & ((_ONE << _U(self.bits)) - _ONE)
        # bisect the low bits within each bucket
        go = np.flatnonzero(size > 0)
        at, to, need = lo[go], hi[go], want[go]
        while len(go):
            mid = (at + to) >> 1
            got = self._low_at(mid)
            hit = got == need
            out[where[go[hit]]] = mid[hit]
            less = got < need
            at, to = np.where(less, mid + 1, at), np.where(less, to, mid)
            on = np.flatnonzero(~hit & (at < to))
            go, at, to, need = go[on], at[on], to[on], need[on]
        return out

    def parts(self, name: str, directory: str = "zeros") -> dict:
        """The arrays to store, with the directory that find() ("zeros") or access() ("ones") needs."""
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.{directory}": getattr(self, directory), f"{name}.shape": np.array([self.n, self.bits], np.int64)}

    @classmethod
    def from_parts(cls, arrays: dict, name: str) -> EliasFano:
        n, bits = arrays[f"{name}.shape"].tolist()
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays.get(f"{name}.zeros"), arrays.get(f"{name}.ones"))


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON with the places, then the arrays at multiples of 64 bytes."""
    from pyarrow import fs

    spec, at = {}, 0
    for k, a in arrays.items():
        spec[k] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(path, compression=None) as f:
        f.write(head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 64))


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped: from the shared folder where it is mounted, else from an unnamed copy on the reader's disk that ends with the process."""
    if re.match(r"file:/", uri):
        data = np.memmap(re.sub(r"^file:(//)?", "", uri), np.uint8, "r")
    else:
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        with where.open_input_file(path) as f, tempfile.TemporaryFile() as copy:
            while block := f.read(8 << 20):
                copy.write(block)
            copy.flush()
            data = np.memmap(copy, np.uint8, "r")
    data = data.view(np.ndarray)
    n = 64
    while data[n - 1] != 10:
        n += 64
    spec = json.loads(data[:n].tobytes())
    return {k: data[n + at : n + at + size * np.dtype(kind).itemsize].view(kind) for k, (at, kind, size) in spec.items()}
