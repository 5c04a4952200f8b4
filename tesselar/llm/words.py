"""Arrow columns of texts: chunks of bounded bytes, and 64-bit hashes of the words in them.

Words are runs of other bytes than space and 0x09-0x0D, with A-Z lower-cased.  The
bytes are read from the column's own buffers; no text becomes a Python string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_LONG = 256  # bytes from which a word is hashed on its own
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if 0x09 <= c <= 0x0D else c for c in range(256))
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_LONG + 1)], dtype=np.uint64)
_EIGHT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text or binary column without nulls, and where each value begins (one entry more than values)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes sum to about `most`; a larger one stands alone or ends its range."""
    if len(sizes):
        group = np.cumsum(sizes) // most
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
        yield from zip(cut, [*cut[1:], len(sizes)], strict=True)


def text_chunks(col: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Ranges of rows of about `most` bytes, their lower-cased bytes with each kind of white space as a space, and where each text begins.  Null is empty."""
    data, at = binary_parts(pc.fill_null(col, ""))
    for a, z in runs(np.diff(at), most):
        yield a, z, data[at[a] : at[z]].tobytes().translate(_TABLE), at[a : z + 1] - at[a]


def word_hashes(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts as text_chunks gives them, and which word is each text's first (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    octets = np.frombuffer(data + bytes(8), np.uint8)
    inside = octets[:n] != 0x20
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    size = ends - starts
    lanes = np.ndarray((n + 1,), "<u8", octets, 0, (1,))
    h = mix(size.astype(np.uint64) * _EIGHT ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    for k in range(8, _LONG, 8):
        if not len(more):
            break
        left = size[more] - k
        h[more] = mix((h[more] + _EIGHT) ^ (lanes[starts[more] + k] & _MASK[np.minimum(left, 8)]))
        more = more[left > 8]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, np.searchsorted(starts, at)
