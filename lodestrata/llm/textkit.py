"""Words, hashes and windows of whole Arrow columns, without a Python loop over rows or words.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text; every other ASCII character separates words. As a regular expression
over ``lower(text)``: ``[0-9a-z\\x80-\\U0010FFFF]+``. Lower-casing never joins or splits
words, so word numbers also hold for the text as written. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one document may be longer.
SLICE_BYTES = 4 << 20
U = np.uint64

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_P, _WORD_P = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_held: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or of its inverse, modulo 2**64."""
    k = (int(base), inverse)
    if k not in _held or len(_held[k]) < n:
        b = pow(int(base), -1, 2**64) if inverse else int(base)
        p = np.full(max(n, SLICE_BYTES // 4), U(b))
        p[0] = 1
        _held[k] = np.cumprod(p, dtype=np.uint64)
    return _held[k][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Words(NamedTuple):
    h: np.ndarray  # hash of each word
    off: np.ndarray  # words of document i: off[i] to off[i + 1]
    start: np.ndarray  # byte range of each word in data
    end: np.ndarray
    data: np.ndarray  # bytes, lower case
    byte_off: np.ndarray  # bytes of document i


def flat(col: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words; a word ends where its document ends."""
    w = _WORD[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edge] = w[edge]
    last[edge - 1] = w[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(col: pa.Array | pa.ChunkedArray) -> Words:
    data, byte_off = flat(col)
    s, e = bounds(data, byte_off)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BYTE_P, len(data)), out=acc[1:])
    h = mix((acc[e] - acc[s]) * powers(_BYTE_P, len(data) + 1, True)[s] + (e - s).astype(np.uint64))
    return Words(h, np.searchsorted(s, byte_off), s, e, data, byte_off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; len(h) - n + 1 of them, over document ends too."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    acc = prefix(h)
    return mix((acc[n:] - acc[:-n]) * powers(_WORD_P, len(h) + 1, True)[: len(h) - n + 1])


def prefix(h: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_WORD_P, len(h)), out=acc[1:])
    return acc


def spans(acc: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the words s to e, from prefix()."""
    return mix((acc[e] - acc[s]) * powers(_WORD_P, len(acc), True)[s] + (e - s).astype(np.uint64))


def doc_of(off: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text") -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive whole rows of about SLICE_BYTES of text."""
    n = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    total = np.concatenate([[0], np.cumsum(np.asarray(n, dtype=np.int64))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(name)
    return (pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)) if isinstance(col, pa.ChunkedArray) else col
