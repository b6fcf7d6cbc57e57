"""Vectorised tokenising and hashing of Arrow string columns with numpy.

Texts are read as UTF-8 bytes straight from the Arrow buffers. A word's hash is a polynomial over
its bytes modulo 2**64 (random byte values, odd base), finished with a bit mixer, so that all words
of a block of text are hashed with a handful of array operations. All values are the same on every
executor: the tables come from fixed seeds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library, which has no such call
    _LIBC = None

U64 = np.uint64
#: What a worker keeps between the tasks of one operator; splitting texts for another one lets go of it.
KEPT: dict = {}
_SEGMENT = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def _wide(seed: int, n: int) -> np.ndarray:
    return np.random.RandomState(seed).randint(0, 256, (n, 8), dtype=np.uint8).view(U64).ravel()


_BYTE = _wide(11, 256)
#: Odd multipliers, one for each place in a shingle.
_PLACE = _wide(12, 64) | U64(1)


def space_separators() -> np.ndarray:
    """True for the bytes 0x20 and 0x09-0x0D; all others belong to words."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def punctuation_separators() -> np.ndarray:
    """True for every ASCII byte that is no letter or digit."""
    out = np.zeros(256, bool)
    out[:128] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        out[a:b] = False
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; a bijection on 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, 2 * _SEGMENT), _powers(pow(_BASE, -1, 1 << 64), 2 * _SEGMENT)


def release() -> None:
    """Give memory that is free back to the system: a worker lives on for other operators."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def row_slices(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``max_bytes`` of text, or one longer row."""
    n = batch.num_rows
    if not n:
        return
    off = _offsets(batch.column(column))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release()


def _offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    buf = arr.buffers()[1]
    if buf is None or not len(arr):
        return np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(buf, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


class Words:
    """Words of a column of texts: byte ranges and hashes, with ``first[i]:first[i+1]`` those of row i."""

    __slots__ = ("start", "end", "hash", "first", "row_byte")

    def __init__(self, start, end, hashes, first, row_byte):
        self.start, self.end, self.hash, self.first, self.row_byte = start, end, hashes, first, row_byte


def words(texts: pa.Array, separators: np.ndarray, *, hashes: bool = True) -> Words:
    """Split every text at separator bytes; A-Z are lower-cased. A null is an empty text."""
    KEPT.clear()
    if texts.null_count:
        texts = texts.fill_null("")
    off = _offsets(texts)
    data = texts.buffers()[2] if len(texts.buffers()) > 2 else None
    low = off[0] if len(off) else 0
    off = off - low
    total = int(off[-1])
    if not total:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(off), np.int64), off)
    raw = np.frombuffer(data, np.uint8, count=total, offset=int(low))
    text = ~separators[raw]
    begin, stop = text.copy(), text.copy()
    begin[1:] &= ~text[:-1]
    stop[:-1] &= ~text[1:]
    edge = off[:-1][off[:-1] < total]
    begin[edge] = text[edge]
    edge = off[1:][off[1:] > 0] - 1
    stop[edge] = text[edge]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first = np.searchsorted(start, off)
    return Words(start, end, _word_hashes(_LOWER[raw], start, end) if hashes else None, first, off)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U64)
    i, n = 0, len(start)
    while i < n:
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + _SEGMENT, "right")))
        span = int(end[j - 1]) - base
        power, inverse = (_POW, _INV) if span < len(_POW) else (_powers(_BASE, span + 1), _powers(pow(_BASE, -1, 1 << 64), span + 1))
        total = np.zeros(span + 1, U64)
        np.cumsum(_BYTE[data[base : base + span]] * power[:span], out=total[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in order, and the rows' offsets into them.

    A row of fewer words, but one at least, has its whole sequence as the only one.
    """
    count = np.diff(w.first)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offsets = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(int(offsets[-1]), U64)
    n = len(w.hash) - k + 1
    if n > 0:
        total = w.hash[:n] * _PLACE[0]
        for i in range(1, k):
            total += w.hash[i : i + n] * _PLACE[i]
        last = np.repeat(w.first[1:], count)[:n]
        whole = np.arange(n) + k <= last
        long = np.repeat(count >= k, size)
        out[long] = total[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        total = count[short].astype(U64) * U64(0xD6E8FEB86659FD93)
        for i in range(k - 1):
            has = count[short] > i
            total[has] += w.hash[w.first[short[has]] + i] * _PLACE[i]
        out[offsets[short]] = total
    return mix(out), offsets


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, with new offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    keep[heads] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], total[offsets]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
