"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

The operators that read whole texts in Python do so a slice of rows at a
time: :func:`add_columns` feeds a function with slices of about
``SLICE_BYTES`` of text and appends what it returns to the rows.  Inside a
slice the texts lie in one byte array, each followed by a line feed, so word
and line borders are found for all rows at once.

Word classes of the contracts exclude only ASCII characters, hence a byte
table decides them exactly: every byte of a non-ASCII character is >= 0x80.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20

_P = 0x9E3779B97F4A7C15 | 1          # odd: invertible modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def byte_table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    t[[ord(c) for c in chars]] = 1
    return t


class _Powers:
    """Tables of the powers of the hash base and of its inverse.  What a
    slice needs is kept for the next one; the table of a longer text is not."""

    KEEP = SLICE_BYTES + (SLICE_BYTES >> 3)

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEEP:
            return self._table(_P, n), self._table(_PINV, n)
        if len(self.up) < n:
            size = min(1 << (n - 1).bit_length(), self.KEEP)
            self.up, self.down = (self._table(b, size) for b in (_P, _PINV))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing step that spreads the bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """One slice of texts; nulls are empty.  ``buf`` holds the bytes, every
    text followed by a line feed; ``off`` the row borders in ``buf``."""

    def __init__(self, arr: pa.Array):
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
        joined = pc.binary_join_element_wise(arr, pa.scalar(b"\n", pa.large_binary()),
                                             pa.scalar(b"", pa.large_binary()))
        off = np.frombuffer(joined.buffers()[1], dtype=np.int64)[
            joined.offset:joined.offset + len(joined) + 1]
        data = joined.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = raw[off[0]:off[-1]]
        self.off = off - off[0]
        self.n = len(joined)
        self.low = LOWER[self.buf]

    def per_row(self, table: np.ndarray, low: bool = False) -> np.ndarray:
        """Per row, the number of bytes that ``table`` marks (the appended
        line feed included when it is marked)."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        return np.add.reduceat(table[self.low if low else self.buf], self.off[:-1], dtype=np.int64)

    def prefix(self, low: bool) -> np.ndarray:
        """Prefix sums of the rolling hash, for :meth:`span_hash`."""
        src = self.low if low else self.buf
        up, _ = _POWERS.get(len(src) + 1)
        out = np.zeros(len(src) + 1, dtype=np.uint64)
        np.cumsum((src.astype(np.uint64) + np.uint64(1)) * up[:len(src)], out=out[1:])
        return out

    def span_hash(self, pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes ``[start, end)``; equal bytes, equal hash."""
        _, down = _POWERS.get(len(self.buf) + 1)
        return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))

    def spans(self, table: np.ndarray, low: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of marked bytes: start, end, and the border of every
        row in them (``bound[r]:bound[r + 1]`` are the runs of row r)."""
        m = table[self.low if low else self.buf].astype(bool)
        if not len(m):
            z = np.zeros(0, dtype=np.int64)
            return z, z, np.zeros(self.n + 1, dtype=np.int64)
        edge = np.flatnonzero(m[1:] != m[:-1]) + 1
        if m[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (line feed excluded) and row borders of all lines."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return start, end, np.searchsorted(start, self.off)


def row_of(bound: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bound) - 1), np.diff(bound))


def ngrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` consecutive words at every word, and whether they
    lie in one row (the last ``k - 1`` words have no such window)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _Q
        g += h[j:j + n]
    return mix(g), row[:n] == row[k - 1:]


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row stands alone."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def text_slices(batch: pa.RecordBatch, col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(np.asarray(size, dtype=np.int64), limit):
        yield batch.slice(a, b - a)


def hand_back() -> None:
    """Return freed memory to the system.  Python workers wait for the tasks
    of later stages; what they hold then counts against their executor."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, col: str, schema: T.StructType,
               make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]],
               limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of about ``limit`` bytes of column ``col``.
    ``make`` runs once per task and returns the function for a slice; a worker
    keeps nothing of it for later tasks."""
    def run(batches):
        fn = make()
        for batch in batches:
            for piece in text_slices(batch, col, limit):
                yield from fn(piece)
        del fn
        hand_back()
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, col: str, fields: list[T.StructField],
                make: Callable[[], Callable[[pa.Array], list]], drop: tuple[str, ...] = (),
                limit: int = SLICE_BYTES) -> DataFrame:
    """Every row of ``df`` with the columns ``fields`` computed from its
    string column ``col``.  Input columns of the same names are replaced,
    those in ``drop`` left out."""
    names = [f.name for f in fields]
    keep = [c for c in df.columns if c not in names and c not in drop]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def outer():
        fn = make()

        def piece(batch):
            new = fn(batch.column(col))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep]
                                             + [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)
                                                for x in new], names=keep + names)
        return piece
    return map_slices(df, col, schema, outer, limit)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
