"""Words, lines and shingles of Arrow text columns as numpy arrays, a bounded piece at a time.

Everything here works on the bytes of a piece of rows at once: no Python object per word. All
separators are ASCII, so splitting UTF-8 bytes gives the same words as splitting code points.
A null text has no bytes, hence no words and no lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: a step holds about 150 bytes a byte of its piece
PIECE_BYTES = 1 << 18
#: span hashes are two polynomials over the field of this prime; sums of 2^32 residues fit 64 bits
_PRIME = (1 << 31) - 1
_BASES = (1403580497, 811532633)


def table(inside) -> np.ndarray:
    """Which of the 256 bytes belong to a word."""
    return np.array([bool(inside(b)) for b in range(256)])


#: words between ASCII white space: [^\x20\x09-\x0D]+
SPACED = table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words of letters, digits and all non-ASCII characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
PLAIN = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) over the field."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(step) % np.uint64(_PRIME)
        done, step = done * 2, step * step % _PRIME
    return out


class Piece:
    """The bytes of some rows one after another; row i has data[borders[i]:borders[i + 1]]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, borders, data = column.buffers()
        n = len(column)
        at = np.frombuffer(borders, wide)[column.offset:column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
        self.data = LOWER[raw] if lower else raw
        self.borders = at - at[0]
        self.rows = n
        self._sums: list[np.ndarray] | None = None

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8")

    def spans(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes of a kind, and the first run of each row (and one more)."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = kind[self.data]
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.borders] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return starts, ends, np.searchsorted(starts, self.borders)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between line feeds (an empty text is one empty line), and the first of each row."""
        feeds = np.flatnonzero(self.data == 0x0A)
        row = np.searchsorted(self.borders, feeds, side="right") - 1
        # row i starts at borders[i]; after it each line feed starts a line
        first = np.arange(self.rows) + np.searchsorted(feeds, self.borders[:-1])
        starts = np.empty(self.rows + len(feeds), np.int64)
        ends = np.empty_like(starts)
        later = np.arange(len(feeds)) + row + 1
        starts[first], starts[later] = self.borders[:-1], feeds + 1
        ends[later - 1] = feeds
        lasts = np.append(first[1:], len(starts)) - 1
        ends[lasts] = self.borders[1:]
        return starts, ends, np.append(first, len(starts))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span of bytes, equal for equal bytes wherever they stand.

        Two different spans of n bytes agree in a residue for at most n of the 2^31 bases, and it takes both.
        """
        size, prime = 1 << max(12, len(self.data).bit_length()), np.uint64(_PRIME)
        if self._sums is None:
            self._sums = []
            for base in _BASES:
                terms = (self.data + np.uint64(1)) * _powers(base, size)[:len(self.data)]
                terms = (terms & prime) + (terms >> np.uint64(31))
                self._sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64))))
        out = (ends - starts).astype(np.uint64)
        for base, sums in zip(_BASES, self._sums):
            down = _powers(pow(base, -1, _PRIME), size)
            out = mix(out + (sums[ends] - sums[starts]) % prime * down[starts] % prime)
        return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words inside a row, and the index of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= last)
    return mix(out[at]), at


def in_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Values told apart by row, so that equal results mean the same value in the same row."""
    return mix(values + mix(row.astype(np.uint64) + np.uint64(1)))


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags over the items of each row."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]
