"""Vectorised text kernels for Arrow batches: tokens, word hashes, window hashes.

All work on the UTF-8 buffers of whole texts.  A word hash is a polynomial in
the word's bytes modulo 2**64 (taken from prefix sums) and then mixed; a window
hash is a polynomial in its word hashes.  Equal inputs have equal hashes on
every machine.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def returned() -> None:
    """Gives freed memory back to the system, since idle Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


SPACES = b"\t\n\x0b\x0c\r "


def byte_table(kind: str) -> np.ndarray:
    """Fold table for 256 bytes; 32 marks a byte outside words.

    ``plain``: words are ``[^\\x20\\x09-\\x0D]+``; ``lower``: the same with A-Z
    lower-cased; ``alnum``: words of digits, lower-cased a-z and non-ASCII.
    """
    out = np.arange(256, dtype=np.uint8)
    out[list(SPACES)] = 32
    if kind != "plain":
        out[65:91] += 32
    if kind == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        out[~keep] = 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of an Arrow string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    valid = np.asarray(column.is_valid())
    column = pc.fill_null(column, "").cast(pa.large_string()) if len(column) else pa.array([], pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets, valid


def pieces(offsets: np.ndarray, limit: int = 1 << 20):
    """Row ranges whose texts have about ``limit`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """Words of the rows [i, j): byte ranges, words by row, and hashes."""

    def __init__(self, hasher: "Hasher", data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        self.folded = hasher.table[data[base : int(offsets[-1])]]
        self.bounds = offsets - base
        inside = self.folded != 32
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[:1] = False
        cuts = self.bounds[:-1]
        before[cuts[cuts < len(before)]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[-1:] = False
        cuts = self.bounds[1:] - 1
        after[cuts[cuts >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.by_row = np.searchsorted(self.starts, self.bounds)
        self.hasher = hasher
        self._prefix = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.by_row)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """uint64 per word; ``most``: of its first so many bytes only."""
        if self._prefix is None:
            self._prefix = self.hasher.prefix_sums(self.folded.astype(np.uint64) + np.uint64(1))
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return mix((self._prefix[ends] - self._prefix[self.starts]) * self.hasher.inverse(len(self.folded))[self.starts])


class Hasher:
    """Holds a byte table and the powers that prefix hashing needs."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, kind: str, salt: int = 0):
        self.table = byte_table(kind)
        self.base = (self.BASE + 2 * 0x632BE59BD9B4E019 * salt) % (1 << 64) | 1
        self._powers = self._inverse = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 1 << 16)
            for name, base in (("_powers", self.base), ("_inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix_sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grown(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self._powers[:n], out=out[1:])
        return out

    def inverse(self, n: int) -> np.ndarray:
        self._grown(n + 1)
        return self._inverse

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        return Words(self, data, offsets)

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` hashes from each place on; those near the end are missing."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self.prefix_sums(hashes)
        return mix((sums[size:] - sums[:n]) * self.inverse(n)[:n])


def window_starts(by_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the word array where a window of one row starts, and their rows."""
    n = np.maximum(np.diff(by_row) - size + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + by_row[:-1][rows], rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one after another."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
