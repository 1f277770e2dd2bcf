"""Vectorised word scanning of Arrow text columns, shared by the operators that run inside tasks.

A batch is cut into slices of bounded bytes (a text is never cut, so one very long text makes one
slice). Words are runs of bytes that a 256-entry table marks, and a word is known by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words that end at ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of digits, letters and anything beyond ASCII (of lower-cased text).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Words of letters: a-z and anything beyond ASCII (of lower-cased text).
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        keep = n <= 4 * SLICE_BYTES  # the tables of one huge text aren't kept
        steps = np.full(1 << max(16, (n - 1).bit_length()) if keep else n, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if keep:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Rows [start, stop) of a batch: their bytes, and where each text begins and ends in them."""

    def __init__(self, start: int, data: np.ndarray, bounds: np.ndarray):
        self.start, self.data, self.bounds = start, data, bounds
        self.rows = len(bounds) - 1

    @property
    def stop(self) -> int:
        return self.start + self.rows


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column (null counts as empty) into slices of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        stop = min(stop, len(column))
        yield Slice(start, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start])
        start = stop


class Words:
    """The words of a slice: byte spans, row numbers, hashes of their lower-cased bytes."""

    def __init__(self, part: Slice, table: np.ndarray, lower: bool = True):
        data = LOWER[part.data] if lower else part.data
        self.data = data
        is_word = table[data]
        before = np.empty_like(is_word)
        after = np.empty_like(is_word)
        if len(data):
            before[0], before[1:] = False, is_word[:-1]
            after[-1], after[:-1] = False, is_word[1:]
            cuts = part.bounds[1:-1]
            before[cuts[cuts < len(data)]] = False
            after[cuts[cuts > 0] - 1] = False
        self.starts = np.flatnonzero(is_word & ~before)
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.first = np.searchsorted(self.starts, part.bounds)  # of each row, and the end
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(part.rows), self.counts)

        self._sums: np.ndarray | None = None

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their bytes up to `ends`."""
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTES[self.data] * _power("up", _ODD, n), out=self._sums[1:])
        inverse = _power("down", _INVERSE, n + 1)
        return mix((self._sums[self.ends if ends is None else ends] - self._sums[self.starts]) * inverse[self.starts])


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their task, and stand beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def list_array(flat: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def held_out(id_column: str, modulus: int, remainder: int):
    """Condition: crc32 of the id as text leaves the remainder."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % modulus == remainder, F.lit(False))


def aliased(df, taken: dict):
    """df with the columns {name here: name in df} only, so that further or clashing columns don't matter."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{name}`").alias(here) for here, name in taken.items()])
