"""Vectorised views of text columns inside tasks: bytes, words and 64-bit fingerprints.

All functions work on one Arrow column at a time, cut into slices of bounded bytes, so that the
memory of a task follows the longest single text and not the size of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64; kept between calls up to the usual slice."""
    known = _powers[base]
    if len(known) <= n:
        known = np.full(max(n, 2 * SLICE_BYTES) + 1, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if len(known) <= 8 * SLICE_BYTES:
            _powers[base] = known
    return known[: n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Slice:
    """Texts of consecutive rows as one byte array; text i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int):
        self.data, self.offsets, self.first_row = data, offsets, first_row

    def __len__(self):
        return len(self.offsets) - 1

    def lower(self) -> Slice:
        return Slice(_LOWER[self.data], self.offsets, self.first_row)

    def prefix_hashes(self) -> np.ndarray:
        """Running polynomial hash; see ``span_hashes``."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * powers(_BASE, n)[:n], out=sums[1:])
        return sums

    def span_hashes(self, starts, ends, sums=None) -> np.ndarray:
        """One fingerprint for each byte range, depending on its bytes and length only."""
        sums = self.prefix_hashes() if sums is None else sums
        h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(self.data))[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

    def words(self):
        """Starts, ends and row numbers (in the slice) of the words ``[^\\x20\\x09-\\x0D]+``."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~_SPACES[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = cut[:-1].copy()
        before[1:] |= ~inside[:-1]
        after = cut[1:].copy()
        after[:-1] |= ~inside[1:]
        starts = np.flatnonzero(inside & before)
        ends = np.flatnonzero(inside & after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """The column in slices of at most ``limit`` bytes, or of one text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            for chunk in column.chunks:
                yield from slices(chunk, limit)
            return
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    count = len(binary)
    if not count:
        return
    _, offsets, data = binary.buffers()
    offsets = np.frombuffer(offsets, np.int64)[binary.offset: binary.offset + count + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), count)
        yield Slice(data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first], first)
        first = last
