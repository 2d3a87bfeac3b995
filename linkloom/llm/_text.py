"""Words, hashes and windows of whole text columns, computed array-at-a-time.

A batch is the concatenated UTF-8 bytes of its documents plus their offsets, as Arrow stores
them. Nothing loops over words in Python: hashes of words and of word or byte windows come
from prefix sums of ``value * BASE**position`` modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 18

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK:  # tables for one very long document aren't kept
            _powers[name] = have
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: well spread bits from any 64-bit values."""
    x = x ^ np.uint64(salt * 0xD1342543DE82EF95 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _power("base", _BASE, len(values))[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal contents have equal hashes wherever they stand."""
    inverse = _power("inverse", _INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every window of ``size`` values."""
    n = len(sums) - size
    return mix((sums[size:] - sums[:-size]) * _power("inverse", _INVERSE, len(sums))[:n] + np.uint64(size))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes and int64 offsets of an Arrow string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of at most CHUNK bytes or one row."""
    if len(column) == 0:
        return
    data, offsets = bytes_of(column)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: starts, ends, hashes, and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, of: np.ndarray | None = None):
        """``of``: the bytes to hash in place of ``data``."""
        inside = ~_SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        before[heads] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[heads[heads > 0] - 1] = False
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.sums = prefix_sums(_VALUES[of if of is not None else _LOWER[data] if lower else data])

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.sums, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(_VALUES[data])


def room(bounds: np.ndarray, size: int, total: int) -> np.ndarray:
    """For each of the values, whether a window of ``size`` that starts there stays in its row."""
    ok = np.zeros(total, bool)
    if total:
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(total)
        ok = left >= size
    return ok


def sliding_argmin(keys: np.ndarray, size: int) -> np.ndarray:
    """Leftmost place of the least of every ``size`` consecutive 64-bit keys, compared by their upper 32 bits."""
    packed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    width = 1
    while width < size:
        step = min(width, size - width)
        packed = np.minimum(packed[:-step], packed[step:])
        width += step
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())
