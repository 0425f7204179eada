"""Words and bytes of Arrow text columns as numpy arrays.

Words are runs of bytes other than blank, tab and line ends, which equals runs of characters,
since no byte of a longer UTF-8 character is one of these. Work goes in segments, so that
temporary arrays stay small for any size of batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20_000_003).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < size:
        steps = np.full(size, _BASE)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = _INVERSE
        _inverses = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = values ^ (values >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 * SEGMENT) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes, and where each text begins and the last ends; null is empty."""
    column = column.cast(pa.binary()).cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, end = int(bounds[0]), int(bounds[-1])
    while lo < end:
        hi, reach = min(lo + SEGMENT, end), SEGMENT
        while hi < end:
            text = int(bounds[np.searchsorted(bounds, hi, "right") - 1])
            if text > lo:
                hi = text
                break
            blanks = np.flatnonzero(BLANK[data[lo:hi]])
            if len(blanks):
                hi = lo + int(blanks[-1]) + 1
                break
            reach *= 2  # a word longer than a segment
            hi = min(lo + reach, end)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words with A-Z in lower case, and each text's first word (and the end)."""
    hashes, places = [], []
    for lo, hi in _segments(data, bounds):
        part = data[lo:hi]
        inside = ~BLANK[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = bounds[np.searchsorted(bounds, lo, "right") : np.searchsorted(bounds, hi, "left")] - lo
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers, inverses = _tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[part] * powers[: len(part)], out=total[1:])
        value = (total[stop] - total[start]) * inverses[start]
        hashes.append(mix(value + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        places.append(start + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one run, no words none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        total = mix(total * _BASE + hashes[i : n - width + 1 + i])
    return total
