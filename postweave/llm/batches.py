"""Whole texts of Arrow columns as numpy arrays of bytes, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are handled together up to this many bytes; a longer text is handled alone. A dozen arrays of eight
# bytes per byte of text are held at a time, and a worker keeps much of what it once took.
CHUNK_BYTES = 250_000

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)

# The white space that ends words, as bytes.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple]:
    """``(first row, end row, bytes, offsets)`` of consecutive texts; null counts as empty.

    Text ``i`` of a chunk is ``bytes[offsets[i]:offsets[i + 1]]`` in UTF-8.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, raw, data = column.buffers()
    offsets = np.frombuffer(raw, np.int64)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), len(column))
        yield (start, end, values[offsets[start]:offsets[end]],
               offsets[start:end + 1] - offsets[start])
        start = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True that stays within one text.

    Also, for each text, the number of runs before it (with the total at the end).
    """
    size = len(inside)
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < size]] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.values = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, size: int) -> np.ndarray:
        if len(self.values) < size:
            factors = np.full(max(size, CHUNK_BYTES), self.base, np.uint64)
            factors[0] = 1
            self.values = np.multiply.accumulate(factors)
        return self.values


_powers, _inverse_powers = _Powers(_FACTOR), _Powers(_INVERSE)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``: a polynomial over random numbers per byte.

    A running sum gives every range by two lookups, whatever its length.
    """
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _powers.upto(len(data))[:len(data)], out=running[1:])
    inverse = _inverse_powers.upto(len(data) + 1)
    sums = (running[ends] - running[starts]) * inverse[starts]
    return mixed(sums + (ends - starts).astype(np.uint64) * np.uint64(_FACTOR))


def sliced_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``range_hashes`` of ranges in ascending order, a slice of ``data`` at a time to bound memory."""
    if len(data) <= 2 * CHUNK_BYTES:
        return range_hashes(data, starts, ends)
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK_BYTES)))
        first = starts[at]
        found.append(range_hashes(data[first:ends[end - 1]], starts[at:end] - first, ends[at:end] - first))
        at = end
    return np.concatenate(found)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours."""
    size = max(0, len(hashes) - width + 1)
    total = np.full(size, width, np.uint64)
    for i in range(width):
        total = total * np.uint64(_FACTOR) + hashes[i:i + size]
    return mixed(total)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def list_column(parts: list[np.ndarray]) -> pa.Array:
    """A column of 64-bit integer arrays."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
