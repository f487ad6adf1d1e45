"""Numpy views of Arrow text columns: bytes, words and their hashes, without a Python object for each word.

A word is a run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = (LOWER.astype(np.uint64) + np.uint64(1)) * ~SPACE
#: Values of bytes for hashes by which A-Z differ from a-z.
EXACT = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * ~SPACE
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (splitmix finaliser)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(text: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, bytes, offsets)`` for runs of whole rows of about ``most`` bytes; a null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first bytes of words, and for each row the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, value: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the rows' first words as in :func:`word_starts`."""
    global _powers
    starts, rows = word_starts(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    lengths = np.diff(starts, append=len(data))
    if len(_powers) < (longest := int(lengths.max())):
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(value[data[starts[0] :]] * _powers[place], starts - starts[0])), rows


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (along axis 0) between neighbouring ``bounds``; empty runs give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=np.result_type(values.dtype, np.int64) if values.dtype == bool else values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values[: bounds[-1]], bounds[full], axis=0, dtype=out.dtype)
    return out
