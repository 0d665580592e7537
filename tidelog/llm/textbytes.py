"""Texts of an Arrow batch as one array of bytes, and sums of a table's rows over their n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at together; a longer text is looked at alone.
BYTES_AT_ONCE = 500_000


def runs(column: pa.Array, most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of a binary column: row i's bytes are bytes[bounds[i]:bounds[i + 1]]; nulls are empty."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def spaced(data: np.ndarray, bounds: np.ndarray, space: int, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, last + 1): `ends` copies of `space` stand before each text and after the last."""
    n = len(bounds) - 1
    out = np.full(len(data) + ends * (n + 1), space, data.dtype)
    text = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(data)) + ends * (text + 1)] = data
    first = bounds[:-1] + ends * np.arange(1, n + 1)
    return out, first, first + np.diff(bounds)


def sums(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of values[first[i]:stop[i]] along the first axis, zero for empty ranges; the ranges are in order and apart."""
    out = np.zeros((len(first), *values.shape[1:]), np.float64)
    some = np.flatnonzero(stop > first)
    if len(some):
        cuts = np.stack([first[some], stop[some]], axis=1).ravel()
        if cuts[-1] == len(values):
            cuts = cuts[:-1]
        out[some] = np.add.reduceat(values, cuts, axis=0, dtype=np.float64)[::2]
    return out
