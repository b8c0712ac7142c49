"""Whole text columns as byte arrays, a bounded piece at a time, for vectorised work inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into those bytes) over a string column; nulls have no bytes.

    A piece holds `most` bytes or a single row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield start, end, whole[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd base modulo 2^64, n of them at least, and those of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            step = np.full(max(n, 1 << 20), base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of each word of a text whose words are parted by spaces and whose lines by line ends."""
    word = (data != 32) & (data != 10)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(data))
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    return mixed((total[stops] - before) * down[starts]), np.searchsorted(np.flatnonzero(data == 10), starts)
