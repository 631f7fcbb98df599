"""Vectorised reading of Arrow text columns: bytes, words and 64-bit word hashes in numpy."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a single longer text is handled alone.
BLOCK = 1 << 20

_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK + 1), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if len(got) <= BLOCK + 1:
            _powers[base] = got
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; nulls are empty."""
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if big else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts of about ``size`` bytes."""
    raw, at = view(column)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of maximal runs of ``inside`` that don't cross a text's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    ends = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end]: a polynomial modulo 2 ** 64, mixed with the length."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_STEP, n), out=total[1:])
    value = (total[end] - total[start]) * powers(_STEP_INVERSE, n + 1)[start]
    return mixed(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def tidy(run: Callable) -> Callable:
    """A worker function that gives unused memory of Arrow and of the C library back when its task ends; workers live on."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def table(characters: bytes) -> np.ndarray:
    """256 booleans: which byte values are among ``characters``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(characters, np.uint8)] = True
    return out


IS_SPACE = table(b" \t\n\x0b\x0c\r")
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32
IS_LETTER = table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
IS_DIGIT = table(b"0123456789")
IS_UPPER = table(bytes(range(65, 91)))
