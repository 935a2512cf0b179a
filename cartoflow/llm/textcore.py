"""Vectorised byte-level text primitives shared by the corpus operators.

Everything here works on one Arrow column at a time: the column's UTF-8 bytes are
viewed as a flat ``uint8`` array with document offsets, and words, n-grams and
rolling hashes are computed with numpy over whole blocks of documents instead of
per string.  All functions are pure and deterministic, so a task that is run again
after an executor was lost produces the same values.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The white space of the word definition ``[^\\x20\\x09-\\x0D]+``.
WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Documents are handled in blocks of about this many bytes (a longer one is a block of its own).
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITESPACE)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_TABLE_LOWER = _TABLE[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse for i below n, kept for the life of the worker."""
    if len(_powers[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hand_back() -> None:
    """Give the system what this process has freed but still holds."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries have none
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` as a task that hands memory back at its end: Spark keeps the worker process for tasks of later stages."""

    def whole(batches):
        yield from run(batches)
        _hand_back()

    return whole


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return flat[first : offsets[-1]], offsets - first


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Ranges of whole documents holding about ``size`` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, start and end byte of every word, in text order."""
    if not len(flat):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = _IS_WORD[flat]
    begin, stop = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    stop[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads], stop[tails] = word[heads], word[tails]
    starts = np.flatnonzero(begin)
    return np.searchsorted(offsets, starts, side="right") - 1, starts, np.flatnonzero(stop) + 1


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (letters A-Z lowered when asked)."""
    power, inverse = _power_tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((_TABLE_LOWER if lower else _TABLE)[flat] * power[: len(flat)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def rolling_hashes(flat: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` bytes (one fewer than width are missing at the end)."""
    if len(flat) < width:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_TABLE[flat] * power[: len(flat)], out=total[1:])
    n = len(flat) - width + 1
    return mix((total[width:] - total[:n]) * inverse[:n])


def combine(*parts: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of parallel 64-bit values."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def sliding(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` (np.minimum or np.maximum) over every window of ``width`` values, in two block scans."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.concatenate([values, np.full(-n % width, values[-1], values.dtype)]).reshape(-1, width)
    ahead = reduce.accumulate(padded, axis=1).ravel()
    back = reduce.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(back[: n - width + 1], ahead[width - 1 : n])
