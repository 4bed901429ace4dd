"""Vectorized word and window hashes of a column of texts, for use inside Arrow tasks."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: Texts are hashed in pieces of about so many bytes.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@cache
def _letters() -> np.ndarray:
    return np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = (1 << bits) + 1
    up, down = np.full(n, base, _U), np.full(n, pow(base, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] per pair, by prefix sums of a polynomial modulo 2^64."""
    up, down = _powers(base, max(20, int(values.size - 1).bit_length()))
    total = np.zeros(values.size + 1, _U)
    np.cumsum(values * up[: values.size], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column end to end, and the offsets of its texts; null is empty."""
    col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    ink = ~_BLANK[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = off[:-1][off[:-1] < off[1:]]  # a word also ends where its text ends
    first[edge] |= ink[edge]
    tail = off[1:][off[:-1] < off[1:]] - 1
    last[tail] |= ink[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(_letters()[data], start, end, 0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, at: np.ndarray, span: int, twice: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """64-bit (or twice 64-bit) hashes of the runs of ``span`` words that start at ``at``."""
    one = span_hash(words, at, at + span, 0xC2B2AE3D27D4EB4F)
    return one, span_hash(mix(words + _U(span)), at, at + span, 0x165667B19E3779F9) if twice else None


def pieces(off: np.ndarray):
    """Ranges (i, j) of whole texts of about PIECE bytes."""
    i, n = 0, off.size - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        yield i, j
        i = j
