"""Vectorised text kernels on UTF-8 bytes: words, word hashes, shingles. Numpy only, no Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time, and bytes and rows of whole documents taken at a time.
SLICE, PIECE, ROWS = 1 << 20, 2 << 20, 4096
_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 4096), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(off: np.ndarray, most: int = PIECE, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` whole documents of about `most` bytes; a longer document stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1))
        yield i, j
        i = j


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run without ASCII white space, and n + 1 offsets of documents into the words."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~WHITE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    at = off[:-1][off[:-1] < len(buf)]
    first[at] = ink[at]
    last = ink
    tail = ink[off[1:][off[1:] > 0] - 1].copy()
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[off[1:][off[1:] > 0] - 1] = tail
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of each byte range: differences of a running polynomial, worked off in slices of bounded size."""
    out = np.empty(len(start), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            a = start[i]
            j = max(i + 1, int(np.searchsorted(end, a + SLICE, side="right")))
            b = end[j - 1]
            run = np.empty(b - a + 1, np.uint64)
            run[0] = 0
            np.cumsum(table[buf[a:b]] * powers(BASE, b - a)[: b - a], out=run[1:])
            s = start[i:j] - a
            out[i:j] = mix((run[end[i:j] - a] - run[s]) * powers(INVERSE, b - a)[s])
            i = j
    return out


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive values; n - length + 1 of them, none for shorter input."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for k in range(1, length):
            acc *= U(0xD6E8FEB86659FD93)
            acc += h[k : k + n]
        return mix(acc)


def inside(woff: np.ndarray, length: int) -> np.ndarray:
    """Of the windows over all words of a piece, those that lie in one document; woff: offsets of documents into the words."""
    n = int(woff[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for edge in np.unique(woff[1:-1]):
        ok[max(0, edge - length + 1) : max(0, min(n, edge))] = False
    return ok
