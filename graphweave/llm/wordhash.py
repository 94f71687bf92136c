"""Words and word n-grams of many texts at once, as numpy arrays over one buffer of bytes.

Used inside tasks: a batch of Arrow strings becomes word bounds and 64-bit word hashes without a Python
object per word. Hashes are sums of random per-byte values times powers of an odd number, modulo 2**64,
then mixed; n-gram hashes combine word hashes by doubling.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 2**64)
_A, _B = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x *= _A
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def powers(n: int) -> list[np.ndarray]:
    """The powers of R and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        steps = np.full((2, max(n, 1 << 20)), [[_R], [_R_INV]], np.uint64)
        steps[:, 0] = 1
        _powers[:] = list(np.cumprod(steps, axis=1, dtype=np.uint64))
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of an Arrow string array; nulls count as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw


def release() -> None:
    """Hands freed memory back to the system: workers stay for later tasks, and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a column (one value at least), which bounds a task's memory."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def words(off: np.ndarray, raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of each word: maximal runs without space and \\x09-\\x0D."""
    ink = ~_SPACE[raw]
    full = np.flatnonzero(off[1:] > off[:-1])
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    start[off[full]] = ink[off[full]]
    end[off[full + 1] - 1] = ink[off[full + 1] - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(s):
        return s, e, s, np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    return s, e, np.searchsorted(off, s, "right") - 1, mix(h + (e - s).astype(np.uint64) * _B)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive hashes, at each place where n follow (whatever texts they are in)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                k = len(h) - have - size + 1
                out, have = mix(out[:k] * _A + power[have : have + k] * _B), have + size
        size *= 2
        if size > n:
            return out
        k = len(h) - size + 1
        power = mix(power[:k] * _A + power[size // 2 : size // 2 + k] * _B)
