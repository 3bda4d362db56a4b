"""Vectorised word splitting over Arrow string columns (numpy, no per-word Python objects)."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one vectorised step works on; a longer single text is a step of its own.
STEP_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x ^ (x >> U(31)) ^ (x >> U(62))
    x = x * U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> U(27)) ^ (x >> U(54))
    x = x * U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> U(30)) ^ (x >> U(60))


#: Bytes that are hashed at once: so many powers are kept, and what goes beyond them is one more factor.
HASHED = 1 << 15


def _powers(base: int) -> np.ndarray:
    a = np.full(HASHED, U(base), U)
    a[0] = 1
    return np.cumprod(a)


_POWER, _INVERSE = _powers(BASE), _powers(_INV)


_task: list[str] = []
_caches: list = []


def enter(name: str) -> None:
    """Called where an operator's function begins in a worker. Workers outlive their tasks: what another operator kept in
    this process (a cache, freed but unreturned memory) is given back before this one needs its own."""
    if _task == [name]:
        return
    _task[:] = [name]
    for clear in _caches:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def at_change(clear) -> None:
    """Registers what enter() calls."""
    _caches.append(clear)


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty), and each row's offset in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    if len(col) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, so that memory stays bounded."""
    limit = limit or STEP_BYTES
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Words:
    data: np.ndarray  # bytes
    off: np.ndarray  # of each text in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    ptr: np.ndarray  # each text's words are ptr[i]:ptr[i + 1]
    hash: np.ndarray  # 64 bits for each word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true, which end where a text ends; and each text's first run."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~inside[:-1]
    edge[off] = True
    start = np.flatnonzero(inside & edge[:n])
    edge[1:n] = ~inside[1:]
    edge[off] = True
    end = np.flatnonzero(inside & edge[1:]) + 1
    return start, end, np.searchsorted(start, off)


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of the byte ranges, mixed."""
    n = len(data)
    total = np.zeros(n + 1, U)
    for lo in range(0, n, HASHED):
        part = total[1 + lo : 1 + min(n, lo + HASHED)]
        part[:] = data[lo : lo + HASHED]
        part += U(1)
        part *= _POWER[: len(part)]
        part *= U(pow(BASE, lo, 1 << 64))
        part[:1] += total[lo : lo + 1]
        np.cumsum(part, out=part)
    out = total[end] - total[start]
    del total
    out *= _INVERSE[start & (HASHED - 1)]
    far = np.array([pow(_INV, lo, 1 << 64) for lo in range(0, n + 1, HASHED)], U)
    out *= far[start // HASHED]
    return mix(out)


def words(col: pa.Array, lower: bool = False, hashes: bool = True) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of each text; lower: A-Z become a-z before."""
    data, off = as_bytes(col)
    if lower:
        data = LOWER[data]
    start, end, ptr = runs(~SPACE[data], off)
    return Words(data, off, start, end, ptr, range_hash(data, start, end) if hashes else np.zeros(0, U))


def per_text(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values over each text's range."""
    if values.dtype.kind == "f":  # differences of running sums would lose digits
        out = np.zeros(len(ptr) - 1)
        some = np.flatnonzero(np.diff(ptr))
        if len(some):
            out[some] = np.add.reduceat(values, ptr[some])
        return out
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def id_crc(ids: pa.Array) -> np.ndarray:
    """crc32 of each integer id as text (null: of no bytes)."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()], np.int64)
