"""Vectorised word splitting and hashing over Arrow text columns (helpers inside Spark tasks)."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the working memory of a task whatever the batch holds.
BLOCK_BYTES = 512 << 10
_CHUNK = 256 << 10
#: Longer spans are hashed by BLAKE2b: sums of powers modulo 2^64 can be made to collide from a thousand bytes on.
_LONG = 512
_MULT = 0x9E3779B97F4A7C15 | 1

WHITESPACE = np.zeros(256, bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Free:
    """Gives memory that is free inside a worker back to the system: workers outlive their tasks, and what one stage has freed
    would else be missing to the next one's Spark."""

    def __init__(self):
        self.last, self.trim = 0.0, None
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it keeps
            self.trim = ctypes.CDLL(None).malloc_trim

    def __call__(self) -> None:
        if time.monotonic() - self.last > 0.5:
            pa.default_memory_pool().release_unused()
            if self.trim is not None:
                self.trim(0)
            self.last = time.monotonic()


@cache
def _free() -> _Free:
    return _Free()


@dataclass
class Block:
    """Rows ``first`` .. ``first + n - 1`` of a batch: their bytes, and each row's place in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a binary or string column into blocks of about ``max_bytes``; a null row is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offs, body = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    body = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield Block(at, body[offs[at] : offs[end]], offs[at : end + 1] - offs[at])
        at = end
    _free()()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the published splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_table(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULT, -1, 1 << 64)
    out = []
    for base in (_MULT, inverse):
        p = np.full(_CHUNK + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no separator), and where each row's words begin."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes (A-Z as a-z where ``lower``); equal bytes, equal hash, wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    values, (power, inverse) = _byte_table(lower), _powers()
    at = 0
    while at < len(starts):
        base = starts[at]
        end = int(np.searchsorted(ends, base + _CHUNK, "right"))
        if end <= at:  # one span longer than a chunk
            at += 1
            continue
        part = values[data[base : ends[end - 1]]]
        part *= power[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[at:end] - base, ends[at:end] - base
        out[at:end] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = end
    for i in np.flatnonzero(ends - starts > _LONG).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw.lower() if lower else raw, digest_size=8).digest(), "little")
    return out


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive values, by order; none if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(_MULT) + words[k : k + n])
    return out
