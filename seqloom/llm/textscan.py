"""Vectorised scanning of Arrow text columns.

A batch of texts is looked at as one byte buffer with row offsets, so that
splitting into words, hashing words and rolling over windows are a few NumPy
passes per chunk instead of Python work per word.  UTF-8 keeps ASCII bytes and
the bytes of longer characters apart, so every class of this package that is
given by ASCII characters can be tested byte by byte.

Nulls are scanned as empty texts.  A chunk holds whole rows, at most
``CHUNK_BYTES`` of them unless a single row is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_M = U64(0xD6E8FEB86659FD93)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits of lower-cased text, and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def settle() -> None:
    """Gives memory that a batch has freed back to the system; workers that wait for the next task stay small."""
    if not _settled:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _settled.append(ctypes.CDLL(None).malloc_trim)
        except (AttributeError, OSError):  # another C library
            _settled.append(lambda _: None)
    _settled[0](0)


_settled: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_R, _RINV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * _M
    x = x ^ (x >> U64(29))
    x = x * _M
    return x ^ (x >> U64(32))


@dataclass
class Chunk:
    """Rows ``first`` to ``first + len`` of a batch; row i is ``buf[at[i]:at[i+1]]``."""

    first: int
    buf: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


def chunks(column: pa.Array, size: int | None = None) -> Iterator[Chunk]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at_buf, data = column.buffers()
    at = np.frombuffer(at_buf, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, size = 0, size or CHUNK_BYTES
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Chunk(lo, whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Spans:
    """Pieces of a chunk in order; those of row i are ``row_at[i]`` to ``row_at[i+1]``."""

    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_at)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), self.counts)


def runs(mask: np.ndarray, at: np.ndarray) -> Spans:
    """Maximal runs of True, cut at row ends."""
    n = len(mask)
    if not n:
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    cut = at[(at > 0) & (at < n)]
    before[cut] = False
    start = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[cut - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return Spans(start, end, np.searchsorted(start, at))


def lines(c: Chunk) -> Spans:
    r"""The pieces between ``\n``; a row has one more than it has ``\n``."""
    nl = np.flatnonzero(c.buf == 10)
    start = np.concatenate([c.at[:-1], nl + 1])
    end = np.concatenate([c.at[1:], nl])
    rows = np.concatenate([np.arange(len(c)), np.searchsorted(c.at, nl, "right") - 1])
    start, end = start[np.lexsort((start, rows))], end[np.lexsort((end, rows))]
    return Spans(start, end, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(c)))]))


def prefix(buf: np.ndarray) -> np.ndarray:
    """Running polynomial sums, for `span_hash`."""
    p, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``, wherever they stand."""
    _, inv = powers(len(pre) - 1)
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U64))


def windows(hashes: np.ndarray, row_at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every k hashes in a row of the chunk: the first one's index, and a hash of them in order."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    first = np.ones(n, bool)
    for j in range(1, k):  # windows must not run over a row's end
        ends = row_at[1:] - j
        first[ends[(ends >= 0) & (ends >= row_at[:-1])]] = False
    first = np.flatnonzero(first)
    out = np.zeros(len(first), U64)
    for j in range(k):
        out = out * U64(_R) + hashes[first + j]
    return first, mix(out)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:])
    return run[at[1:]] - run[at[:-1]]
