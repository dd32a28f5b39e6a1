"""Byte-level BPE encoding and decoding in two tiers.

Text is cut into pre-tokens by the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

whose matches are found for a whole chunk at once from the class of each code
point.  Then

1. a minimal perfect hash over the vocabulary (hash and displace: every key has
   a slot of its own, and every slot a key) resolves the pre-tokens that are
   entries already; the entry's bytes are compared, so a foreign pre-token is
   never taken for one;
2. a pre-token that isn't an entry is merged with a heap of candidate merges
   over linked bytes: the least rank first, the leftmost of equals.  What was
   found is kept for the task, up to ``CACHE`` pre-tokens at a time.

Equal pre-tokens of a chunk are told by 64-bit hashes; a text whose ids don't
decode to its own bytes (two that collide) is encoded once more without them.

Nulls and empty texts have no ids.  Columns of the input that have the name of
a computed one are replaced; the others stay.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .scan import with_text_columns

CACHE = 300_000
BATCH = 2 << 20  # bytes of text encoded at once: more of it repeats in longer pieces
LETTER, NUMBER, SPACE, OTHER = range(4)
#: What the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, as the library's own pattern engine tells it: it encodes what a pattern finds, and nothing else."""
    if not _classes:
        import tiktoken

        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000)
        for what, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
            bytewise = tiktoken.Encoding(f"class {kind}", pat_str=what, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            table[np.frombuffer(bytes(bytewise.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def pre_tokens(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens begin, in order; every row's bytes are covered."""
    if not len(buf):
        return np.zeros(0, np.int64)
    head = np.flatnonzero((buf & 0xC0) != 0x80)  # where characters begin
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != len(head):
        raise ValueError("text is not UTF-8")
    kind = classes()[points]
    row_start = np.zeros(len(points) + 1, bool)
    row_start[np.searchsorted(head, at)] = True
    n = len(points)
    cut = row_start[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut)
    stop = np.append(run[1:], n)
    begin = cut.copy()
    # white space before more text of the row: its last character stands alone, or joins what follows if it is a blank
    space = (kind[run] == SPACE) & (stop < n)
    space[space] = ~row_start[stop[space]]
    last = stop[space] - 1
    begin[last] = True
    blank = last[points[last] == 0x20]
    begin[blank + 1] = False
    # an apostrophe that stands alone takes an ending from the letters after it
    quote = run[(points[run] == 0x27) & (stop - run == 1) & (stop < n)]
    quote = quote[~row_start[quote + 1] & (kind[np.minimum(quote + 1, n - 1)] == LETTER)]
    quote = quote[begin[quote]]
    if len(quote):
        padded = np.append(points, [0, 0])
        letters = np.append(kind, [OTHER, OTHER])
        one, two = padded[quote + 1], padded[quote + 2]
        both = (letters[quote + 2] == LETTER) & ~np.append(row_start, [True])[quote + 2]
        size = np.zeros(len(quote), np.int64)
        for e in ENDINGS:
            fits = one == ord(e[0])
            if len(e) == 2:
                fits &= (two == ord(e[1])) & both
            size[fits] = len(e)
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        rest = quote + 1 + size
        inside = (rest < n) & ~row_start[np.minimum(rest, n)] & (kind[np.minimum(rest, n - 1)] == LETTER)
        begin[rest[inside]] = True
    return head[begin]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings, with the strings to compare and their ids."""

    LOAD = 4

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys = sorted(ranks)
        self.n = len(keys)
        c = next(ts.chunks(pa.array(keys, pa.binary()), 1 << 62))
        h = ts.span_hash(ts.prefix(c.buf), c.at[:-1], c.at[1:])
        if len(np.unique(h)) < self.n:
            raise ValueError("entries collide")
        self.buckets = max(1, self.n // self.LOAD)
        self.shift = np.zeros(self.buckets, np.uint32)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free, slots = np.ones(self.n, bool), np.zeros(self.n, np.int64)
        for b in np.argsort(-np.diff(first), kind="stable").tolist():
            own = order[first[b] : first[b + 1]]
            if not len(own):
                break
            start, width = 0, 64
            while True:
                tries = self._slot(h[own][None, :], np.arange(start, start + width)[:, None])
                good = free[tries].all(axis=1)
                if len(own) > 1:
                    ordered = np.sort(tries, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = start + k
                    free[tries[k]], slots[own] = False, tries[k]
                    break
                start, width = start + width, min(65536, width * 2)
        self.hash = np.zeros(self.n, ts.U64)
        self.hash[slots] = h
        self.ids = np.zeros(self.n, np.uint32)
        self.ids[slots] = [ranks[k] for k in keys]
        placed: list[bytes] = [b""] * self.n
        for k, s in zip(keys, slots.tolist(), strict=True):
            placed[s] = k
        self.keys = placed

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % ts.U64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (ts.mix(h + (shift.astype(ts.U64) + ts.U64(1)) * ts.U64(ts._R)) % ts.U64(self.n)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The one slot that a string of each hash can have."""
        return self._slot(h, self.shift[self._bucket(h)])


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token, by the least rank first over linked bytes."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that begins here
    prev = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if dead[i]:
            continue
        j = end[i]
        if j >= n or end[j] != stop or dead[j]:
            continue  # one of its parts has changed since
        end[i], dead[j] = stop, 1
        if stop < n:
            prev[stop] = i
            if (r := get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0 and (r := get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """Encodes and decodes chunks; built once from ranks, then sent to the executors."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.table = ranks, PerfectHash(ranks)
        top = max(ranks.values()) + 1
        parts = [b""] * top
        for k, i in ranks.items():
            parts[i] = k
        self.part_at = np.zeros(top + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.part_at[1:])
        self.parts = np.frombuffer(b"".join(parts), np.uint8)
        self.merged: dict[int, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"merged": {}}

    def encode(self, c: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's rows, one after another, and where rows begin among them."""
        start = pre_tokens(c.buf, c.at)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(c) + 1, np.int64)
        stop = np.append(start[1:], len(c.buf))
        h = ts.span_hash(ts.prefix(c.buf), start, stop)
        one, at, which = np.unique(h, return_index=True, return_inverse=True)
        slot = self.table.slots(one)
        known = self.table.hash[slot] == one
        raw, keys = c.buf.tobytes(), self.table.keys
        a, b = start[at].tolist(), stop[at].tolist()
        for k in np.flatnonzero(known).tolist():
            known[k] = raw[a[k] : b[k]] == keys[slot[k]]
        n = np.ones(len(one), np.int64)
        if len(self.merged) > CACHE:
            self.merged.clear()
        cache, ranks, long = self.merged, self.ranks, {}
        for k in np.flatnonzero(~known).tolist():
            name = int(one[k])
            ids = cache.get(name)
            if ids is None:
                ids = cache[name] = array("I", merge(raw[a[k] : b[k]], ranks)).tobytes()
            long[k] = ids
            n[k] = len(ids) // 4
        first = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.uint32)
        flat[first[known]] = self.table.ids[slot[known]]
        if long:
            where = np.flatnonzero(~known)
            size = n[where]
            flat[np.repeat(first[where], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(long.values()), np.uint32)
        size = n[which]
        end = np.cumsum(size)
        out = flat[np.repeat(first[which] - (end - size), size) + np.arange(size.sum())]
        rows = np.searchsorted(start, c.at)
        return out, np.concatenate([[0], end])[rows]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of rows of ids, and where rows begin among them."""
        ids = ids.astype(np.int64)
        size = self.part_at[ids + 1] - self.part_at[ids]
        end = np.cumsum(size)
        out = self.parts[np.repeat(self.part_at[ids] - (end - size), size) + np.arange(int(size.sum()))]
        return out, np.concatenate([[0], end])[at]

    def checked(self, c: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """`encode`, with rows whose ids don't decode to their bytes encoded without hashes."""
        ids, at = self.encode(c)
        back, back_at = self.decode(ids, at)
        if np.array_equal(back, c.buf) and np.array_equal(back_at, c.at):
            return ids, at
        self.merged.clear()
        rows = []
        for i in range(len(c)):
            own = ids[at[i] : at[i + 1]]
            text = c.buf[c.at[i] : c.at[i + 1]]
            if back[back_at[i] : back_at[i + 1]].tobytes() != text.tobytes():
                start = pre_tokens(text, np.array([0, len(text)])).tolist()
                raw = text.tobytes()
                words = [raw[x:y] for x, y in zip(start, [*start[1:], len(raw)], strict=True)]
                own = np.array([t for w in words for t in ([self.ranks[w]] if w in self.ranks else merge(w, self.ranks))], np.uint32)
            rows.append(own)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def encode(docs: DataFrame, path: str, text: str = "text", drop: tuple[str, ...] = (), decoded: str | None = None) -> DataFrame:
    """docs with ids: little-endian unsigned 32-bit integers.  path: a rank file, read on the driver.

    ``decoded``: a column for what `decode` makes of the ids, by the same worker: one process and one copy of the tables.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(path)))

    def make():
        def of(c: ts.Chunk) -> dict:
            ids, at = tokenizer.value.checked(c)
            coded = {"ids": slices(ids.astype("<u4").view(np.uint8), at * 4)}
            return coded | {decoded: slices(*tokenizer.value.decode(ids, at))} if decoded else coded

        return of

    return with_text_columns(docs, text, "ids binary" + (f", {decoded} binary" if decoded else ""), make, drop, BATCH)


def decode(coded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """coded with ``into``: the bytes that the ids stand for (null: none)."""
    tokenizer = coded.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(path)))

    def make():
        def of(c: ts.Chunk) -> dict:
            own, at = tokenizer.value.decode(c.buf.view("<u4") if c.buf.flags.c_contiguous and c.buf.ctypes.data % 4 == 0 else np.frombuffer(c.buf.tobytes(), "<u4"), c.at // 4)
            return {into: slices(own, at)}

        return of

    return with_text_columns(coded, ids, f"{into} binary", make)
