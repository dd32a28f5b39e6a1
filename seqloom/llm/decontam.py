r"""Benchmark decontamination by Wu-Manber search over words.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
Every ``WINDOW`` consecutive words of an item are a test string; an item of
fewer words, but not none, is one test string.  A document word inside any
occurrence of a test string is hit.

The search looks at the text's words as at letters.  For test strings of one
length, a table gives for each block of two words how far the search may jump
because no test string has that block nearer to its end; blocks that end a test
string (jump 0) select, by their hash, the test strings to compare word by word
with the text, and then byte by byte.  All documents of a chunk are searched in
step, each with its own position.

The benchmark is cut by a hash of its texts into parts of about ``PART_BYTES``,
the proven bound of what is broadcast at once; documents pass the parts one
after another, and carry what the earlier parts have found.  Each part sees
every document once, whatever its size.

Null and empty texts have no words and no hits.  A repeated item id counts
once; a null one is written as an empty string.  Without benchmark items
nothing is hit.  Columns of the input that have the name of a computed one are
replaced; the others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import textscan as ts
from .store import keep

WINDOW = 10
PART_BYTES = 4 << 20
PARTS_A_STAGE = 4
TABLE_BITS = 20
FIELDS = "n_words long, hit_words binary, items array<string>"


def words_of(c: ts.Chunk) -> tuple[ts.Spans, np.ndarray]:
    """The words of a chunk, and the chunk in lower case."""
    low = ts.LOWER[c.buf]
    return ts.runs(ts.ALNUM[low], c.at), low


class SearchTable:
    """Test strings of ``length`` words: shift table, suffix buckets, the strings and their items."""

    def __init__(self, length: int, hashes: np.ndarray, strings: list[bytes], items: list[list[str]]) -> None:
        self.length, self.block, self.hashes, self.strings, self.items = length, min(2, length), hashes, strings, items
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8)
        for last in range(length - 1, self.block - 2, -1):
            at = self.blocks(hashes.ravel(), np.arange(len(hashes)) * length + last)
            slot = (at >> ts.U64(64 - TABLE_BITS)).astype(np.int64)
            self.shift[slot] = np.minimum(self.shift[slot], length - 1 - last)
        np.minimum.at(self.shift, (self.blocks(hashes.ravel(), np.arange(len(hashes)) * length + length - 1) >> ts.U64(64 - TABLE_BITS)).astype(np.int64), 0)
        suffix = self.blocks(hashes.ravel(), np.arange(len(hashes)) * length + length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix, self.first = np.unique(suffix[self.order], return_index=True)
        self.first = np.append(self.first, len(suffix))

    def blocks(self, words: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the blocks that end at the positions last."""
        return ts.mix(words[last] * ts.U64(ts._R) + words[last - 1]) if self.block == 2 else ts.mix(words[last])

    def search(self, words: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the last word, and the string, of each probable occurrence in rows of word hashes."""
        pos, end = row_at[:-1] + self.length - 1, row_at[1:]
        live = pos < end
        pos, end = pos[live], end[live]
        found = []
        while len(pos):
            jump = self.shift[(self.blocks(words, pos) >> ts.U64(64 - TABLE_BITS)).astype(np.int64)]
            at = pos[jump == 0]
            if len(at):
                found.append(at)
            pos = pos + np.maximum(jump, 1)
            live = pos < end
            if not live.all():
                pos, end = pos[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        block = self.blocks(words, at)
        k = np.minimum(np.searchsorted(self.suffix, block), len(self.suffix) - 1)
        at, k = at[self.suffix[k] == block], k[self.suffix[k] == block]
        n = self.first[k + 1] - self.first[k]
        at, k = np.repeat(at, n), np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        string = self.order[k]
        same = np.ones(len(at), bool)
        for j in range(self.length):
            same &= words[at - j] == self.hashes[string, self.length - 1 - j]
        return at[same], string[same]


def tables(items: list[tuple], window: int = WINDOW) -> list[SearchTable]:
    """Search tables, one for each length of test strings, from (item id, text)."""
    strings: dict[tuple[bytes, ...], set[str]] = {}
    for c in ts.chunks(pa.array([t for _, t in items], pa.string())):
        spans, low = words_of(c)
        raw = low.tobytes()
        for i in range(len(c)):
            words = [raw[a:b] for a, b in zip(spans.start[spans.row_at[i] : spans.row_at[i + 1]].tolist(), spans.end[spans.row_at[i] : spans.row_at[i + 1]].tolist(), strict=True)]
            name = items[c.first + i][0]
            for j in range(max(1, len(words) - window + 1) if words else 0):
                strings.setdefault(tuple(words[j : j + window]), set()).add("" if name is None else str(name))
    found = []
    for length in sorted({len(s) for s in strings}):
        own = [s for s in strings if len(s) == length]
        flat = pa.array([w for s in own for w in s], pa.binary())
        c = next(ts.chunks(flat, 1 << 62))
        hashes = ts.span_hash(ts.prefix(c.buf), c.at[:-1], c.at[1:]).reshape(-1, length)
        found.append(SearchTable(length, hashes, [b" ".join(s) for s in own], [sorted(strings[s]) for s in own]))
    return found


def search_chunk(c: ts.Chunk, found: list[SearchTable]) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Of a chunk: where rows begin among the words, which words are hit, the items of each row."""
    spans, low = words_of(c)
    words = ts.span_hash(ts.prefix(low), spans.start, spans.end)
    step = np.zeros(len(words) + 1, np.int64)
    items: list[set] = [set() for _ in range(len(c))]
    for t in found:
        at, string = t.search(words, spans.row_at)
        rows = np.searchsorted(spans.row_at, at, "right") - 1
        for last, s, row in zip(at.tolist(), string.tolist(), rows.tolist(), strict=True):
            first = last - t.length + 1
            if b" ".join(low[spans.start[j] : spans.end[j]].tobytes() for j in range(first, last + 1)) == t.strings[s]:
                step[first] += 1
                step[last + 1] -= 1
                items[row].update(t.items[s])
    return spans.row_at, np.cumsum(step)[:-1] > 0, items


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, hit_words (a bit for each word, the first in a byte's highest) and items (sorted as strings)."""
    new = StructType.fromDDL(FIELDS)
    docs = docs.drop(*new.names)
    kept = docs.columns
    schema = StructType([*docs.schema.fields, *new.fields])
    arrow = to_arrow_schema(new)
    benchmark = benchmark.select("item_id", "text").filter("text is not null")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = 1 + size // PART_BYTES

    def one(part: int):
        found = docs.sparkSession.sparkContext.broadcast(tables([tuple(r) for r in benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()], window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda x, n: x.column(x.schema.get_field_index(n))
                for c in ts.chunks(get(batch, text)):
                    piece = batch.slice(c.first, len(c))
                    row_at, hit, items = search_chunk(c, found.value)
                    bits = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else b"" for a, b in zip(row_at[:-1].tolist(), row_at[1:].tolist(), strict=True)]
                    if part:
                        before = get(piece, "hit_words").to_pylist()
                        bits = [b or a if not (a and b) else (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes() for a, b in zip(before, bits, strict=True)]
                        items = [x | set(y) for x, y in zip(items, get(piece, "items").to_pylist(), strict=True)]
                    arrays = [get(piece, n) for n in kept] + [pa.array(np.diff(row_at), pa.int64()), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in items], arrow.field("items").type)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *arrow.names])
                ts.settle()

        return run

    for part in range(parts):
        docs = docs.mapInArrow(one(part), schema)
        if part % PARTS_A_STAGE == PARTS_A_STAGE - 1 and part + 1 < parts:
            docs = keep(docs, "searched")
    return docs.drop(*drop)


def digest(marked: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated beside what `mark` gives."""
    hit = F.expr("aggregate(sequence(1, octet_length(hit_words)), 0L, (n, i) -> n + bit_count(conv(hex(substring(hit_words, i, 1)), 16, 10) :: long))")
    out = marked.withColumn("n_hit", F.when(F.octet_length("hit_words") > 0, hit).otherwise(F.lit(0).cast("long")))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", F.col("n_hit") > 0)
