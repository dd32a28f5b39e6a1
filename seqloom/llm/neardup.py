r"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct shingles of five words
(``[^\x20\x09-\x0D]+``, A-Z lower-cased); with fewer words the whole sequence is
its one shingle; without words the set is empty and linked with nothing.  Two
documents are linked if ``100 * |A & B| >= 75 * |A | B|``.

* A set is compressed to ``BANDS * ROWS`` registers.  Each shingle's hash picks
  a register; of the least hash there, the register stores the count of leading
  zeros and the ``MANTISSA`` bits after them.  Registers that got nothing borrow
  from another that did, in an order fixed by a hash (so that sets that share
  most elements share most borrowed registers too).
* Documents of equal sets are one class, found by one aggregation.
* Classes that share a band of registers are candidates.  At similarity 0.75
  a pair is missed with probability (1 - 0.75**5)**40, about 2 in 100,000, and
  less above.
* Candidates whose estimate, corrected for registers that agree by chance, is
  under ``SURE`` are left (0.75 lies 6 standard deviations above); the others
  are tested on their whole texts.
* Groups are the connected components (see `links`).

Null ids: no id can name them, so they are linked with nothing, and kept.  Rows
that share an id stand each by its own set; a row is told by its id and a
64-bit hash of its text.  Empty tables give empty results; columns of the input that have the name of a computed one are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links
from . import textscan as ts
from .scan import with_text_columns
from .store import drop, keep

SHINGLE = 5
THRESHOLD = 75
BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
SURE = 0.55
_SALT = ts.U64(0xA0761D6478BD642F)


def shingles(c: ts.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) of a chunk, in no order."""
    words = ts.runs(ts.NOT_SPACE[c.buf], c.at)
    hashes = ts.span_hash(ts.prefix(ts.LOWER[c.buf]), words.start, words.end)
    first, values = ts.windows(hashes, words.row_at, SHINGLE)
    rows = np.searchsorted(words.row_at, first, "right") - 1
    for n in range(1, SHINGLE):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            v = np.full(len(short), n, ts.U64)
            for j in range(n):
                v = v * ts.U64(ts._R) + hashes[words.row_at[short] + j]
            rows, values = np.concatenate([rows, short]), np.concatenate([values, ts.mix(v)])
    at = np.unique(ts.mix(values + rows.astype(ts.U64) * _SALT), return_index=True)[1]
    return rows[at], values[at]


def registers(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) of leading-zero counts and mantissas; EMPTY in rows without elements."""
    h = ts.mix(values ^ _SALT)
    where = ((h >> ts.U64(48)) * ts.U64(REGISTERS)) >> ts.U64(16)
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    low = ts.mix(h) >> ts.U64(1)
    np.minimum.at(least, rows * REGISTERS + where.astype(np.int64), low)
    got = least != np.iinfo(np.uint64).max
    bits = np.maximum(least >> ts.U64(11), ts.U64(1)).astype(np.float64).view(np.uint64)
    zeros = ts.U64(1023 + 51) - np.minimum(bits >> ts.U64(52), ts.U64(1023 + 51))
    regs = np.where(got, (zeros << ts.U64(MANTISSA)) | ((bits >> ts.U64(52 - MANTISSA)) & ts.U64((1 << MANTISSA) - 1)), ts.U64(EMPTY)).astype(np.uint16).reshape(n, REGISTERS)
    got = got.reshape(n, REGISTERS)
    row, col = np.nonzero(~got & got.any(axis=1)[:, None])
    step = 0
    while len(row):
        step += 1
        source = (ts.mix(col.astype(ts.U64) * ts.U64(ts._R) + ts.U64(step)) % ts.U64(REGISTERS)).astype(np.int64)
        filled = got[row, source]
        regs[row[filled], col[filled]] = regs[row[filled], source[filled]]
        row, col = row[~filled], col[~filled]
    return regs


def sketch_chunk(c: ts.Chunk) -> dict:
    n = len(c)
    rows, values = shingles(c)
    one, two = np.zeros(n, ts.U64), np.zeros(n, ts.U64)
    np.add.at(one, rows, ts.mix(values))
    np.add.at(two, rows, ts.mix(values ^ _SALT))
    regs = registers(rows, values, n)
    return {"n_shingles": np.bincount(rows, minlength=n), "set_one": one.view(np.int64), "set_two": two.view(np.int64), "regs": binaries(regs)}


def binaries(regs: np.ndarray) -> pa.Array:
    size = regs.shape[1] * regs.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(regs), [None, pa.py_buffer(np.ascontiguousarray(regs))]).cast(pa.binary())


def sketches(docs: DataFrame, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_shingles, two 64-bit hashes of the set, and its registers."""
    return with_text_columns(docs, text, "n_shingles long, set_one long, set_two long, regs binary", lambda: sketch_chunk, drop)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def bands(classes: DataFrame, slots: links.Slots | None = None) -> DataFrame:
    """(key, id, size): the bands of (id, size, regs), of those keys that slots may have."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                regs = _regs(part.column(2)).astype(ts.U64).reshape(-1, BANDS, ROWS)
                key = np.tile(np.arange(BANDS, dtype=ts.U64), (len(regs), 1))
                for j in range(ROWS):
                    key = key * ts.U64(ts._R) + regs[:, :, j]
                key = ts.mix(key).ravel().view(np.int64)
                own = np.flatnonzero(slots.may_have(key)) if slots else np.arange(len(key))
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), part.column(0).take(pa.array(own // BANDS)), part.column(1).take(pa.array(own // BANDS))], names=["key", "id", "size"])
            ts.settle()

    return classes.select("id", "size", "regs").mapInArrow(run, "key long, id long, size long")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, corrected for those that agree by chance.

    Two unrelated minima agree in a register with probability about
    ``sum over zeros of 2**-2(z+1) / 2**MANTISSA``, a third of 2**-MANTISSA for
    minima that are uniform; minima of large sets crowd together, so the chance
    is taken from how often the pair's own leading-zero counts agree.
    """
    same = (a == b).mean(axis=1)
    crowd = ((a >> MANTISSA) == (b >> MANTISSA)).mean(axis=1)
    chance = crowd / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose estimate is SURE or more."""
    classes = links.Slots(ends(pairs), "id").left_of(classes.select("id", "regs"), "id")
    side = lambda k: classes.select(F.col("id").alias(k), F.col("regs").alias(f"regs_{k}"))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                good = pa.array(estimate(_regs(part.column(2)), _regs(part.column(3))) >= SURE)
                yield part.select([0, 1]).filter(good)
            ts.settle()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    """(id) of both sides of pairs (a, b)."""
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs (id, doc_id, text) that stand for an id of ids: `id` is the text's hash, doc_id tells copies apart."""
    return keep(links.Slots(ids, "id").left_of(docs, "id").join(ids, ["id", "doc_id"], "left_semi").select("id", "text"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; docs has id, doc_id and text."""
    texts = texts_of(classes.select("id", "doc_id").join(ends(pairs), "id", "left_semi"), docs)
    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))

    def run(batches):
        for b in batches:
            # both texts of a pair in one row of a chunk's length at most
            lo, size = 0, np.asarray(pa.compute.binary_length(b.column(2)).fill_null(0)).astype(np.int64) + np.asarray(pa.compute.binary_length(b.column(3)).fill_null(0))
            ends = np.cumsum(size)
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ts.CHUNK_BYTES, "right")))
                part = b.slice(lo, hi - lo)
                keys, counts = [], []
                for k in (2, 3):
                    one = [shingles(c) + (c.first,) for c in ts.chunks(part.column(k))]
                    rows = np.concatenate([r + at for r, _, at in one])
                    keys.append((rows, np.concatenate([ts.mix(v + (r + at).astype(ts.U64) * _SALT) for r, v, at in one])))
                    counts.append(np.bincount(rows, minlength=part.num_rows))
                hit = np.isin(keys[0][1], keys[1][1], assume_unique=True)
                both = np.bincount(keys[0][0][hit], minlength=part.num_rows)
                yield part.select([0, 1]).filter(pa.array(100 * both >= THRESHOLD * (counts[0] + counts[1] - both)))
                lo = hi
            ts.settle()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def confirmed_blocks(rows: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """For `links.linked`: the whole sets of two blocks are intersected by products of 0/1 matrices."""
    texts = texts_of(classes.select("id", "doc_id").join(rows.select("id").distinct(), "id", "left_semi"), docs)

    def compare(table: pa.Table) -> pa.Table:
        ids, comps, own = table["id"].to_numpy(), table["comp"].to_numpy(), table["own"].to_numpy()
        n, found = len(ids), [np.zeros(0, np.int64), np.zeros(0, ts.U64)]
        at = 0
        got = []
        for piece in table["text"].chunks:
            got += [(r + c.first + at, v) for c in ts.chunks(piece) for r, v in [shingles(c)]]
            at += len(piece)
        found = [np.concatenate(x) for x in zip(*got, strict=True)]
        size = np.bincount(found[0], minlength=n)
        column, count = np.unique(found[1], return_inverse=True, return_counts=True)[1:]
        often = count[column] > 1
        row, column = found[0][often], (np.cumsum(count > 1) - 1)[column[often]]
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for lo in range(0, int((count > 1).sum()), 2048):
            a, b = np.searchsorted(column, (lo, lo + 2048))
            x = np.zeros((n, 2048), np.float32)
            x[row[a:b], column[a:b] - lo] = 1
            both += x @ x.T
        apart = (comps[:, None] != comps[None, :]) & ((own == own[0]).all() | (own[:, None] != own[None, :]))
        fit = np.triu(100 * both >= THRESHOLD * (size[:, None] + size[None, :] - both), 1) & apart & (both > 0)
        forest = links.Forest(comps.tolist())
        new = [(min(x, y), max(x, y)) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(fit)), strict=True) if forest.join(comps[i], comps[j]) for x, y in [(int(ids[i]), int(ids[j]))]]
        ts.settle()
        return pa.table({"a": pa.array([x for x, _ in new], pa.int64()), "b": pa.array([y for _, y in new], pa.int64())})

    return rows.join(texts, "id").select("key", "left", "right", "own", "id", "comp", "text").groupBy("key", "left", "right").applyInArrow(compare, "a long, b long").distinct()


def told(docs: DataFrame) -> DataFrame:
    """docs with text_hash, which with doc_id tells a row."""
    return docs.withColumn("text_hash", F.xxhash64("text"))


def marked(docs: DataFrame) -> DataFrame:
    """The rows of `near_duplicates`, with text_hash."""
    table = keep(sketches(told(docs.select("doc_id", "text")), drop=("text",)), "sketches")
    sets = ["n_shingles", "set_one", "set_two"]
    named = table.filter("n_shingles > 0 and doc_id is not null")
    # of equal sets one row is the node: the least, named by its text's hash, as an id may have several sets
    heads = named.groupBy(*sets).agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    own = F.struct("doc_id", "text_hash") == F.col("head")
    classes = keep(named.join(heads, sets).filter(own).select(F.col("text_hash").alias("id"), "doc_id", F.col("n_shingles").alias("size"), "regs"), "classes")
    fits = lambda x, y: 100 * F.least(x("size"), y("size")) >= THRESHOLD * F.greatest(x("size"), y("size"))
    texts = told(docs.select("doc_id", "text")).select(F.col("text_hash").alias("id"), "doc_id", "text")
    groups = links.linked(lambda slots: bands(classes, slots), fits, lambda pairs: confirmed(keep(near(pairs, classes), "near"), texts, classes), lambda rows: confirmed_blocks(rows, texts, classes))
    # the least row of each component of several nodes
    linked = keep(heads.join(groups, F.col("head.text_hash") == F.col("id")).select(*sets, "head", "comp"), "linked")
    linked = linked.join(linked.groupBy("comp").agg(F.min("head").alias("least")), "comp").select(*sets, "least")
    heads = heads.join(linked, sets, "left").select(*sets, F.coalesce("least", "head").alias("least"))
    heads = heads.withColumnsRenamed({x: f"h_{x}" for x in sets})
    same = [F.col("doc_id").isNotNull(), *(F.col(x) == F.col(f"h_{x}") for x in sets)]
    labelled = table.drop("regs").join(heads, same, "left").withColumn("component_id", F.coalesce("least.doc_id", "doc_id"))
    return labelled.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.struct("doc_id", "text_hash") == F.col("least"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    component_id: the least id of the row's component; kept: true for the least
    row of each component (by id, then by a hash of the text).
    """
    return marked(docs).drop("text_hash")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the least by id, then by a hash of its text.

    Rows that share an id fall only if their own set's group has another row.
    Of rows that agree in id and text one stays; rows without an id stay.
    """
    rows = told(docs.drop("text_hash"))
    key = ["doc_id", "text_hash"]
    gone = marked(docs).filter("not kept").select(*key).distinct()
    left = rows.join(gone, key, "left_anti")
    again = rows.filter("doc_id is not null").groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    twice = left.join(again, key, "left_semi")
    once = left.join(again, key, "left_anti")
    names = [f"`{n}`" for n in docs.columns]
    one = twice.groupBy(*key).agg(F.min(F.struct(*(n for n in names if n != "`text_hash`"))).alias("one")).select("one.*")
    return once.select(*names).union(one.select(*names))
