"""Groups from buckets of candidates, without pairing whole buckets.

Two rows are candidates if they share a bucket; a test decides which candidates
are linked; the result is the connected components of the links, as if every
pair of every bucket had been tested.

A bucket may hold a third of all rows, so pairs are tested in steps:

1. Every row is tested against one leader of each of its buckets.  That is one
   pair for each row and bucket, and joins most of what is joined in real groups.
2. Only buckets that still hold rows of different components are looked at
   again, and only pairs across components.  Buckets of up to `NARROW` rows
   give pairs, so at most `NARROW` for each row and bucket.
3. In larger ones, the rows outside the bucket's largest component are cut into
   blocks of about `BLOCK` rows, and so are the others; each of the former meets
   each of the latter, and of its own kind, in one task, which compares the two
   as a whole and returns a spanning forest of the links it found: never more
   links than rows.  So one stray in a bucket of n rows costs n rows, not n * n.

A leader is an aggregate with partial sums on the map side, and is joined to
the bucket's rows by a join that Spark may split where a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, keep

NARROW = 32
BLOCK = 512
SLOTS_A_KEY = 8
LEAST_BITS, MOST_BITS = 16, 27
FEW_LINKS = 1 << 19  # 8 MB of ids


class Slots:
    """Which slots the keys of a table fall on: SLOTS_A_KEY for each key, and 2**MOST_BITS (16 MB) at most.

    It goes before a join, to leave out most rows that have no partner while
    they are still where they were read; the join then decides.  Beyond the
    bound it leaves out fewer, and the join has more to do.
    """

    def __init__(self, keys: DataFrame, column: str) -> None:
        wanted = max(1, SLOTS_A_KEY * keys.count()).bit_length()
        self.bits = min(max(wanted, LEAST_BITS), MOST_BITS)
        at = F.col(column).bitwiseAND(F.lit((1 << self.bits) - 1))
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(bit).alias("w")).toArrow()
        bits = np.zeros(1 << (self.bits - 6), np.int64)
        bits[words["i"].to_numpy()] = words["w"].to_numpy()
        self.told = keys.sparkSession.sparkContext.broadcast(bits)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        at = keys & ((1 << self.bits) - 1)
        return ((self.told.value[at >> 6] >> (at & 63)) & 1).astype(bool)

    def left_of(self, rows: DataFrame, column: str, there: bool = True) -> DataFrame:
        """The rows whose key (a long; null: all) may be there; or, if not ``there``, the rows whose key is not."""
        number = rows.columns.index(column)

        def run(batches):
            for b in batches:
                key = b.column(number)
                hit = self.may_have(key.fill_null(0).to_numpy())
                if key.null_count:
                    hit |= ~np.asarray(key.is_valid())
                yield b.filter(pa.array(hit == there))

        return rows.mapInArrow(run, rows.schema)

    def __getstate__(self) -> dict:
        return {"told": self.told, "bits": self.bits}


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of links a[i], b[i], and for each the least id that they lead to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        one, other = label[x], label[y]
        low, new = np.minimum(one, other), label.copy()
        for where in (x, y, one, other):
            np.minimum.at(new, where, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _labelled_at_once(batches):
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_labels(*map(np.concatenate, zip(*ends, strict=True)))], names=["id", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of edges (a, b): comp is the least id that links lead to.

    Up to `FEW_LINKS` links are taken by one task: steps over all partitions
    would cost far more tasks than there is work.  Of more, least labels spread
    along edges and along labels until nothing changes: about as many steps as
    the logarithm of the longest path.  Each step is written to the shared folder.
    """
    once = keep(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if once.count() <= FEW_LINKS:
        labels = keep(once.coalesce(1).mapInArrow(_labelled_at_once, "id long, comp long"), "labels")
        drop(once)
        return labels
    both = once.union(once.select("b", "a"))
    labels = keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "id"), "labels")
    while True:
        other = labels.select(F.col("id").alias("b"), F.col("comp").alias("near"))
        near = both.join(other, "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", "comp", F.least("comp", "near").alias("c"))
        far = labels.select(F.col("id").alias("c"), F.col("comp").alias("far"))
        new = keep(step.join(far, "c", "left").select("id", F.least("c", F.coalesce("far", "c")).alias("comp"), (F.least("c", F.coalesce("far", "c")) < F.col("comp")).alias("moved")), "labels")
        done = new.filter("moved").isEmpty()
        drop(labels)
        labels = new.drop("moved")
        if done:
            drop(once)
            return labels


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def dealt(wide: DataFrame) -> DataFrame:
    """Rows (key, id, comp, ...) of wide buckets as (key, left, right, own, id, comp, ...): the blocks that are to meet.

    own is the row's block, left or right.  Blocks of the largest component have numbers below 0.
    """
    each = wide.groupBy("key", "comp").agg(F.count("*").alias("k"))
    most = each.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("n"))
    cut = lambda n: F.ceil(n / BLOCK).cast("long")
    few, many = cut(F.col("n") - F.col("most.k")), cut(F.col("most.k"))
    sized = wide.join(most.select("key", F.col("most.comp").alias("top"), few.alias("few"), many.alias("many")), "key")
    rest = [c for c in wide.columns if c != "key"]
    strays = sized.filter(F.col("comp") != F.col("top")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("few")))
    strays = strays.withColumn("other", F.explode(F.sequence(-F.col("many"), F.col("few") - 1)))
    crowd = sized.filter(F.col("comp") == F.col("top")).withColumn("own", -1 - F.pmod(F.xxhash64("id"), F.col("many")))
    crowd = crowd.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)))
    return strays.union(crowd).select("key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", *rest)


Attributes = Callable[[str], Column]


def linked(
    buckets: Callable[[Slots | None], DataFrame],
    fits: Callable[[Attributes, Attributes], Column],
    test: Callable[[DataFrame], DataFrame],
    test_blocks: Callable[[DataFrame], DataFrame],
    prepare: Callable[[DataFrame], None] = lambda ids: None,
) -> DataFrame:
    """(id, comp) of all ids that have a link; others are alone.

    buckets(slots): distinct (key, id, attributes...), each id's buckets, of those
    keys alone that slots may have (None: all keys, repeated or not, attributes
    are not looked at);
    ``fits(one, other)`` is a condition that every linked pair meets, on
    attributes named ``one(name)`` and ``other(name)``; ``prepare`` gets the ids
    that share a bucket, before any test; ``test`` takes distinct pairs (a, b)
    and returns those that are linked; ``test_blocks`` takes rows (key, left,
    right, own, id, attributes..., comp), of which those that agree in key, left
    and right (about 2 * BLOCK) are to be compared wherever their comp differs
    (and, if left is not right, their own), and returns links (a, b) that join
    what all their links would join.
    """
    ends = buckets(None).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    ends = keep(ends.select("key"), "keys")
    shared = keep(buckets(Slots(ends, "key")).join(ends, "key"), "buckets")
    drop(ends)
    prepare(shared.select("id").distinct())
    names = [c for c in shared.columns if c != "key"]
    lead = shared.groupBy("key").agg(F.min(F.struct(*names)).alias("lead"))
    pairs = shared.join(lead, "key").filter(F.col("id") != F.col("lead.id")).filter(fits(F.col, lambda n: F.col(f"lead.{n}")))
    tested = keep(pairs.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = keep(test(tested), "links")
    labels = components(links)

    rest = _labelled(shared, labels)
    mixed = rest.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    rest = keep(rest.join(mixed.select("key", "n"), "key"), "rest")
    drop(shared, labels)
    narrow, wide = rest.filter(F.col("n") <= NARROW), rest.filter(F.col("n") > NARROW)
    side = lambda k: narrow.select("key", *(F.col(n).alias(f"{n}_{k}") for n in [*names, "comp"]))
    one, other = (lambda n: F.col(f"{n}_a")), (lambda n: F.col(f"{n}_b"))
    across = side("a").join(side("b"), "key").filter((one("id") < other("id")) & (one("comp") != other("comp")) & fits(one, other))
    pairs = keep(across.select(one("id").alias("a"), other("id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    found = [keep(test(pairs), "links")]
    if not wide.isEmpty():
        found.append(keep(test_blocks(dealt(wide.select("key", *names, "comp"))), "links"))
    drop(rest, tested, pairs)
    for more in found:
        links = links.union(more)
    labels = components(links)
    drop(*found)
    return labels


class Forest:
    """Joins what links join; `join` tells whether a link was news."""

    def __init__(self, comps) -> None:
        self.up = {c: c for c in comps}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[y] = x
        return x != y
