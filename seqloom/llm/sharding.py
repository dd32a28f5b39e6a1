"""Shards of near equal size through fixed virtual slots.

Records are hashed into ``SLOTS`` virtual slots, whatever the number of shards.
Bytes and rows are summed by slot; the map from slots to shards is made from
those sums (the largest slot first, each to the shard with the fewest bytes),
stored under a version, and edited when shards are added or the sums drift:
only the slots that must move change their shard.

A record's size is the UTF-8 bytes of its text plus ``OVERHEAD``; a null text
has none.  The hash is over id and text, so rows of one id, null ids and copies
of one text spread; only rows that agree in both stay together.  The law that
holds is ``bytes``: shards differ by about the size of one slot.  What reaches
the driver is ``SLOTS`` sums, never more.  Empty tables give maps of empty slots.
Columns of the input other than doc_id and text are not looked at, and not returned.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh, keep

SLOTS = 16_384
SHARDS = 40
OVERHEAD = 16
MAP = "version long, vslot long, shard int, bytes long, rows long, first long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every row."""
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    out = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("text").alias("h"))
    return out.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "h"), F.lit(slots)).alias("vslot"))


def slot_sums(recs: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot, empty ones too."""
    got = recs.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return {s: (0, 0) for s in range(slots)} | {r["vslot"]: (r["b"], r["n"]) for r in got}


def assign(sums: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, int]:
    """A first map: the largest slot first, to the shard with the fewest bytes (ties: fewest rows, lowest)."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot, (b, n) in sorted(sums.items(), key=lambda x: (-x[1][0], x[0])):
        have, rows, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (have + b, rows + n, shard))
    return out


def rebalance(old: dict[int, int], sums: dict[int, tuple[int, int]], shards: int, slack: float = 0.01) -> dict[int, int]:
    """The old map edited for the sums and number of shards of today.

    Slots leave the fullest shard for the emptiest, the largest that helps
    first, until no shard is over the mean by more than ``slack`` or no move
    helps; slots of shards that are no more leave first.  All others stay.
    """
    new = dict(old)
    have = {s: 0 for s in range(shards)}
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    homeless = []
    for slot, shard in old.items():
        if shard < shards:
            have[shard] += sums[slot][0]
            own[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-sums[s][0], s)):
        to = min(have, key=lambda s: (have[s], s))
        new[slot], have[to] = to, have[to] + sums[slot][0]
        own[to].append(slot)
    mean = sum(have.values()) / shards
    while True:
        full, empty = max(have, key=lambda s: (have[s], -s)), min(have, key=lambda s: (have[s], s))
        room = have[full] - have[empty]
        fit = [s for s in own[full] if 0 < sums[s][0] < room]
        if have[full] <= mean * (1 + slack) or not fit:
            return new
        want = min(have[full] - mean, mean - have[empty])
        slot = min(fit, key=lambda s: (abs(sums[s][0] - want), s))
        own[full].remove(slot)
        own[empty].append(slot)
        new[slot] = empty
        have[full] -= sums[slot][0]
        have[empty] += sums[slot][0]


def as_table(spark: SparkSession, where: dict[int, int], sums: dict[int, tuple[int, int]], version: int = 1, into: str | None = None) -> DataFrame:
    """The map with the place of each slot's first row in its shard, written to version=... of the folder ``into``.

    A version that is there already is not written over: that is an error.
    """
    next_row: dict[int, int] = {}
    rows = []
    for slot in sorted(where):
        shard, (b, n) = where[slot], sums[slot]
        rows.append((version, slot, shard, b, n, next_row.get(shard, 0)))
        next_row[shard] = next_row.get(shard, 0) + n
    into = into or fresh(spark, "slot-maps")
    spark.createDataFrame(rows, MAP).drop("version").write.parquet(f"{into}/version={version}")
    return load(spark, into, version)


def load(spark: SparkSession, into: str, version: int | None = None) -> DataFrame:
    """A stored map, by its version or the newest, as `as_table` gave it."""
    every = spark.read.option("basePath", into).schema(MAP).parquet(into)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version).select(*(x.split()[0] for x in MAP.split(", ")))


def slots_of(stored: DataFrame) -> dict[int, int]:
    """A stored map as slot to shard, to be edited: one entry for each virtual slot."""
    return {r["vslot"]: r["shard"] for r in stored.select("vslot", "shard").collect()}


def place(recs: DataFrame, where: DataFrame) -> DataFrame:
    """recs with version, shard, and slot: a row's place in its shard, gapless from 0.

    The places within one virtual slot come from a window over that slot, so
    no task holds more than the slots dealt to it.
    """
    recs = recs.drop("version", "shard", "slot")
    rank = F.expr("row_number() over (partition by vslot order by doc_id, text_crc32, size)").cast("long")
    slots = where.select("vslot", "version", "shard", "first")
    return recs.withColumn("rank", rank).join(slots, "vslot").withColumn("slot", F.col("first") + F.col("rank") - 1).drop("rank", "first")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, into: str | None = None) -> DataFrame:
    """The rows of docs with a first map made for them, or, where ``into`` has maps, with the newest edited to fit."""
    recs = keep(records(docs, slots), "records")
    sums = slot_sums(recs, slots)
    old = load(docs.sparkSession, into) if into and _there(docs.sparkSession, into) else None
    if old is None:
        return place(recs, as_table(docs.sparkSession, assign(sums, shards), sums, 1, into))
    version = old.agg(F.max("version")).first()[0] + 1
    return place(recs, as_table(docs.sparkSession, rebalance(slots_of(old), sums, shards), sums, version, into))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
