"""Training-order materialisation: token ids in fixed-stride binary shards.

Every document becomes sequences of ``LENGTH`` token ids (the last is padded).
The ids of a document are stored once in the shared folder, a row for each.
Sequences are numbered without gaps in the order of (id, hash of the text,
place in the document), so the numbers are the same however the input's files
are cut: rows that agree in both are alike.  Only ids, hashes and counts are
sorted for it.  A Feistel network keyed by ``key`` permutes the numbers: it
permutes the least power of four that holds them all, and walks the cycle until
it falls below their count, so every sequence gets a slot of its own and every
slot a sequence, from its number alone.

Sequences are dealt by ranges of slots, one shard to a task.  The records that
one batch has for a shard are a compressed block.  Blocks are written to the
shared folder, a file for each attempt of a task; then the ids go, before any
shard is written, and only the places of the blocks travel.  A shard's task
reads its blocks and puts each record where it belongs: the record of slot s stands at byte
``(s - first) * stride`` of its shard, so nothing is sorted and a task holds one
shard.  A reader that knows where it stopped goes on from there.  A shard is
written under a name of the attempt and then renamed, so a task that is run
again leaves the same shard; what failed attempts left goes at the end.

A record: id (signed 64 bits), place of the sequence in the document and
number of its tokens (unsigned 32 bits each), then LENGTH ids (unsigned 16 bits
if all fit, else 32), all little-endian; unused ids are 0.

Null and empty texts have no tokens and no sequence.  Bytes that are not UTF-8
are read as U+FFFD.  A null id is written as -1.  Rows that are repeated have
sequences of their own.  Columns of the input other than doc_id and text are not
looked at, and not returned.  An empty table gives no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import read_ranks
from .store import drop, fresh, keep
from .store import files as _files

LENGTH = 256
SHARD_BYTES = 32 << 20
KEY = 0x5EED_0F_0DE4
ROUNDS = 6
ZSTD = 6
GATHER = 16 << 20  # bytes of records that are cut into blocks together
HEAD = np.dtype([("doc_id", "<i8"), ("seq_no", "<u4"), ("n_tokens", "<u4")])


def feistel(number: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot of each number in [0, count): the network permutes [0, 4**half), and numbers that leave the range walk on."""
    half = max(1, ((count - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            h = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((key + r * 0xD1B54A32D192ED03) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) >> np.uint64(7) & mask)
        return (left << np.uint64(half)) | right

    out = once(number.astype(np.uint64))
    far = np.flatnonzero(out >= count)
    while len(far):
        out[far] = once(out[far])
        far = far[out[far] >= count]
    return out.astype(np.int64)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text_hash, n_tokens, ids) of docs (doc_id, text) that have tokens; path: a rank file, read on the driver."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    wide = id_bytes(ranks.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from public_tokenizers import PATTERN

        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})

        def batch(out: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

        for b in batches:
            out: list[list] = [[], [], [], []]
            held = 0
            for doc, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
                ids = np.array(own.encode_ordinary((text.as_py() or b"").decode("utf-8", "replace")), f"<u{wide}")
                if not len(ids):
                    continue
                for column, x in zip(out, (doc, name, len(ids), ids.tobytes()), strict=True):
                    column.append(x)
                held += ids.nbytes
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [[], [], [], []], 0
            yield batch(out)

    names = ["doc_id", "text_hash", "n_tokens", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_tokens long, ids binary")


def id_bytes(ranks: dict[bytes, int]) -> int:
    return 2 if max(ranks.values()) < 1 << 16 else 4


def numbered(stored: DataFrame, length: int) -> tuple[str, int]:
    """A folder with the numbers of the first sequences of the stored rows, apart for each of their files, and how many sequences there are.

    Ranges of (doc_id, text_hash) are counted apart, and then each row within its
    range: no task has more than its range.  The ids stay where they are.
    """
    spark, into = stored.sparkSession, fresh(stored.sparkSession, "numbers")
    where = [file_name().alias("file"), F.col("_metadata.row_index").alias("place")]
    count = F.ceil(F.col("n_tokens") / length).cast("long").alias("n")
    order = ["doc_id", "text_hash", "file", "place"]
    ranged = stored.select("doc_id", "text_hash", *where, count).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = keep(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    first, firsts = 0, []
    for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        firsts.append((r["part"], first))
        first += r["n"]
    starts = spark.createDataFrame(firsts, "part int, start long")
    before = F.expr("sum(n) over (partition by part order by doc_id, text_hash, file, place rows between unbounded preceding and current row)") - F.col("n")
    found = ranged.withColumn("before", before).join(F.broadcast(starts), "part").select("file", "place", (F.col("start") + F.col("before")).alias("first"))
    found.repartition("file").write.partitionBy("file").parquet(into)
    drop(ranged)
    return into, first


def file_name():
    return F.element_at(F.split("_metadata.file_path", "/"), -1)


def numbers_of(into: str, file: str) -> np.ndarray:
    """The first numbers of a file's rows, by their place in it."""
    files, top = _files(into)
    parts = [x.path for x in files.get_file_info(pa.fs.FileSelector(f"{top}/file={file}")) if x.base_name.startswith("part-")]
    table = pa.concat_tables([pq.read_table(x, filesystem=files, columns=["place", "first"], partitioning=None) for x in parts])
    out = np.full(int(table["place"].to_numpy().max()) + 1, -1)
    out[table["place"].to_numpy()] = table["first"].to_numpy()
    return out


def materialise(docs: DataFrame, path: str, into: str | None = None, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of docs into a folder; returns one row for each sequence, in no order:
    doc_id, seq_no, n_tokens, slot, shard, at (byte in the shard) and crc32 of the record."""
    spark = docs.sparkSession
    into = into or fresh(spark, "token-shards")
    stored = keep(token_ids(docs, path), "token-ids", compression="zstd", **{"parquet.compression.codec.zstd.level": str(ZSTD)})
    numbers, count = numbered(stored, length)
    wide = id_bytes(read_ranks(path))
    stride = HEAD.itemsize + wide * length
    per_shard = max(1, shard_bytes // stride)
    shards = max(1, -(-count // per_shard))
    files, folder = _files(into)
    files.create_dir(folder)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(slots, heads, rows of ids) of about GATHER bytes of records at a time."""
        held, size, own, firsts = [], 0, None, None
        for b in batches:
            for doc, raw, file, place in zip(b.column(0).fill_null(-1).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if file != own:
                    own, firsts = file, numbers_of(numbers, file)
                first, ids = firsts[place], np.frombuffer(raw.as_buffer(), f"<u{wide}")
                n = -(-len(ids) // length)
                records = np.zeros((n, length), f"<u{wide}")
                records.ravel()[: len(ids)] = ids
                heads = np.zeros(n, HEAD)
                heads["doc_id"], heads["seq_no"], heads["n_tokens"] = doc, np.arange(n), length
                heads["n_tokens"][-1] = len(ids) - (n - 1) * length
                held.append((first + np.arange(n), heads, records))
                size += n * stride
                if size >= GATHER:
                    yield tuple(map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        squeeze = zstandard.ZstdCompressor(level=ZSTD).compress
        store, top = _files(placed)
        name, at = uuid.uuid4().hex, 0
        with store.open_output_stream(f"{top}/{name}") as out:
            for number, heads, records in sequences(batches):
                slot = feistel(number, count, key)
                order = np.argsort(slot, kind="stable")
                shard, first = np.unique(slot[order] // per_shard, return_index=True)
                parts = [order[x:y] for x, y in zip(first.tolist(), [*first[1:].tolist(), len(slot)], strict=True)]
                sizes = [out.write(squeeze((slot[p] % per_shard).astype("<u4").tobytes() + heads[p].tobytes() + records[p].tobytes())) for p in parts]
                ends = at + np.cumsum(sizes)
                columns = [shard.astype(np.int32), [name] * len(parts), ends - sizes, np.array(sizes, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "file", "begin", "size"])
                at = int(ends[-1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zlib

        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        store, top = _files(into)
        shared, blocks_at = _files(placed)

        def done(shard: int, held: np.ndarray) -> pa.RecordBatch:
            name = f"{top}/_shard-{shard:06d}-{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                out.write(held.tobytes())
            store.move(name, f"{top}/shard-{shard:06d}.bin")
            heads = np.ascontiguousarray(held[:, : HEAD.itemsize]).view(HEAD).ravel()
            slot = shard * per_shard + np.arange(len(held))
            crc = np.array([zlib.crc32(r) for r in held], np.int64)
            columns = [heads["doc_id"].astype(np.int64), heads["seq_no"].astype(np.int32), heads["n_tokens"].astype(np.int32), slot, np.full(len(held), shard), np.arange(len(held)) * stride, crc]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "seq_no", "n_tokens", "slot", "shard", "at", "crc32"])

        shard, held, name, blocks_of = -1, None, None, None
        for b in batches:
            for number, file, begin, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    if blocks_of is not None:
                        blocks_of.close()
                    name, blocks_of = file, shared.open_input_file(f"{blocks_at}/{file}")
                if number != shard:
                    if held is not None:
                        yield done(shard, held)
                    shard, held = number, np.zeros((min(per_shard, count - number * per_shard), stride), np.uint8)
                raw = np.frombuffer(expand(blocks_of.read_at(size, begin)), np.uint8)
                n = len(raw) // (4 + stride)
                at = raw[: 4 * n].view("<u4")
                held[at, : HEAD.itemsize] = raw[4 * n : (4 + HEAD.itemsize) * n].reshape(n, -1)
                held[at, HEAD.itemsize :] = raw[(4 + HEAD.itemsize) * n :].reshape(n, -1)
        if held is not None:
            yield done(shard, held)
        if blocks_of is not None:
            blocks_of.close()

    placed = fresh(spark, "blocks")
    shared_files, blocks_folder = _files(placed)
    shared_files.create_dir(blocks_folder)
    packed = stored.select("doc_id", "ids", file_name().alias("file"), F.col("_metadata.row_index").alias("place")).mapInArrow(blocks, "shard int, file string, begin long, size long")
    packed = keep(packed, "places")
    drop(stored)
    shared_files.delete_dir(_files(numbers)[1])
    dealt = packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "file", "begin")
    index = keep(dealt.mapInArrow(write, "doc_id long, seq_no int, n_tokens int, slot long, shard long, at long, crc32 long"), "shard-index")
    drop(packed)
    shared_files.delete_dir(blocks_folder)
    for left in files.get_file_info(pa.fs.FileSelector(folder)):
        if left.base_name.startswith("_shard-"):
            files.delete_file(left.path)
    return index


def read(spark: SparkSession, folder: str, start: int = 0, stop: int | None = None, length: int = LENGTH, wide: int = 2, shard_bytes: int = SHARD_BYTES) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(slot, doc_id, seq_no, ids) from slot ``start`` on, in order: for a training loop, which can stop and go on anywhere."""
    files, top = _files(folder)
    stride = HEAD.itemsize + wide * length
    per_shard = max(1, shard_bytes // stride)
    slot = start
    while stop is None or slot < stop:
        name = f"{top}/shard-{slot // per_shard:06d}.bin"
        if files.get_file_info(name).type == pa.fs.FileType.NotFound:
            return
        with files.open_input_file(name) as f:
            f.seek((slot % per_shard) * stride)
            while (stop is None or slot < stop) and len(record := f.read(stride)) == stride:
                head = np.frombuffer(record[: HEAD.itemsize], HEAD)[0]
                yield slot, int(head["doc_id"]), int(head["seq_no"]), np.frombuffer(record[HEAD.itemsize :], f"<u{wide}")[: int(head["n_tokens"])]
                slot += 1
        if slot % per_shard:
            return
