"""Token-ID files: patched frame-of-reference blocks, in ascending id order.

Texts are encoded where they lie; ids, two bytes each for small vocabularies,
are shuffled by ranges of doc_id, sorted inside each range and written as one
file a range. A file is a run of records, each ended by a line feed so that
Spark's own writer and commit protocol can place raw bytes on any file system.
Record: u32 number of documents, then segments (see pfor): document lengths,
ids of documents as two halves, flags of null ids, token ids.
"""

from __future__ import annotations

import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .common import cut, new_path, small_batches
from .tokens import default_vocabulary, encoder, text_list

#: Documents in a range, about; and token ids in a record.
SHARD_DOCS, RECORD_IDS = 8192, 1 << 18
#: Most ranges, whose bounds every task holds; beyond, ranges grow and are written as several files of
#: RECORDS records, so no file nears the 2 GB that can be read at once.
SHARDS, RECORDS = 100_000, 512


def shard_bounds(docs: DataFrame, shard_docs: int = SHARD_DOCS) -> tuple[np.ndarray, int]:
    """doc_ids that part the table into about equal ranges, ascending, and the number
    of ranges that null ids take, which come last. An id that fills several
    ranges repeats in the bounds. Only the choice of bounds is approximate: ids are
    compared with them as 64-bit integers."""
    n, nulls = docs.agg(F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    shards = min(SHARDS, max(1, ceil(n / shard_docs)))
    steps = [i / shards for i in range(1, shards)]
    bounds = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", steps, 0.1 / shards) if n and steps else []
    # doubles may lie above the largest long
    return np.array(sorted(max(-(2**63), min(2**63 - 1, int(x))) for x in bounds), np.int64), ceil(nulls / shard_docs)


def _records(batches, dtype):
    """Packs sorted rows (shard, doc_id, ids) into records of one shard each."""
    held, size, shard = [], 0, None

    def record():
        lengths = np.array([len(x) // dtype.itemsize for _, x in held], np.uint32)
        ids = np.array([i or 0 for i, _ in held], np.int64).view(np.uint64)
        null = np.array([i is None for i, _ in held], np.uint32)
        parts = [lengths, (ids & np.uint64(0xFFFFFFFF)).astype(np.uint32), (ids >> np.uint64(32)).astype(np.uint32), null, np.frombuffer(b"".join(x for _, x in held), dtype).astype(np.uint32)]
        return np.array([len(held)], "<u4").tobytes() + b"".join(map(pfor.encode, parts))

    for b in batches:
        out = []
        for s, i, x in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
            if held and (s != shard or size >= RECORD_IDS):
                out.append(record())
                held, size = [], 0
            shard = s
            held.append((i, x))
            size += len(x) // dtype.itemsize
        if out:
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
    if held:
        yield pa.RecordBatch.from_pydict({"record": pa.array([record()], pa.binary())})


def write_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, shard_docs: int = SHARD_DOCS) -> None:
    """Encodes whole texts (null: empty), appends ``end_id`` to each and writes
    them under ``path`` in ascending order of doc_id, nulls last, rows of one id
    by a hash of the text."""
    vocab = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    small_batches(spark)
    bounds, null_shards = shard_bounds(docs, shard_docs)

    def run(batches):
        enc = encoder(vocab)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            key = b.column("doc_id").cast(pa.int64())
            x, null = key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False)
            u = b.column("h").to_numpy().view(np.uint64).astype(np.float64) / 2.0**64
            lo, hi = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
            lo, hi = np.where(null, len(bounds) + (null_shards > 0), lo), np.where(null, len(bounds) + null_shards, hi)
            # an id that fills whole ranges is dealt over them in hash order
            shard = np.where(hi > lo, lo + np.minimum((u * (hi - lo + 1)).astype(np.int64), hi - lo), lo)
            ids = [e + end for e in enc.encode(text_list(b.column("text")))]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "doc_id": key, "h": b.column("h"), "ids": pa.array(ids, pa.binary())})
        enc.words.old = {}

    dtype = encoder(vocab).dtype
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "shard int, doc_id long, h long, ids binary")
    # the hash as an unsigned number, as the shards take it
    order = F.shiftrightunsigned("h", 1)
    n = len(bounds) + 1 + null_shards
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_last("doc_id"), order)
    packed = rows.mapInArrow(lambda batches: _records(batches, dtype), "record binary")
    packed.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", RECORDS).text(path)


def read_records(content: bytes):
    """(doc_ids, lengths, token ids) of each record of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        at += 4
        parts = []
        for _ in range(5):
            parts.append(pfor.decode(view, at))
            at += pfor.size_of(view, at)
        at += 1  # the line feed
        lengths, low, high, null, ids = parts
        doc = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
        yield [None if z else int(d) for d, z in zip(doc, null)], lengths, ids


def read_files(spark, path: str) -> DataFrame:
    """One row per document of the files under ``path``: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                # part-<task>-...-c<number of the task's file>.<...>
                part, tail = file.rsplit("/part-", 1)[1].split("-", 1)
                shard, total = int(part) << 32 | int(tail.rsplit("-c", 1)[1].split(".")[0]), 0
                for doc, lengths, ids in read_records(content):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends)]
                    yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(doc), shard), pa.int64()), "doc_id": pa.array(doc, pa.int64()), "at": pa.array(starts + total, pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})
                    total += int(ends[-1]) if len(ends) else 0

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = cut(files.mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    # one row per file meets in one task: those of SHARDS ranges and of null ids, and one for each RECORDS * RECORD_IDS ids
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    offsets = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = rows.join(F.broadcast(offsets), "shard")
    return out.select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the files and returns what read_files() reads back from them.

    Null and empty texts hold the end id alone; null ids come last; rows with one
    id follow one another; an empty table writes no record and returns no row.
    doc_id must be an integer type; other columns are left out."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_files(docs, path, vocabulary, end_id)
    return read_files(spark, path)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return token_files(table(spark, sf_dir, "documents"))
