"""Index storage: Parquet tables with checked metadata, and the packed byte format."""

from __future__ import annotations

import struct
import time
import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import Index

# Fixed values of the packed format: magic, version, sizes in bytes, lanes of a vector, CRC polynomial (Castagnoli, reflected).
MAGIC, VERSION, HEADER, SLOT, LANES, ALIGN = b"RNH4", 1, 64, 64, 16, 32
POLYNOMIAL = 0x82F63B78
_HEAD = struct.Struct("<4sIIIQQQQI12x")
META = "folder string, written long, magic string, version int, nlists long, nvectors long, header_crc32c long"


class IndexFormatError(ValueError):
    """An index that fails a check; ``reason`` is magic, version, size, crc or bounds."""

    def __init__(self, reason: str):
        super().__init__(f"index: wrong {reason}")
        self.reason = reason


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _TABLE[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def header(nlists: int, nvectors: int) -> bytes:
    """The 64-byte header of a packed index, with its checksum."""
    lists_at = HEADER
    vectors_at = -(-(lists_at + nlists * SLOT) // ALIGN) * ALIGN
    labels_at = vectors_at + nvectors * 2 * LANES
    fields = (MAGIC, VERSION, nlists, nvectors, lists_at, vectors_at, labels_at, labels_at + nvectors)
    return _HEAD.pack(*fields, crc32c(_HEAD.pack(*fields, 0)))


def header_crc(head: bytes) -> int:
    """Checksum of a header, its own field counted as zeros."""
    return crc32c(head[:48] + b"\0" * 4 + head[52:HEADER])


def pack(centroids: np.ndarray, offsets, counts, frauds, vectors: np.ndarray, labels) -> bytes:
    """A whole index as bytes; vectors grouped by list, their first 16 dimensions. For
    small indexes that serve outside Spark."""
    centroids, vectors = (np.asarray(m)[:, :LANES] if len(m) else np.asarray(m) for m in (centroids, vectors))
    wide = lambda m: np.pad(np.asarray(m, "<i2").reshape(len(m), -1), ((0, 0), (0, LANES - np.asarray(m).shape[1] if len(m) else LANES))).astype("<i2")
    head = header(len(centroids), len(vectors))
    slots = b"".join(c.tobytes() + struct.pack("<IIII16x", o, n, f, 0) for c, o, n, f in zip(wide(centroids), offsets, counts, frauds))
    gap = b"\0" * (_HEAD.unpack(head)[5] - HEADER - len(slots))
    return head + slots + gap + (wide(vectors).tobytes() if len(vectors) else b"") + np.asarray(labels, np.uint8).tobytes()


def unpack(data: bytes, dims: int = 14):
    """(centroids, offsets, counts, frauds, vectors, labels) after the checks."""
    if len(data) < HEADER or data[:4] != MAGIC:
        raise IndexFormatError("magic")
    _, version, nlists, n, lists_at, vectors_at, labels_at, size, crc = _HEAD.unpack(data[:HEADER])
    if version != VERSION:
        raise IndexFormatError("version")
    if size != len(data):
        raise IndexFormatError("size")
    if header_crc(data) != crc:
        raise IndexFormatError("crc")
    if max(lists_at + nlists * SLOT, vectors_at + n * 2 * LANES, labels_at + n) > len(data):
        raise IndexFormatError("bounds")
    slots = np.frombuffer(data, np.dtype([("c", "<i2", LANES), ("o", "<u4"), ("n", "<u4"), ("f", "<u4"), ("_", "V20")]), nlists, lists_at)
    vectors = np.frombuffer(data, "<i2", n * LANES, vectors_at).reshape(n, LANES)[:, :dims]
    return slots["c"][:, :dims], slots["o"], slots["n"], slots["f"], vectors, np.frombuffer(data, np.uint8, n, labels_at)


def write_index(index: Index, path: str) -> None:
    """Tables lists and vectors (by list_id) in a folder of their own below ``path``,
    then a row of the table meta that names it. A reader takes the last row, so it
    sees the index before or the one after, whatever breaks off."""
    spark = index.lists.sparkSession
    version = uuid.uuid4().hex[:12]
    k = len(index.centroids)
    index.lists.write.parquet(f"{path}/{version}/lists")
    # by ranges of list and row, so that a list of most vectors is written by many tasks
    index.vectors.repartitionByRange("list_id", "row_id").sortWithinPartitions("list_id", "row_id").write.partitionBy("list_id").parquet(f"{path}/{version}/vectors")
    n = index.vectors.count()
    meta = [(version, time.time_ns(), MAGIC.decode(), VERSION, k, n, crc32c(header(k, n)[:48] + b"\0" * 16))]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("append").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> Index:
    """Reads the tables back and checks them against meta."""
    meta = spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("written")).first()
    if meta is None or meta.magic != MAGIC.decode():
        raise IndexFormatError("magic")
    if meta.version != VERSION:
        raise IndexFormatError("version")
    lists, vectors = spark.read.parquet(f"{path}/{meta.folder}/lists"), spark.read.parquet(f"{path}/{meta.folder}/vectors")
    rows = lists.orderBy("list_id").collect()
    if len(rows) != meta.nlists:
        raise IndexFormatError("size")
    if crc32c(header(meta.nlists, meta.nvectors)[:48] + b"\0" * 16) != meta.header_crc32c:
        raise IndexFormatError("crc")
    if sum(r.vec_count for r in rows) != meta.nvectors or any(r.vec_offset + r.vec_count > meta.nvectors for r in rows):
        raise IndexFormatError("bounds")
    return Index(np.array([r.centroid for r in rows], np.int64), lists, vectors.select(F.col("list_id").cast("int"), "pos", "row_id", "q", "label"))


def write_packed(index: Index, path: str) -> None:
    """The packed format as one row of the table ``path``, on any file system that
    Spark writes to. For indexes that fit the driver, to be served outside Spark."""
    spark = index.lists.sparkSession
    lists, rows = index.lists.orderBy("list_id").collect(), index.vectors.orderBy("pos").collect()
    data = pack(index.centroids, [r.vec_offset for r in lists], [r.vec_count for r in lists], [r.fraud_count for r in lists], np.array([r.q for r in rows], np.int64).reshape(len(rows), -1), [r.label for r in rows])
    spark.createDataFrame([(data,)], "packed binary").coalesce(1).write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, dims: int = 14) -> Index:
    """The index of a packed table, after the checks; rows are numbered by place."""
    row = spark.read.schema("packed binary").parquet(path).first()
    centroids, offsets, counts, frauds, vectors, labels = unpack(bytes(row[0]) if row else b"", dims)
    lists = [(j, [int(x) for x in c], int(o), int(n), int(f)) for j, (c, o, n, f) in enumerate(zip(centroids, offsets, counts, frauds))]
    owner = np.repeat(np.arange(len(counts)), counts)
    rows = [(int(j), i, i, [int(x) for x in v], int(y)) for i, (j, v, y) in enumerate(zip(owner, vectors, labels))]
    return Index(np.array(centroids, np.int64), spark.createDataFrame(lists, "list_id int, centroid array<int>, vec_offset long, vec_count long, fraud_count long"), spark.createDataFrame(rows, "list_id int, pos long, row_id long, q array<int>, label int"))
