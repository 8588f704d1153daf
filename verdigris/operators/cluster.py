"""Inverted-file index: deterministic k-means and the grouped layout.

The driver holds k centroids; rows are assigned by a matrix product in Arrow
batches and summed by the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..paths import on_workers
from ..sources.tables import written
from .distance import matrix_l2sq
from .rows import numbered

# Defaults of the build, and the generator's multiplier and stand-in for seed 0.
LISTS, SAMPLE, ITERATIONS, SEED = 256, 200_000, 6, 0xC0FFEE1979BEEF
MULTIPLIER, ZERO_SEED = 2685821657736338717, 0xC0FFEE
_LOW64 = (1 << 64) - 1
#: Most centroids, so that they are always small enough to broadcast.
MOST_LISTS = 1 << 16


class Xorshift:
    """xorshift64*."""

    def __init__(self, seed: int = SEED):
        self.state = seed or ZERO_SEED

    def draw(self) -> int:
        x = self.state
        x ^= x >> 12
        x = (x ^ (x << 25)) & _LOW64
        self.state = x = x ^ (x >> 27)
        return x * MULTIPLIER & _LOW64


def nearest(rows: DataFrame, centroids: np.ndarray, k: int = 1, q: str = "q") -> DataFrame:
    """Adds ``probes``: the k nearest centroids as array<struct<rank, list_id, d>>, ties to the lower number."""
    on_workers(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids))

    def run(batches):
        c = shared.value
        for b in batches:
            lists = b.column(q)
            m = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
            d = matrix_l2sq(m, c)
            order = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, order, 1)
            n = order.shape[1]
            flat = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(n), len(m)), pa.int32()), pa.array(order.ravel(), pa.int32()), pa.array(dist.ravel(), pa.int64())], ["rank", "list_id", "d"])
            probes = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * n, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, probes], names=[*b.schema.names, "probes"])

    item = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("list_id", T.IntegerType()), T.StructField("d", T.LongType())])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("probes", T.ArrayType(item))]))


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds list_id and d, of the nearest centroid."""
    return nearest(rows, centroids).withColumns({"list_id": F.col("probes")[0]["list_id"], "d": F.col("probes")[0]["d"]}).drop("probes")


def stride_of(n: int, sample: int) -> int:
    return n // sample if n > sample else 1


def _rows_at(corpus: DataFrame, ids: list[int]) -> dict[int, list[int]]:
    return {r.row_id: r.q for r in corpus.where(F.col("row_id").isin(sorted(set(ids)))).select("row_id", "q").collect()}


def seeds(corpus: DataFrame, k: int, rng: Xorshift, n: int) -> np.ndarray:
    """k draws with replacement over all rows."""
    ids = [rng.draw() % n for _ in range(k)]
    found = _rows_at(corpus, ids)
    return np.array([found[i] for i in ids], np.int64)


def list_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list_id, n, sums): rows nearest to each centroid, and their sums by dimension.
    Each task adds up its own rows; one row a task and list is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centroids))
    on_workers(rows.sparkSession)

    def run(batches):
        c = shared.value
        n, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            m = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
            j = matrix_l2sq(m, c).argmin(axis=1)
            n += np.bincount(j, minlength=len(c))
            np.add.at(sums, j, m)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], names=["list_id", "n", "sums"])

    part = rows.select("q").mapInArrow(run, "list_id int, n long, sums array<long>")
    each = part.select("list_id", "n", F.posexplode("sums").alias("i", "s")).groupBy("list_id", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return each.groupBy("list_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("sums")).select("list_id", "n", F.col("sums.s").alias("sums"))


def lloyd_step(sample: DataFrame, centroids: np.ndarray, corpus: DataFrame, rng: Xorshift, n: int) -> np.ndarray:
    """Integer means, rounded towards zero; empty clusters get the next draws. The
    driver gets one row a list, of which there are MOST_LISTS at most."""
    k, dims = centroids.shape
    out = np.empty((k, dims), np.int64)
    full = {r.list_id: [int(np.sign(s)) * (abs(s) // r.n) for s in r.sums] for r in list_sums(sample, centroids).collect()}
    drawn = {j: rng.draw() % n for j in range(k) if j not in full}
    found = _rows_at(corpus, list(drawn.values())) if drawn else {}
    for j in range(k):
        out[j] = full[j] if j in full else found[drawn[j]]
    return np.clip(out, -(2**15), 2**15 - 1)


def train(corpus: DataFrame, k: int = LISTS, sample: int = SAMPLE, iterations: int = ITERATIONS, seed: int = SEED) -> np.ndarray:
    """Centroids of a corpus (row_id 0.., q)."""
    n = corpus.count()
    if n == 0 or sample < 1 or not 0 < k <= MOST_LISTS:
        raise ValueError("k-means needs rows, a sample of at least one and 1 to 65536 lists")
    rng = Xorshift(seed)
    centroids = seeds(corpus, k, rng, n)
    picked = corpus.where(F.col("row_id") % stride_of(n, sample) == 0).select("row_id", "q")
    for _ in range(iterations):
        centroids = lloyd_step(picked, centroids, corpus, rng, n)
    return centroids


@dataclass
class Index:
    """lists (list_id, centroid, vec_offset, vec_count, fraud_count) and vectors
    (list_id, pos, row_id, q, label)."""

    centroids: np.ndarray
    lists: DataFrame
    vectors: DataFrame


def list_stats(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Size, frauds and first position of each list, empty ones included. There is one row a list."""
    spark = members.sparkSession
    all_ = spark.createDataFrame([(j, [int(x) for x in c]) for j, c in enumerate(centroids)], "list_id int, centroid array<int>")
    sums = members.groupBy("list_id").agg(F.count("*").alias("vec_count"), F.sum("label").alias("fraud_count"))
    full = all_.join(F.broadcast(sums), "list_id", "left").na.fill(0, ["vec_count", "fraud_count"])
    before = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("vec_offset", F.coalesce(F.sum("vec_count").over(before), F.lit(0)))


def build_index(corpus: DataFrame, centroids: np.ndarray) -> Index:
    """Groups a corpus (row_id, q, label) by nearest centroid, in row order inside a
    list. A row's place is its number in order of list and row, so a list that holds
    most rows is sorted by many tasks."""
    members = assigned(corpus.select("row_id", "q", "label"), centroids).drop("d")
    vectors = written(numbered(members, "list_id", "row_id", name="pos"), "vectors")
    return Index(centroids, list_stats(vectors, centroids), vectors.select("list_id", "pos", "row_id", "q", "label"))
