"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size, each broadcast to all rows. Every
pass scores everything against a block and counts, for each query, the scores
in BINS equal parts of the interval that holds its k-th highest score; the sums
over all tasks name the part that holds it, which the next pass divides, until
it is one integer wide. A last pass keeps the scores that reach it; ties at the
k-th place go to the smaller ids, of which no task passes on more than k.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, on_workers

SCALE = 1024
#: Queries in a block, about; rows scored at once.
BLOCK, ROWS = 1024, 2048
BINS = 512
SCHEMA = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, o): floor(SCALE * x) of each component as little-endian longs,
    and the same bytes such that they sort like the numbers; without rows whose id or
    vector is null or holds a null or non-finite component. A component that no
    long can hold is an error."""

    def run(batches):
        for b in batches:
            lists = b.column("v")
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64)) if len(flat) else np.zeros(0)
            ends = np.cumsum(lengths)
            finite = np.isfinite(x)
            bad = np.concatenate([[0], np.cumsum(~finite)])
            good = bad[ends] == bad[ends - lengths]
            if (np.abs(x[finite & np.repeat(good, lengths)]) >= 2.0**62).any():
                raise OverflowError("a component does not fit 64 bits")
            q = np.where(finite, x, 0).clip(-(2.0**62), 2.0**62).astype("<i8")
            sortable = (q.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
            both = [pa.array([x[e - n : e].tobytes() if g else None for e, n, g in zip(ends, lengths, good)], pa.binary()) for x in (q, sortable)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *both], names=["vec_id", "q", "o"])

    some = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return some.mapInArrow(run, "vec_id long, q binary, o binary").where("q is not null")


def _matrix(rows: list[bytes], dims: int) -> np.ndarray:
    """Rows as a matrix of integers, shorter ones filled up with zeros."""
    if all(len(r) == 8 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(-1, dims)
    return np.array([np.pad(np.frombuffer(r, "<i8"), (0, dims - len(r) // 8)) for r in rows], np.int64).reshape(-1, dims)


def _scored(batches, ids: np.ndarray, queries: np.ndarray):
    """(vec_ids, scores of each row for each query) of some rows at a time; a query's own row gets None's stand-in."""
    dims = queries.shape[1]
    top = int(np.abs(queries).max(initial=0))
    real = queries.T.astype(np.float64)
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            vec = part.column("vec_id").to_numpy()
            m = _matrix(part.column("q").to_pylist(), dims)
            if top * int(np.abs(m).max(initial=0)) * dims < 1 << 53:  # doubles hold every sum exactly
                scores = (m.astype(np.float64) @ real).astype(np.int64)
            else:
                scores = m @ queries.T
                size = np.abs(m).astype(np.float64) @ np.abs(real)
                if (size[vec[:, None] != ids[None, :]] >= MOST).any():
                    raise OverflowError("a score does not fit 64 bits")
            scores[vec[:, None] == ids[None, :]] = OWN
            yield vec, scores


#: Stands for the score of a query with itself, below all others.
OWN = -(2**63)
#: No score reaches it; a larger one is an error.
MOST = 2**61


def _histogram(rows: DataFrame, block, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> DataFrame:
    """(query, bin, n): scores from ``low`` to below ``high``, in BINS parts of ``width`` at most."""
    limits = rows.sparkSession.sparkContext.broadcast((low, high, width))

    def run(batches):
        ids, queries = block.value
        low, high, width = limits.value
        counts = np.zeros(len(ids) * BINS, np.int64)
        base = np.arange(len(ids)) * BINS
        for _, scores in _scored(batches, ids, queries):
            inside = (scores >= low) & (scores < high) & (scores != OWN)
            r, c = np.nonzero(inside)
            counts += np.bincount(base[c] + (scores[r, c] - low[c]) // width[c], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"query": pa.array(at // BINS, pa.int32()), "bin": pa.array(at % BINS, pa.int32()), "n": pa.array(counts[at])})

    return rows.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _best(rows: DataFrame, block, least: np.ndarray, k: int) -> DataFrame:
    reach = rows.sparkSession.sparkContext.broadcast(least)

    def run(batches):
        ids, queries = block.value
        held: dict[int, list] = {}
        for vec, scores in _scored(batches, ids, queries):
            r, c = np.nonzero((scores >= reach.value) & (scores != OWN))
            for j in np.unique(c):
                own = r[c == j]
                pool = held.get(j, []) + list(zip((-scores[own, j]).tolist(), vec[own].tolist()))
                held[j] = sorted(pool)[:k]
        out = [(int(ids[j]), v, -s) for j, pool in held.items() for s, v in pool]
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols)})

    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    return out.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by
    ``every``, the k other rows of highest integer inner product, ties to the
    smaller id; all other rows if there are fewer.

    Vectors that are null or hold null or non-finite components take no part,
    nor do null ids; shorter vectors count as filled up with zeros, empty ones
    score 0. Each row of a repeated id is a candidate; as a query the id counts once,
    with the least of its vectors, and none of its rows is a candidate of its own. An
    empty table gives no rows."""
    spark = vectors.sparkSession
    on_workers(spark)
    rows = cut(quantised(vectors), "vectors")
    chosen = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("o", "q")).alias("m")).select("vec_id", F.col("m.q").alias("q"))
    rows = rows.drop("o")
    dims, n = rows.agg(F.max(F.octet_length("q"))).first()[0], chosen.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    dims, blocks, path = max(dims // 8, 1), ceil(n / BLOCK), new_path(spark, "topk")
    for i in range(blocks):
        part = sorted(chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect())
        if not part:
            continue
        ids, queries = np.array([r[0] for r in part]), _matrix([bytes(r[1]) for r in part], dims)
        block = spark.sparkContext.broadcast((ids, queries))
        _best(rows, block, _kth(rows, block, ids, queries, k), k).write.mode("append").parquet(path)
        block.unpersist()
    return spark.read.schema(SCHEMA).parquet(path)


def _kth(rows: DataFrame, block, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th highest score; the lowest possible one if there are fewer scores."""
    most = _largest(rows)
    reach = [sum(abs(int(x)) for x in q) * most + 1 for q in queries]
    low = np.array([-min(r, MOST) for r in reach], np.int64)
    high = -low
    width = -(-(high - low) // BINS)
    need = np.full(len(ids), k, np.int64)
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    while True:
        hist = _histogram(rows, block, low, high, width)
        wanted = rows.sparkSession.createDataFrame([(int(i), int(x)) for i, x in enumerate(need)], "query int, need long")
        # of each query, the highest bin at which the running count from above reaches what it needs
        run = hist.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(wanted), "query")
        found = run.where(F.col("upto") >= F.col("need")).groupBy("query").agg(F.max(F.struct("bin", "upto", "n")).alias("at")).select("query", "at.bin", (F.col("at.upto") - F.col("at.n")).alias("above")).collect()
        at = np.zeros(len(ids), np.int64)
        for q, b, above in found:
            at[q] = b
            need[q] -= above
        few = np.ones(len(ids), bool)
        few[[r[0] for r in found]] = False
        low = np.where(few, low, low + at * width)
        high = np.where(few, low, np.minimum(low + width, high))
        if (width[~few] == 1).all():
            return low
        width = np.where(few, width, -(-width // BINS))


def _largest(rows: DataFrame) -> int:
    def run(batches):
        most = 0
        for b in batches:
            for x in b.column("q").to_pylist():
                if x:
                    most = max(most, int(np.abs(np.frombuffer(x, "<i8")).max()))
        yield pa.RecordBatch.from_pydict({"most": pa.array([most], pa.int64())})

    return rows.select("q").mapInArrow(run, "most long").agg(F.max("most")).first()[0] or 0


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM u a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
