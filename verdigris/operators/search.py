"""Nearest-neighbour search: exact, by inverted lists, and their combinations.

Queries are (query_id, q), results (query_id, rank, row_id, label, d). Ties in
distance go to the list probed first, then to the lower row. With ``exclude_self``
a row is no neighbour of the query with its number.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decide import NEIGHBOURS
from ..functions.scalar import SCALE
from ..paths import on_workers
from ..sources.tables import new_folder, written
from .cluster import Index, nearest
from .distance import least_k, matrix_l2sq
from .pruned import nearest_rows

# Default and greatest number of probed lists.
PROBES, MOST_PROBES = 12, 24
#: Queries broadcast at once, and rows scored at once.
QUERY_BLOCK, ROWS = 4096, 1024
#: Most vectors and visits of a list that meet in one task, about.
VECTOR_BLOCK, VISIT_BLOCK = 1 << 18, 1 << 16
#: Most lists between which planes are tried; there is one number a pair of lists.
PLANES = 1024
FAR = np.iinfo(np.int64).max
FOUND = ["query_id", "probe_rank", "row_id", "label", "d"]


def exact(corpus: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, exclude_self: bool = True) -> DataFrame:
    """k nearest rows of a corpus (row_id, q, label). Queries go in blocks of bounded
    size, broadcast to all rows; a task passes on k rows a query at most. Where there
    are several blocks, each one's result is written before the next begins."""
    spark = corpus.sparkSession
    on_workers(spark)
    blocks = max(ceil(queries.count() / QUERY_BLOCK), 1)
    path = new_folder(spark, "neighbours")
    best = Window.partitionBy("query_id").orderBy("d", "row_id")
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select("query_id", "q").collect()
        found, shared = _block(corpus, [r[0] for r in own], [r[1] for r in own], k, exclude_self)
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "label", "d")
        if blocks == 1:
            return found
        found.write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(found.schema).parquet(path)


def _block(corpus: DataFrame, ids: list[int], vectors: list[list[int]], k: int, exclude_self: bool) -> tuple[DataFrame, Broadcast]:
    shared = corpus.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), np.array(vectors, np.int64)))
    names = ["query_id", "row_id", "label", "d"]

    def run(batches):
        ids, q = shared.value
        best = [np.full((len(ids), k), FAR), *(np.zeros((len(ids), k), np.int64) for _ in range(2))]  # d, row, label by query
        for b in batches:
            if not len(ids):
                continue
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                rows, label = part.column("row_id").to_numpy(), part.column("label").to_numpy()
                order = np.argsort(rows, kind="stable")
                rows, label = rows[order], label[order]
                d = matrix_l2sq(q, part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[order])
                if exclude_self:
                    d[ids[:, None] == rows[None, :]] = FAR
                i, j = least_k(d, k)
                new = [np.full((len(ids), k), FAR), *(np.zeros((len(ids), k), np.int64) for _ in range(2))]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                for x, y in zip(new, (d[i, j], rows[j], label[j])):
                    x[i, place] = y
                best = [np.concatenate([x, y], 1) for x, y in zip(best, new)]
                order = np.lexsort((best[1], best[0]), axis=1)[:, :k]
                best = [np.take_along_axis(x, order, 1) for x in best]
        d, row, label = best
        keep = d != FAR
        which = np.broadcast_to(ids[:, None], d.shape)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (which, row[keep], label[keep], d[keep])], names=names)

    return corpus.select("row_id", "q", "label").mapInArrow(run, ", ".join(f"{n} long" for n in names)), shared


def probe_count(nprobe: int, nlists: int) -> int:
    return min(nprobe or PROBES, nlists, MOST_PROBES)


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int = PROBES) -> DataFrame:
    """(query_id, q, probe_rank, list_id, d): the nearest lists, empty ones too."""
    n = probe_count(nprobe, len(centroids))
    return nearest(queries.select("query_id", "q"), centroids, n).select("query_id", "q", F.explode("probes").alias("p")).select("query_id", "q", F.col("p.rank").alias("probe_rank"), "p.list_id", "p.d")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("d", "probe_rank", "row_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "label", "d")


def _dealt(rows: DataFrame, sizes: DataFrame, own: str, other: str, number: str) -> DataFrame:
    """Rows of a list to blocks of their own side, each copied to all blocks of the other."""
    out = rows.join(F.broadcast(sizes), "list_id").withColumn(own, F.pmod(F.xxhash64(number), F.col(f"n_{own}")).cast("int"))
    return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_v", "n_u")


def _scan(visits: DataFrame, index: Index, exclude_self: bool, k: int) -> DataFrame:
    """(query_id, probe_rank, row_id, label, d): the k nearest rows, or more, of each
    visited list; only what is nearer than ``worst``, if visits have such a column.
    Vectors and visits of a list meet in blocks of bounded size, so neither a list nor
    a list's visits need fit one task, and only k rows a visit and block go on."""
    on_workers(visits.sparkSession)
    if "worst" not in visits.columns:
        visits = visits.withColumn("worst", F.lit(None).cast("long"))
    # one row a list, of which there are MOST_LISTS at most
    count = visits.groupBy("list_id").agg(F.count("*").alias("n"))
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("int")
    sizes = index.lists.select("list_id", "vec_count").join(F.broadcast(count), "list_id").select("list_id", blocks(F.col("vec_count"), VECTOR_BLOCK).alias("n_v"), blocks(F.col("n"), VISIT_BLOCK).alias("n_u"))
    left = _dealt(index.vectors.select("list_id", "row_id", "q", "label"), sizes, "v", "u", "row_id")
    right = _dealt(visits.select("list_id", "query_id", "q", "probe_rank", "worst"), sizes, "u", "v", "query_id")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])  # the two sides may stem from one table
    dims = index.centroids.shape[1]

    def matrix(t: pa.Table, q: str) -> np.ndarray:
        return t.column(q).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        rows, labels, query = vectors.column("row_id").to_numpy(), vectors.column("label").to_numpy(), asked.column("query_id_").to_numpy()
        worst = asked.column("worst_").fill_null(FAR).to_numpy()
        i, j, d = nearest_rows(matrix(vectors, "q"), rows, matrix(asked, "q_"), k, query if exclude_self else None, worst)
        cols = [query[i], asked.column("probe_rank_").to_numpy()[i], rows[j], labels[j], d]
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=FOUND)

    place = ["list_id", "u", "v"]
    return left.groupBy(*place).cogroup(right.groupBy(*[f"{c}_" for c in place])).applyInArrow(run, ", ".join(f"{n} long" for n in FOUND))


def _planes(index: Index) -> np.ndarray:
    """[i, j]: the least product of a vector of list j with the way from centroid i to
    centroid j, infinite if there is none. A task gives one row for each list it reads."""
    shared = index.vectors.sparkSession.sparkContext.broadcast(index.centroids.astype(np.float64))

    def run(batches):
        c, least = shared.value, {}
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("list_id").to_numpy()
            order = np.argsort(lists, kind="stable")
            lists = lists[order]
            m = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])[order]
            p = m.astype(np.float64) @ c.T
            ends = np.flatnonzero(np.diff(lists, prepend=-1))
            for j, x in zip(lists[ends].tolist(), np.minimum.reduceat(p[np.arange(len(p)), lists][:, None] - p, ends)):
                least[j] = np.minimum(least.get(j, np.inf), x)
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([x.tolist() for x in least.values()], pa.list_(pa.float64()))], names=["list_id", "least"])

    out = np.full((len(index.centroids),) * 2, np.inf)
    for j, x in index.vectors.select("list_id", "q").mapInArrow(run, "list_id int, least array<double>").toLocalIterator():
        out[:, j] = np.minimum(out[:, j], x)
    return out


def _further(index: Index, queries: DataFrame, first: DataFrame, n: int, k: int, exclude_self: bool) -> DataFrame:
    """``first``, what each query found in its nearest list, and what is nearer than
    the k-th of that in its n nearest lists. A list is not visited if all its vectors
    lie beyond a plane that is at least as far; this is tried with PLANES lists at most."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centroids.astype(np.float64), _planes(index) if len(index.centroids) <= PLANES else None))
    # where a list has several blocks, the last of each one's k: no less than the k-th of all
    full = first.groupBy("query_id").agg(F.max("d").alias("worst"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    names = ["list_id", "query_id", "q", "probe_rank", "worst"]

    def run(batches):
        c, planes = shared.value
        for b in batches:
            q, worst = b.column("q"), b.column("worst")
            m = q.flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
            lists = np.argsort(matrix_l2sq(m, c), axis=1, kind="stable")[:, :n]
            i, rank = np.divmod(np.arange(lists.size), max(lists.shape[1], 1))
            i, rank = i[rank > 0], rank[rank > 0]
            if planes is not None:
                at, to = lists[i, 0], lists[i, rank]
                p = m.astype(np.float64) @ c.T
                way = np.maximum(planes[at, to] - (p[i, to] - p[i, at]), 0)
                near = way * way <= worst.fill_null(FAR).to_numpy()[i] * ((c[at] - c[to]) ** 2).sum(axis=1) * (1 + 1e-9)
                i, rank = i[near], rank[near]
            which = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(lists[i, rank], pa.int32()), b.column("query_id").take(which), q.take(which), pa.array(rank, pa.int32()), worst.take(which)], names=names)

    asked = queries.select("query_id", "q").join(full, "query_id", "left").select(F.col("query_id").cast("long").alias("query_id"), "q", "worst")
    visits = asked.mapInArrow(run, "list_id int, query_id long, q array<int>, probe_rank int, worst long")
    return first.unionByName(_scan(written(visits, "visits"), index, exclude_self, k))


def ivf(index: Index, queries: DataFrame, nprobe: int = PROBES, early_limit: int = 0, k: int = NEIGHBOURS, exclude_self: bool = True) -> DataFrame:
    """Search of the probed lists. With ``early_limit`` > 0 a query ends after the
    first list by which k rows lie within that distance."""
    first = _scan(probes(queries, index.centroids, 1), index, exclude_self, k)
    n = probe_count(nprobe, len(index.centroids))
    found = first if n == 1 else _further(index, queries, written(first, "first-list"), n, k, exclude_self)
    if early_limit > 0:
        near = found.where(F.col("d") <= early_limit).groupBy("query_id", "probe_rank").agg(F.count("*").alias("n"))
        run = near.withColumn("upto", F.sum("n").over(Window.partitionBy("query_id").orderBy("probe_rank")))
        stop = run.where(F.col("upto") >= k).groupBy("query_id").agg(F.min("probe_rank").alias("stop"))
        found = found.join(stop, "query_id", "left").where(F.col("stop").isNull() | (F.col("probe_rank") <= F.col("stop"))).drop("stop")
    return _top(found, k)


def votes(queries: DataFrame, found: DataFrame, counted: bool = False) -> DataFrame:
    """(query_id, frauds, worst): labels of the neighbours; a missing one is no
    fraud. If ``counted``, n too, the number of neighbours."""
    sums = found.groupBy("query_id").agg(F.sum("label").alias("frauds"), F.max("d").alias("worst"), F.count("*").alias("n"))
    n = [F.coalesce("n", F.lit(0)).alias("n")] if counted else []
    return queries.select("query_id").join(sums, "query_id", "left").select("query_id", F.coalesce("frauds", F.lit(0)).cast("int").alias("frauds"), "worst", *n)


def ivf_repaired(index: Index, queries: DataFrame, nprobe: int = 3, repair: int = 18, low: int = 1, high: int = 4, far_legit: int = 0, far_fraud: int = 0, k: int = NEIGHBOURS, exclude_self: bool = True) -> DataFrame:
    """Own reading of a two-pass search: queries whose first votes lie from ``low`` to
    ``high`` are searched again with more probes; their second result replaces the
    first. With ``far_legit`` and ``far_fraud`` above 0 so are queries without any and
    with nothing but fraud votes, if their worst neighbour is farther than that, or
    they have fewer than k neighbours."""
    near = written(_scan(probes(queries, index.centroids, 1), index, exclude_self, k), "first-list")
    search = lambda asked, near, n: near if n == 1 else _further(index, asked, near, n, k, exclude_self)
    first = written(_top(search(queries, near, probe_count(nprobe, len(index.centroids))), k), "first-pass")
    v = votes(queries, first, counted=True)
    lost = lambda far: F.lit(far > 0) & ((F.col("worst") > far) | (F.col("n") < k))
    again = F.col("frauds").between(low, high) | ((F.col("frauds") == 0) & lost(far_legit)) | ((F.col("frauds") == k) & lost(far_fraud))
    unsure = written(v.where(again).select("query_id"), "unsure")
    some = [x.join(unsure, "query_id", "left_semi") for x in (queries, near)]
    second = _top(search(*some, probe_count(repair, len(index.centroids))), k)
    return first.join(unsure, "query_id", "left_anti").unionByName(second)


def bounds(rows: DataFrame, key: str) -> DataFrame:
    """(key, low, high): least and greatest component of ``q`` in each dimension. One
    sum for each key and dimension leaves a task, and no plan grows with the dimensions."""
    each = rows.select(key, F.posexplode("q").alias("_i", "_x")).groupBy(key, "_i").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    box = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "lo", "hi"))).alias("_b"))
    return box.select(key, F.col("_b.lo").alias("low"), F.col("_b.hi").alias("high"))


def boxes(index: Index) -> DataFrame:
    """(list_id, low, high) of the lists that hold vectors."""
    return bounds(index.vectors, "list_id")


def _reachable(worst: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, q, list_id) for queries (query_id, q, worst): lists whose box may hold
    something nearer than ``worst``, all if it is null. The boxes, MOST_LISTS at
    most, are broadcast; only pairs within reach become rows."""
    spark = worst.sparkSession
    rows = found.orderBy("list_id").collect()
    shared = spark.sparkContext.broadcast(([r.list_id for r in rows], np.array([r.low for r in rows], np.int64), np.array([r.high for r in rows], np.int64)))

    def run(batches):
        ids, low, high = shared.value
        ids = np.array(ids, np.int32)
        step = max(1, (1 << 22) // max(low.size, 1))
        for b in batches:
            query, w = b.column("query_id").to_numpy(), b.column("worst").fill_null(FAR).to_numpy()
            m = b.column("q").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.int64)
            lists = []
            for at in range(0, b.num_rows if len(ids) else 0, step):
                part = slice(at, at + step)
                bound = (np.maximum(np.maximum(low[None] - m[part, None], m[part, None] - high[None]), 0) ** 2).sum(axis=2)
                lists += [ids[x] for x in bound < w[part, None]]
            yield pa.RecordBatch.from_arrays([pa.array(query), b.column("q"), pa.array(lists or [[]] * b.num_rows, pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    return worst.mapInArrow(run, "query_id long, q array<int>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list_id"))


def early_limit_of(milli: int) -> int:
    """Own reading of an early distance in thousandths: the squared distance of vectors of SCALE steps."""
    return (milli * SCALE // 1000) ** 2


def exact_fallback(index: Index, queries: DataFrame, nprobe: int = 3, k: int = NEIGHBOURS, exclude_self: bool = True) -> DataFrame:
    """Exact search in two phases: the probed lists give a k-th distance; of the
    others only lists whose box may hold something nearer are scanned."""
    visits = written(probes(queries, index.centroids, nprobe), "visits")
    first = written(_top(_scan(visits, index, exclude_self, k), k), "first-pass")
    full = first.groupBy("query_id").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    worst = queries.select("query_id", "q").join(full, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("worst")).alias("worst"))
    near = _reachable(worst, boxes(index))
    rest = near.join(visits.select("query_id", "list_id"), ["query_id", "list_id"], "left_anti").withColumn("probe_rank", F.lit(MOST_PROBES))
    more = _scan(rest, index, exclude_self, k)
    return _top(first.withColumn("probe_rank", F.lit(0)).select("query_id", "probe_rank", "row_id", "label", "d").unionByName(more), k)


def pure_buckets(corpus: DataFrame, key, least: int = 15, only: int | None = None) -> DataFrame:
    """(bucket, label): buckets of ``least`` rows or more that all carry one label, or
    that all carry the label ``only``."""
    sums = corpus.groupBy(key.alias("bucket")).agg(F.count("*").alias("n"), F.min("label").alias("label"), F.max("label").alias("other"))
    pure = sums.where((F.col("n") >= least) & (F.col("label") == F.col("other"))).select("bucket", "label")
    return pure if only is None else pure.where(F.col("label") == only)


def shortcut_votes(corpus: DataFrame, index: Index, queries: DataFrame, key, least: int = 1, nprobe: int = PROBES, k: int = NEIGHBOURS) -> DataFrame:
    """(query_id, frauds): queries whose bucket holds nothing but fraud get all votes
    and are not searched; the others are."""
    pure = written(pure_buckets(corpus, key, least, only=1), "pure")
    keyed = queries.withColumn("bucket", key)
    short = keyed.join(pure, "bucket", "left_semi").select("query_id", F.lit(k).alias("frauds"))
    rest = keyed.join(pure, "bucket", "left_anti").select("query_id", "q")
    return short.unionByName(votes(rest, ivf(index, rest, nprobe, k=k)).select("query_id", "frauds"))
