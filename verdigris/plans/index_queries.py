"""Queries of clustering, search, decisions and storage, over embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decide import approved, clamped, response_body
from ..functions.scalar import f32, quantize
from ..operators import cluster, search
from ..operators.cluster import Xorshift
from ..operators.distance import bbox_bound, l2sq
from ..operators.rows import numbered
from ..sources import index_files
from ..sources.tables import new_folder, written
from ..streaming.scoring import score_stream, scored
from .scalar_queries import q_sql, read

QUERIES, SQL = {}, {}
DIMS, LISTS, PROBES, REPAIR, EARLY = 64, 8, 3, 6, 30_000_000
#: Dimensions that a packed vector holds.
DIMS_PACKED = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_kept: dict[tuple, object] = {}


def once(f):
    """What a query reads of a folder's corpus is written once in a session."""

    def kept(spark, sf_dir: str):
        key = (spark.sparkContext.applicationId, f.__module__, f.__name__, sf_dir)
        if key not in _kept:
            _kept[key] = f(spark, sf_dir)
        return _kept[key]

    return kept


@once
def corpus(spark, sf_dir: str) -> DataFrame:
    """(row_id, q, label): row_id counts from 0 in order of vec_id."""
    e = numbered(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("l")), "vec_id")
    q = F.transform("embedding", lambda x: quantize(((x + f32(1)) / f32(2)).cast("float")))
    return written(e.select("row_id", q.alias("q"), F.when(F.col("l") >= 5, 1).otherwise(0).alias("label")), "corpus")


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("query_id"), "q")


#: Draws of the generator for the seeds, the same for any corpus.
DRAWS = (lambda r: [r.draw() for _ in range(LISTS)])(Xorshift())
_draws = ", ".join(f"({j}, {d}::UBIGINT)" for j, d in enumerate(DRAWS))
_dist = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2])::BIGINT))::BIGINT"
E = f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, list_transform(embedding, lambda x: {q_sql('(x::FLOAT + 1::FLOAT) / 2::FLOAT')}) AS q, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label FROM embeddings)"""
C0 = f"{E}, c0 AS (SELECT j, q AS c FROM (VALUES {_draws}) AS s(j, d) JOIN e ON e.row_id = (d % (SELECT count(*) FROM e)::UBIGINT)::BIGINT)"


def _assign(i: int, c: str) -> str:
    return f"a{i} AS MATERIALIZED (SELECT row_id, q, label, j, d FROM (SELECT e.*, j, {_dist('e.q', f'{c}.c')} AS d FROM e, {c}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, j) = 1)"


def _mean(i: int) -> str:
    return f"""u{i} AS (SELECT j, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM a{i}) GROUP BY j, p),
c{i + 1} AS MATERIALIZED (SELECT j, list((CASE WHEN s < 0 THEN -((-s) // n) ELSE s // n END)::INTEGER ORDER BY p) AS c FROM u{i} GROUP BY j)"""


def _lloyd(n: int) -> str:
    return ", ".join([C0, *(f"{_assign(i, f'c{i}')}, {_mean(i)}" for i in range(n))])


# the index of the search queries: 8 lists, 6 iterations
INDEX = f"{_lloyd(6)}, {_assign(6, 'c6')}"
PROBED = f"{INDEX}, p AS MATERIALIZED (SELECT row_id AS query_id, q, j, d, row_number() OVER (PARTITION BY row_id ORDER BY d, j) - 1 AS r FROM (SELECT e.row_id, e.q, c6.j, {_dist('e.q', 'c6.c')} AS d FROM e, c6))"


def _found(name: str, where: str, extra: str = "") -> str:
    return f"{name} AS MATERIALIZED (SELECT query_id, p.r, a6.row_id, a6.label, {_dist('p.q', 'a6.q')} AS d FROM p JOIN a6 ON a6.j = p.j {extra} WHERE {where} AND a6.row_id <> query_id)"


TOP = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, r, row_id) <= 5"
EXACT = f"{E}, k AS MATERIALIZED (SELECT a.row_id AS query_id, b.row_id, b.label, {_dist('a.q', 'b.q')} AS d FROM e a JOIN e b ON a.row_id <> b.row_id), x AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, row_id) AS INTEGER) AS rank FROM k QUALIFY rank <= 5)"
BODY = "'{\"approved\":' || CASE WHEN frauds < 3 THEN 'true' ELSE 'false' END || ',\"fraud_score\":' || CASE frauds WHEN 0 THEN '0.0' WHEN 1 THEN '0.2' WHEN 2 THEN '0.4' WHEN 3 THEN '0.6' WHEN 4 THEN '0.8' ELSE '1.0' END || '}'"


def _votes(found: str) -> str:
    return f"SELECT e.row_id AS query_id, coalesce(sum(f.label), 0)::INTEGER AS frauds FROM e LEFT JOIN ({found}) f ON f.query_id = e.row_id GROUP BY e.row_id"




@once
def centroids(spark, sf_dir: str) -> np.ndarray:
    return cluster.train(corpus(spark, sf_dir), LISTS)


@once
def index(spark, sf_dir: str) -> cluster.Index:
    """Built, written and opened."""
    path = new_folder(spark, "index")
    index_files.write_index(cluster.build_index(corpus(spark, sf_dir), centroids(spark, sf_dir)), path)
    return index_files.open_index(spark, path)


@query(f"WITH {E} SELECT a.row_id, {_dist('a.q', 'b.q')} AS d FROM e a JOIN e b ON b.row_id = a.row_id + 1")
def l2sq_pairs(spark, sf_dir):
    e = corpus(spark, sf_dir)
    nxt = e.select((F.col("row_id") - 1).alias("row_id"), F.col("q").alias("o"))
    return e.join(nxt, "row_id").select("row_id", l2sq("q", "o", DIMS).alias("d"))


@query(f"""WITH {E}, u AS (SELECT label, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM e), m AS (SELECT label, p, min(x) AS lo, max(x) AS hi FROM u WHERE label = 1 GROUP BY ALL)
SELECT row_id, sum(pow(greatest(lo - x, x - hi, 0), 2))::BIGINT AS bound FROM (SELECT row_id, unnest(q) AS x, generate_subscripts(q, 1) AS p FROM e WHERE label = 0) JOIN m USING (p) GROUP BY row_id""")
def bbox_lower_bound(spark, sf_dir):
    e = corpus(spark, sf_dir)
    box = search.bounds(e.where("label = 1"), "label").drop("label")
    return e.where("label = 0").crossJoin(F.broadcast(box)).select("row_id", bbox_bound("q", "low", "high").alias("bound"))


@query(f"WITH {EXACT} SELECT query_id, rank, row_id, label::BIGINT AS label, d FROM x")
def knn_exact_top5(spark, sf_dir):
    e = corpus(spark, sf_dir)
    return search.exact(e, queries_of(e))


@query(f"WITH {EXACT} {_votes('SELECT * FROM x')}")
def fraud_vote(spark, sf_dir):
    e = corpus(spark, sf_dir)
    return search.votes(queries_of(e), search.exact(e, queries_of(e))).select("query_id", "frauds")


@query(f"WITH {EXACT}, v AS ({_votes('SELECT * FROM x')}) SELECT query_id, frauds, frauds < 3 AS approved, {BODY} AS body FROM v")
def verdict_response_json(spark, sf_dir):
    v = fraud_vote(spark, sf_dir)
    frauds = clamped(F.col("frauds"))
    return v.select("query_id", frauds.alias("frauds"), approved(frauds).alias("approved"), response_body(frauds).alias("body"))


@query(f"WITH {E} SELECT row_id FROM e WHERE row_id % (CASE WHEN (SELECT count(*) FROM e) > 100 THEN (SELECT count(*) FROM e) // 100 ELSE 1 END) = 0")
def stride_sample(spark, sf_dir):
    e = corpus(spark, sf_dir)
    return e.where(F.col("row_id") % cluster.stride_of(e.count(), 100) == 0).select("row_id")


@query(f"WITH {E} SELECT j, (d % (SELECT count(*) FROM e)::UBIGINT)::BIGINT AS row_id FROM (VALUES {_draws}) AS s(j, d)")
def kmeans_seed(spark, sf_dir):
    n = corpus(spark, sf_dir).count()
    return spark.createDataFrame([(j, d % n) for j, d in enumerate(DRAWS)], "j int, row_id long")


def _centroid_rows(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(j, p + 1, int(x)) for j, c in enumerate(centroids) for p, x in enumerate(c)], "j int, p long, x int")


@query(f"WITH {_lloyd(1)} SELECT j, generate_subscripts(c, 1) AS p, unnest(c) AS x FROM c1")
def kmeans_one_iter(spark, sf_dir):
    return _centroid_rows(spark, cluster.train(corpus(spark, sf_dir), LISTS, iterations=1))


@query(f"WITH {_lloyd(6)} SELECT j, generate_subscripts(c, 1) AS p, unnest(c) AS x FROM c6")
def kmeans_lloyd6(spark, sf_dir):
    return _centroid_rows(spark, centroids(spark, sf_dir))


@query(f"WITH {C0}, {_assign(0, 'c0')} SELECT row_id, j AS list_id, d FROM a0")
def assign_nearest(spark, sf_dir):
    e = corpus(spark, sf_dir)
    return cluster.assigned(e, cluster.train(e, LISTS, iterations=0)).select("row_id", "list_id", "d")


_stats = "s AS (SELECT c6.j AS list_id, count(row_id) AS vec_count, coalesce(sum(label), 0)::BIGINT AS fraud_count FROM c6 LEFT JOIN a6 USING (j) GROUP BY c6.j)"


@query(f"WITH {INDEX}, {_stats} SELECT * FROM s")
def list_stats(spark, sf_dir):
    return index(spark, sf_dir).lists.select("list_id", "vec_count", "fraud_count")


@query(f"WITH {INDEX}, {_stats} SELECT list_id, coalesce(sum(vec_count) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS vec_offset FROM s")
def list_offsets(spark, sf_dir):
    return index(spark, sf_dir).lists.select("list_id", "vec_offset")


@query(f"WITH {INDEX} SELECT j AS list_id, row_number() OVER (ORDER BY j, row_id) - 1 AS pos, row_id, label FROM a6")
def list_layout(spark, sf_dir):
    return index(spark, sf_dir).vectors.select("list_id", "pos", "row_id", "label")


@query(f"WITH {PROBED} SELECT query_id, CAST(r AS INTEGER) AS probe_rank, j AS list_id, d FROM p WHERE r < {PROBES}")
def rank_probes(spark, sf_dir):
    e = corpus(spark, sf_dir)
    return search.probes(queries_of(e), centroids(spark, sf_dir), PROBES).drop("q")


def _searched(spark, sf_dir, f) -> DataFrame:
    i = index(spark, sf_dir)
    return f(i, queries_of(corpus(spark, sf_dir))).select("query_id", "row_id", "d")


@query(f"WITH {PROBED}, {_found('f', f'p.r < {PROBES}')} SELECT query_id, row_id, d FROM f {TOP}")
def ivf_search(spark, sf_dir):
    return _searched(spark, sf_dir, lambda i, q: search.ivf(i, q, PROBES))


_early = f"n AS (SELECT query_id, r, count(*) FILTER (d <= {EARLY}) AS n FROM f GROUP BY ALL), st AS (SELECT query_id, min(r) AS stop FROM (SELECT query_id, r, sum(n) OVER (PARTITION BY query_id ORDER BY r) AS upto FROM n) WHERE upto >= 5 GROUP BY query_id)"


@query(f"WITH {PROBED}, {_found('f', f'p.r < {LISTS}')}, {_early} SELECT f.query_id, row_id, d FROM f LEFT JOIN st USING (query_id) WHERE stop IS NULL OR r <= stop QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY d, r, row_id) <= 5")
def ivf_early_stop(spark, sf_dir):
    return _searched(spark, sf_dir, lambda i, q: search.ivf(i, q, LISTS, EARLY))


@query(f"""WITH {PROBED}, {_found('f', 'p.r < 1')}, t1 AS (SELECT * FROM f {TOP}), v AS ({_votes('SELECT * FROM t1')}), {_found('g', f'p.r < {REPAIR}')}, t2 AS (SELECT * FROM g {TOP})
SELECT query_id, row_id, d FROM t1 WHERE query_id IN (SELECT query_id FROM v WHERE frauds NOT BETWEEN 1 AND 4) UNION ALL SELECT query_id, row_id, d FROM t2 WHERE query_id IN (SELECT query_id FROM v WHERE frauds BETWEEN 1 AND 4)""")
def ivf_repair(spark, sf_dir):
    return _searched(spark, sf_dir, lambda i, q: search.ivf_repaired(i, q, 1, REPAIR))


@query(f"WITH {EXACT} SELECT query_id, rank, d FROM x")
def bbox_exact_fallback(spark, sf_dir):
    return search.exact_fallback(index(spark, sf_dir), queries_of(corpus(spark, sf_dir))).select("query_id", "rank", "d")


@query(f"""WITH {E}, b AS (SELECT q[1] // 500 AS bucket, min(label) AS label FROM e GROUP BY 1 HAVING count(*) >= 5 AND min(label) = max(label)) SELECT row_id AS query_id, b.label FROM e LEFT JOIN b ON q[1] // 500 = bucket""")
def pure_bucket_fastpath(spark, sf_dir):
    e = corpus(spark, sf_dir)
    key = F.floor(F.get("q", F.lit(0)) / F.lit(500))
    pure = search.pure_buckets(e, key, 5)
    return e.withColumn("bucket", key).join(pure.withColumnRenamed("label", "found"), "bucket", "left").select(F.col("row_id").alias("query_id"), F.col("found").alias("label"))


@query(f"WITH {E}, {PROBED.removeprefix(E + ', ')}, {EXACT.removeprefix(E + ', ')}, {_found('f', f'p.r < {PROBES}')}, t AS (SELECT * FROM f {TOP}) SELECT count(*) AS neighbours, count(t.row_id) AS hit FROM x LEFT JOIN t ON t.query_id = x.query_id AND t.row_id = x.row_id")
def ivf_recall_vs_exact(spark, sf_dir):
    e = corpus(spark, sf_dir)
    i = index(spark, sf_dir)
    true = search.exact(e, queries_of(e)).select("query_id", "row_id")
    got = search.ivf(i, queries_of(e), PROBES).select("query_id", "row_id", F.lit(1).alias("hit"))
    return true.join(got, ["query_id", "row_id"], "left").agg(F.count("*").alias("neighbours"), F.count("hit").alias("hit"))


@query(SQL["list_layout"])
def index_roundtrip(spark, sf_dir):
    path = new_folder(spark, "index")
    index_files.write_index(index(spark, sf_dir), path)
    return index_files.open_index(spark, path).vectors.select("list_id", "pos", "row_id", "label")


# the header's fields as little-endian bytes, then the checksum bit by bit
_le = lambda x, n: ", ".join(f"(({x}) >> {8 * i}) & 255" for i in range(n))
_CRC_SQL = f"""WITH n AS (SELECT count(*)::HUGEINT AS n, {-(-(64 + LISTS * 64) // 32) * 32}::HUGEINT AS v FROM embeddings),
h AS (SELECT n, [82, 78, 72, 52, {_le('1::HUGEINT', 4)}, {_le(f'{LISTS}::HUGEINT', 4)}, {_le('n', 4)}, {_le('64::HUGEINT', 8)}, {_le('v', 8)}, {_le('v + n * 32', 8)}, {_le('v + n * 33', 8)}] || list_transform(range(16), lambda i: 0) AS b FROM n),
c AS (SELECT n, b, list_reduce(list_prepend(4294967295::BIGINT, list_transform(b, lambda x: x::BIGINT)), lambda crc, x: list_reduce(list_prepend(xor(crc, x), list_transform(range(8), lambda i: 0::BIGINT)), lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 2197175160 ELSE 0 END))) AS crc FROM h)
SELECT n::BIGINT AS nvectors, xor(crc, 4294967295)::BIGINT AS crc FROM c"""


@query(_CRC_SQL)
def crc32c_header(spark, sf_dir):
    """Of the header of the packed index, which is written and read back."""
    path = new_folder(spark, "packed")
    index_files.write_packed(index(spark, sf_dir), path)
    head = bytes(spark.read.parquet(path).first()[0])[: index_files.HEADER]
    n = index_files.read_packed(spark, path, DIMS_PACKED).vectors.count()
    return spark.createDataFrame([(n, index_files.header_crc(head))], "nvectors long, crc long")


@query(SQL["list_layout"])
def packed_roundtrip(spark, sf_dir):
    path = new_folder(spark, "packed")
    i = index(spark, sf_dir)
    index_files.write_packed(i, path)
    got = index_files.read_packed(spark, path, DIMS_PACKED).vectors
    # the packed format has no row numbers: they come from the index, by place and vector
    first = F.slice("q", 1, DIMS_PACKED)
    return got.select("list_id", "pos", "q", "label").join(i.vectors.select("pos", "row_id", first.alias("q")), ["pos", "q"]).select("list_id", "pos", "row_id", "label")


_stream_sql = f"WITH {PROBED}, {_found('f', f'p.r < {PROBES}')}, v AS ({_votes(f'SELECT * FROM f {TOP}')}) SELECT query_id, frauds, {BODY} AS body FROM v"


@query(_stream_sql)
def batch_score(spark, sf_dir):
    return scored(queries_of(corpus(spark, sf_dir)), index(spark, sf_dir), PROBES)


@query(_stream_sql)
def stream_score(spark, sf_dir):
    """The same through a stream of files; each batch overwrites its own folder, so a repeated one counts once."""
    path = new_folder(spark, "stream")
    queries_of(corpus(spark, sf_dir)).write.parquet(f"{path}/in")
    i = index(spark, sf_dir)
    stream = spark.readStream.schema("query_id long, q array<int>").option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    run = score_stream(stream, i, lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/state", once=True, nprobe=PROBES)
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("query_id", "frauds", "body")
