"""Clustering, search, storage and streaming."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import compared
from verdigris.catalog import QUERIES, SQL
from verdigris.operators import cluster, search
from verdigris.operators.cluster import Xorshift
from verdigris.operators.rows import numbered
from verdigris.sources import corpus, index_files
from verdigris.streaming.scoring import score_stream, scored

FOLDER = "/root/testdata/sf0.001"


def test_generator():
    r = Xorshift()
    assert [r.draw() for _ in range(3)] == [0x30F555994ADBE661, 0xECCA729F928C4486, 0x7CBD1F9ACDCE2F5B]
    r = Xorshift()
    assert [r.draw() % 500 for _ in range(8)] == [241, 54, 7, 471, 127, 334, 27, 260]
    assert Xorshift(0).state == 0xC0FFEE


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    ours, theirs = compared(spark, QUERIES[name], SQL[name], FOLDER)
    assert ours == theirs and ours


def test_known_distance_sum(spark):
    df = QUERIES["knn_exact_top5"](spark, "/root/testdata/sf0.01")
    assert df.agg(F.count("*"), F.sum("d")).first()[:] == (2500, 84545995260)


def test_numbered(spark):
    df = numbered(spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10**6), 500)], "v long"), "v")
    rows = sorted((r.row_id, r.v) for r in df.collect())
    assert [i for i, _ in rows] == list(range(500)) and [v for _, v in rows] == sorted(v for _, v in rows)


def test_numbered_loses_nothing_whatever_the_ranges(spark):
    rows = [(x, "y" * 300) for x in random.Random(2).sample(range(10**6), 20_000)]
    df = spark.createDataFrame(rows, "v long, at string")
    sets = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    old = {k: spark.conf.get(k) for k in sets}
    try:
        for k, v in sets.items():
            spark.conf.set(k, v)
        got = sorted((r.row_id, r.v) for r in numbered(df, "v").select("row_id", "v").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == list(enumerate(sorted(v for v, _ in rows)))


def small_corpus(spark, n=300, dims=3, values=6, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(values) for _ in range(dims)], rng.randrange(2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_id long, q array<int>, label int")


def sequential(centroids, lists, q, nprobe, limit):
    """The search loop: lists by distance, rows in order, strict improvement, early end."""
    d = [int(((np.array(q) - c) ** 2).sum()) for c in centroids]
    best = []
    for j in sorted(range(len(centroids)), key=lambda j: (d[j], j))[:nprobe]:
        for row, v in lists[j]:
            x = int(((np.array(q) - np.array(v)) ** 2).sum())
            if len(best) < 5 or x < best[-1][0]:
                at = len(best)
                while at and best[at - 1][0] > x:
                    at -= 1
                best.insert(at, (x, row))
                best = best[:5]
        if limit and len(best) == 5 and best[-1][0] <= limit:
            break
    return best


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_search_equals_the_loop(spark, limit):
    rows, df = small_corpus(spark)
    centroids = cluster.train(df, 6)
    index = cluster.build_index(df, centroids)
    lists = [[] for _ in centroids]
    for r in index.vectors.orderBy("pos").collect():
        lists[r.list_id].append((r.row_id, r.q))
    queries = df.where("row_id < 60").select(F.col("row_id").alias("query_id"), "q")
    got = {}
    for r in search.ivf(index, queries, 4, limit, exclude_self=False).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.d, r.row_id))
    for i, q, _ in rows[:60]:
        assert got[i] == sequential(centroids, lists, q, 4, limit)


def test_fallback_is_exact_and_votes_survive(spark):
    _, df = small_corpus(spark, 200, 4, 30)
    index = cluster.build_index(df, cluster.train(df, 10))
    queries = df.select(F.col("row_id").alias("query_id"), "q")
    key = lambda x: sorted((r.query_id, r.rank, r.d) for r in x.collect())
    assert key(search.exact_fallback(index, queries, 1)) == key(search.exact(df, queries))
    lonely = spark.createDataFrame([(0, [1, 1, 1, 1], 1)], "row_id long, q array<int>, label int")
    one = cluster.build_index(lonely, cluster.train(lonely, 1))
    v = search.votes(queries.where("query_id = 0"), search.ivf(one, queries.where("query_id = 0")))
    assert [tuple(r) for r in v.collect()] == [(0, 0, None)]


def test_empty_clusters_are_reseeded(spark):
    df = spark.createDataFrame([(i, [i % 2, 0], 0) for i in range(10)], "row_id long, q array<int>, label int")
    centroids = cluster.train(df, 6)
    assert len(centroids) == 6 and set(map(tuple, centroids.tolist())) == {(0, 0), (1, 0)}
    stats = cluster.build_index(df, centroids).lists.orderBy("list_id").collect()
    assert sum(r.vec_count for r in stats) == 10 and len(stats) == 6
    with pytest.raises(ValueError):
        cluster.train(df.limit(0), 2)
    assert search.probe_count(0, 100) == 12 and search.probe_count(50, 100) == 24 and search.probe_count(50, 8) == 8


def test_corpus_file(spark, tmp_path):
    good = [{"vector": [0.01] * 13 + [-1], "label": "legit"}, {"label": "fraud", "vector": [1.0] * 14, "extra": {"a": [1]}}, {"label": "FRAUD", "vector": [0] * 14}]
    path = tmp_path / "c.json.gz"
    path.write_bytes(gzip.compress(json.dumps(good).encode()))
    rows = corpus.read_corpus(spark, str(path)).orderBy("row_id").collect()
    assert [r.label for r in rows] == [0, 1, 0] and rows[0].q == [100] * 13 + [-10000]
    for bad in ([{"vector": [0] * 13, "label": "x"}], [{"vector": [0] * 14}], [{"label": "x"}]):
        path.write_bytes(gzip.compress(json.dumps(bad).encode()))
        with pytest.raises(Exception):
            corpus.read_corpus(spark, str(path)).collect()


def test_packed_format():
    assert index_files.crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(0)
    c, v, labels = rng.integers(-10000, 10000, (3, 14)), rng.integers(-10000, 10000, (5, 14)), [0, 1, 1, 0, 1]
    data = index_files.pack(c, [0, 2, 2], [2, 0, 3], [1, 0, 2], v, labels)
    assert len(data) == 64 + 64 * 3 + 33 * 5
    got = index_files.unpack(data)
    assert (got[0] == c).all() and (got[4] == v).all() and got[5].tolist() == labels and got[1].tolist() == [0, 2, 2]
    broken = {"magic": b"XNH4" + data[4:], "version": data[:4] + b"\2" + data[5:], "size": data + b"\0", "crc": data[:9] + b"\1" + data[10:]}
    head = bytearray(data[:64])
    head[12:16] = (10**6).to_bytes(4, "little")
    head[48:52] = index_files.crc32c(bytes(head[:48]) + b"\0" * 4 + bytes(head[52:])).to_bytes(4, "little")
    broken["bounds"] = bytes(head) + data[64:]
    for reason, bad in broken.items():
        with pytest.raises(index_files.IndexFormatError) as e:
            index_files.unpack(bad)
        assert e.value.reason == reason


def test_a_broken_write_leaves_the_old_index(spark, tmp_path):
    _, df = small_corpus(spark, 60)
    path = str(tmp_path / "index")
    first = cluster.build_index(df, cluster.train(df, 3))
    index_files.write_index(first, path)
    bad = cluster.Index(first.centroids, first.lists, first.vectors.withColumn("q", F.raise_error(F.lit("lost")).cast("array<int>")))
    with pytest.raises(Exception):
        index_files.write_index(bad, path)
    assert index_files.open_index(spark, path).vectors.count() == 60
    second = cluster.build_index(df.where("row_id < 50"), cluster.train(df, 4))
    index_files.write_index(second, path)
    opened = index_files.open_index(spark, path)
    assert opened.vectors.count() == 50 and len(opened.centroids) == 4


def test_early_limit():
    assert search.early_limit_of(159) == 1590**2 and search.early_limit_of(0) == 0


def test_corpus_of_several_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json.gz").write_bytes(gzip.compress(json.dumps([{"vector": [j / 100] * 14, "label": "fraud"} for j in range(i * 10, i * 10 + 10)]).encode()))
    rows = corpus.read_corpus(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(30)) and [r.q[0] for r in rows] == [j * 100 for j in range(30)]
    assert len(cluster.train(corpus.read_corpus(spark, str(tmp_path)), 4)) == 4


def test_build_command(spark, tmp_path, capsys):
    from verdigris import build

    (tmp_path / "c.json.gz").write_bytes(gzip.compress(json.dumps([{"vector": [j / 100] * 14, "label": "fraud" if j % 3 else "legit"} for j in range(40)]).encode()))
    assert build.main([str(tmp_path)]) == 2 and "usage" in capsys.readouterr().err
    assert build.main([str(tmp_path / "c.json.gz"), str(tmp_path / "i"), "5", "x", "2"]) == 0
    i = index_files.open_index(spark, str(tmp_path / "i"))
    assert len(i.centroids) == 5 and i.vectors.count() == 40
    assert build._number("12", 5) == 12 and build._number("12x", 5) == 5 and build._number("", 5) == 5 and build._number(None, 5) == 5
    with pytest.raises(ValueError):
        (tmp_path / "e.json").write_text("[]")
        build.build(spark, str(tmp_path / "e.json"), str(tmp_path / "x"))


def test_lists_split_in_blocks(spark, monkeypatch):
    _, df = small_corpus(spark, 150, 3, 5)
    index = cluster.build_index(df, cluster.train(df, 3))
    queries = df.select(F.col("row_id").alias("query_id"), "q")
    key = lambda x: sorted(map(tuple, x.collect()))
    want = key(search.ivf(index, queries, 2))
    monkeypatch.setattr(search, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(search, "VISIT_BLOCK", 11)
    assert key(search.ivf(index, queries, 2)) == want
    monkeypatch.setattr(search, "QUERY_BLOCK", 40)
    assert len(search.exact(df, queries).collect()) == 150 * 5


def test_worst_distance_repairs_unanimous_votes(spark):
    rows = [(i, [i * 10], 0) for i in range(20)] + [(20 + i, [1000 + i], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, q array<int>, label int")
    index = cluster.build_index(df, np.array([[0], [95], [150], [1002]]))
    asked = spark.createDataFrame([(100, [30]), (101, [1002])], "query_id long, q array<int>")
    key = lambda **x: {(r.query_id, r.row_id) for r in search.ivf_repaired(index, asked, 1, 4, exclude_self=False, **x).collect()}
    plain, near = key(), key(far_legit=10, far_fraud=10**9)
    assert {x for x in plain if x[0] == 101} == {x for x in near if x[0] == 101} and {r for q, r in near if q == 100} == {1, 2, 3, 4, 5}


def test_stream_equals_batch(spark, tmp_path):
    _, df = small_corpus(spark, 80)
    index = cluster.build_index(df, cluster.train(df, 4))
    queries = df.select(F.col("row_id").alias("query_id"), "q")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, q array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, index, lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")), str(tmp_path / "state"), once=True).awaitTermination()
    key = lambda x: sorted(map(tuple, x.select("query_id", "frauds", "body").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(scored(queries, index))
