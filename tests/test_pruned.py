"""Search by boxes against all pairs, and corpora of several files."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import cluster, pruned, search
from verdigris.sources import corpus


def all_pairs(m, rows, q, k, own, worst):
    d = ((q[:, None] - m[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(q)):
        near = sorted((int(d[i, j]), int(rows[j]), j) for j in range(len(m)) if (own is None or rows[j] != own[i]) and (worst is None or d[i, j] < worst[i]))
        out += [(i, j, x) for x, _, j in near[:k]]
    return out


@pytest.mark.parametrize("values", [2, 6, 10_000, 1 << 24])
@pytest.mark.parametrize("chunk", [50, 1 << 15])
def test_nearest_rows_equal_all_pairs(monkeypatch, values, chunk):
    monkeypatch.setattr(pruned, "CHUNK", chunk)
    rng = np.random.default_rng(values)
    for n, asked, dims in ((1, 3, 2), (4, 70, 1), (700, 130, 3), (900, 65, 14)):
        m, q, rows = rng.integers(-values, values, (n, dims)), rng.integers(-values, values, (asked, dims)), rng.permutation(2 * n)[:n]
        same = min(n, asked)
        q[:same] = m[:same]
        for own in (None, np.r_[rows[:same], np.full(asked - same, -1)]):
            for worst in (None, rng.integers(0, values * values * dims, asked)):
                got = pruned.nearest_rows(m, rows, q, 5, own, worst)
                assert sorted(zip(*(x.tolist() for x in got))) == sorted(all_pairs(m, rows, q, 5, own, worst))


def test_a_large_list_takes_less_than_all_pairs():
    # 40,000 x 40,000 pairs as one product of matrices take over 10 s, and copies as many ties
    rng = np.random.default_rng(0)
    m = rng.integers(0, 10_000, (40_000, 4))
    m[20_000:] = 7
    began = time.process_time()
    i, j, d = pruned.nearest_rows(m, np.arange(40_000), m, 5)
    assert len(i) == 200_000 and time.process_time() - began < 10
    assert j[i == 30_000].tolist() == [20_000, 20_001, 20_002, 20_003, 20_004]


def test_lists_beyond_a_plane_are_not_visited_and_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(0, 40, 2) + 100 * (i % 4)], i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, q array<int>, label int")
    index = cluster.build_index(df, np.array([[20, 20], [120, 120], [220, 220], [320, 320]]))
    queries = df.select(F.col("row_id").alias("query_id"), "q")
    seen, scan = [], search._scan
    monkeypatch.setattr(search, "_scan", lambda visits, *x: (seen.append(visits), scan(visits, *x))[1])
    key = lambda x: sorted(map(tuple, x.collect()))
    got = key(search.ivf(index, queries, 4))
    assert seen[-1].count() == 0
    monkeypatch.setattr(search, "PLANES", 0)
    assert key(search.ivf(index, queries, 4)) == got == key(search.exact(df, queries))


def test_a_corpus_of_many_records_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FILE_ROWS", 10)
    df = spark.range(35).select(F.col("id").alias("row_id"), F.array(*[F.col("id") / 100] * 14).alias("vector"), F.when(F.col("id") % 3 == 0, "fraud").otherwise("legit").alias("label"))
    corpus.write_corpus(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*/*.gz"))) == 4
    got = corpus.read_corpus(spark, str(tmp_path / "c")).orderBy("row_id").collect()
    assert [(r.row_id, r.q[0], r.label) for r in got] == [(i, 100 * i, int(i % 3 == 0)) for i in range(35)]
