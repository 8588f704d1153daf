"""Held-out accuracy and edge cases of the two classifiers."""

import numpy as np
from pyspark.sql import functions as F

from verdigris.llm import ngrams, quality, toxicity
from verdigris.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    p = y.sum()
    return (rank[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p))


def held_out(spark, query, label):
    df = QUERIES[query](spark, FOLDER)
    rows = df.where("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").select("score", "predicted", label).collect()
    s, p, y = (np.array(x) for x in zip(*rows))
    return auc(s, y), (p == y).mean(), p[y == 1].mean(), p[y == 0].mean()


def test_toxicity_on_texts_left_out(spark):
    a, right, found, wrong = held_out(spark, "op4_toxicity", "toxic")
    assert a > 0.98 and right > 0.96 and found > 0.85 and wrong < 0.03


def test_quality_on_texts_left_out(spark):
    a, right, found, _ = held_out(spark, "op7_quality", "quality")
    assert a > 0.98 and right > 0.96 and found > 0.97


def tables(spark):
    docs = [(i, f"{'bad vile' if i % 3 == 0 else 'fine good'} words {i}", 0.5) for i in range(300)] + [(None, "bad vile", 0.5), (1000, None, 0.5), (1001, "", 0.5), (0, "bad vile words 0", 0.5)]
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(300)] + [(5, 0, 0), (None, 1, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_edges(spark):
    docs, labels = tables(spark)
    for f, label in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        got = f(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert not [r for r in got if r.doc_id is None][0].held_out
        assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1
        assert f(docs.limit(0), labels).count() == 0
        assert len({r.score for r in f(docs, labels.limit(0)).collect()}) == 1
        assert len({r.score for r in f(docs, labels.withColumn(label, F.lit(1))).collect()}) == 1
    docs = docs.withColumns({"_predicted": F.lit("x"), "row": F.lit(2.5)})
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {(r.score, r.row, r._predicted) for r in kept.collect()} == {(0.5, 2.5, "x")}
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0 and toxicity.drop_toxic(docs, labels.limit(0)).count() == docs.count()
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 3}
    assert not {r.doc_id for r in kept.collect()} & {i for i in range(300) if i % 3 == 0}


def test_labels_of_held_out_rows_do_not_matter(spark):
    from verdigris.llm.common import crc_mod

    docs, labels = tables(spark)
    other = labels.withColumn("toxic", F.when(crc_mod(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    key = lambda x: sorted((str(r.doc_id), r.score) for r in x.collect())
    assert key(toxicity.toxicity(docs, labels)) == key(toxicity.toxicity(docs, other))


def test_features_are_whole_and_distinct(monkeypatch):
    texts = ["abcdefgh" * 50, "", "xyz", "abcdefgh" * 50 + "tail!"]
    whole = {tuple(p) for p in zip(*(x.tolist() for x in ngrams.features(texts)))}
    monkeypatch.setattr(ngrams, "PIECE", 64)
    pieces = list(zip(*(x.tolist() for x in ngrams.features(texts))))
    assert len(pieces) == len(set(pieces)) and set(pieces) == whole
    model = ngrams.Linear(np.arange(ngrams.FEATURES) % 7 - 3, 0.5, 2.0)
    assert np.allclose(ngrams.Linear.unpack(model.pack()).scores(texts), model.scores(texts))


def plain_features(text):
    """By definition: each distinct run of 3 to 7 bytes of the lower-cased text, zeros beyond its end, hashed."""
    raw = text.lower().encode() + bytes(8)
    out = set()
    for k, n in enumerate((3, 4, 5, 6, 7)):
        for i in range(len(raw) - 8):
            h = int.from_bytes(raw[i : i + n], "little") * 0x9E3779B97F4A7C15 % 2**64 >> 64 - 18
            out.add((k << 18) + h)
    return out


TEXTS = [f"{'bad vile' if i % 3 == 0 else 'fine good'} {'xyz' * (i % 4)} wörds {i % 7}" for i in range(60)]


def test_features_by_definition():
    got = ngrams.features(TEXTS)
    assert set(zip(*(x.tolist() for x in got))) == {(i, f) for i, t in enumerate(TEXTS) for f in plain_features(t)}


def test_log_count_ratios_and_fit_by_definition():
    """The weights, recomputed one by one, leave no slope in the penalised loss."""
    import math

    y = np.array([float(i % 3 == 0 or i % 10 == 1) for i in range(60)])
    model = toxicity.fit_plain(TEXTS, y)
    sets = [plain_features(t) for t in TEXTS]
    n1, n0 = y.sum(), 60 - y.sum()
    ratio = {}
    for f in set().union(*sets):
        p, q = sum(f in s for s, v in zip(sets, y) if v), sum(f in s for s, v in zip(sets, y) if not v)
        r = math.log((p + 1) / (n1 + 2)) - math.log((q + 1) / (n0 + 2))
        if p + q >= 5 and abs(r) >= 2 * math.sqrt(1 / (p + 1) + 1 / (q + 1)):
            ratio[f] = r
    kept = set(np.flatnonzero(model.wanted).tolist())
    assert kept <= set(ratio) and len(kept) > 0.9 * len(ratio)
    margins = [model.bias + sum(float(model.weights[f]) for f in s if f in ratio) for s in sets]
    assert np.allclose(model.margins(TEXTS), margins, atol=1e-4)
    scale = [math.sqrt(n0 / n1) if v else 1.0 for v in y]
    g = [s / sum(scale) * (1 / (1 + math.exp(-m)) - v) for s, m, v in zip(scale, margins, y)]
    assert abs(sum(g)) < 2e-3
    for f in list(ratio)[::25]:
        v = float(model.weights[f]) / ratio[f]
        assert abs(ratio[f] * sum(x for x, s in zip(g, sets) if f in s) + 1e-3 * v) < 4e-3


def test_non_negative_risk_by_definition():
    """Steps of the estimator, recomputed over a dense table of features."""
    trusted, drawn = np.array([float(i % 3 != 0 and i < 40) for i in range(60)]), np.array([float(i >= 15) for i in range(60)])
    sets = [plain_features(t) for t in TEXTS]
    p_n, u_n, prior = trusted.sum(), drawn.sum(), 0.6
    keep = []
    for f in sorted(set().union(*sets)):
        has = np.array([f in s for s in sets], float)
        a, b = (has @ trusted + 1) / (p_n + 2), (has @ drawn + 1) / (u_n + 2)
        var = 1 / p_n + 1 / u_n - 2 * (trusted @ drawn) / (p_n * u_n)
        if max(has @ trusted, has @ drawn) >= 5 and abs(a - b) >= 2 * np.sqrt(b * (1 - b) * var):
            keep.append(has)
    x = np.array(keep).T
    x = np.c_[x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)), np.ones(60)]
    w = np.r_[np.zeros(x.shape[1] - 1), np.log(prior / (1 - prior))]
    m1, m2, turned = np.zeros_like(w), np.zeros_like(w), 0
    for t in range(1, quality.STEPS + 1):
        m = x @ w
        risk_u = (drawn * np.log1p(np.exp(m))).sum() / u_n - prior * (trusted * np.log1p(np.exp(m))).sum() / p_n
        s = 1 / (1 + np.exp(-m))
        g_u = x.T @ (drawn * s / u_n - prior * trusted * s / p_n)
        g = x.T @ (prior * trusted * (s - 1) / p_n) + g_u if risk_u >= 0 else -g_u
        turned += risk_u < 0
        g[:-1] += quality.PENALTY * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g**2
        w -= quality.RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    model = quality.fit_pu(TEXTS, trusted, prior, drawn)
    assert np.allclose(model.margins(TEXTS), x @ w, atol=1e-3)


def test_non_negative_risk_learns_without_negatives():
    rng = np.random.default_rng(0)
    good = ["good fine " + "".join(rng.choice([*"abcdef "], 60)) for _ in range(300)]
    bad = ["table | row | " + "".join(rng.choice([*"abcdef "], 60)) for _ in range(100)]
    model = quality.fit_pu(good + bad, np.array([1.0] * 250 + [0.0] * 150), prior=0.75)
    assert model.scores(good[250:]).mean() > 0.8 > 0.5 > model.scores(bad).mean()


def test_marks_of_other_texts_do_not_matter_and_unlabelled_ones_do(spark):
    docs, labels = tables(spark)
    kind = {r.text: r.y for r in quality.drawn_sample(docs, labels.where("doc_id < 150")).collect()}
    assert {1, 2, 3} >= set(kind.values()) and any(int(t.split()[-1]) >= 150 for t in kind if t)
    key = lambda x: sorted((str(r.doc_id), r.score) for r in x.collect())
    assert key(quality.quality(docs, labels)) == key(quality.quality(docs, labels.where("quality = 1")))


def test_prior_is_that_of_the_unlabelled_text():
    rng = np.random.default_rng(1)
    some = lambda head, n: [head + "".join(rng.choice([*"abcdef "], 60)) for _ in range(n)]
    texts = some("good fine ", 300) + some("good fine ", 150) + some("table | row | ", 350)
    got = quality.estimated_prior(texts, np.repeat([1.0, 0.0], [300, 500]), np.repeat([0.0, 1.0], [300, 500]))
    assert abs(got - 0.3) < 0.06
