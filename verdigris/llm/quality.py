"""Quality classifier by positive-unlabelled learning.

Texts marked good are trusted positives, all other marks are ignored; documents
drawn from all those not held out, marked or not, are the unlabelled text. The
class prior is the least ratio of the shares of unlabelled and of positive texts
above a cut, scored by classifiers of the other half. With it, the risk on
positives and on unlabelled text gives an unbiased risk on negatives; where that
falls below zero, which only overfitting brings about, it counts as zero (the
non-negative estimator) and the step undoes it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, table
from .ngrams import FEATURES, Linear, Rows, class_counts, features
from .toxicity import score, train
from .training import TRAIN_CHARS, _STEPS, draw, sigmoid

#: Most unlabelled rows the classifier is fitted on, about; positives are half as many at most.
ROWS = 5_000
LEAST_TEXTS, LEAST_Z = 5, 2.0
STEPS, RATE, PENALTY = 100, 0.05, 1e-4
#: Bounds of the class prior. Where the estimate reaches the upper one, nothing tells negatives apart.
LOW, HIGH = 0.02, 0.98


def fit_pu(texts: list[str], trusted: np.ndarray, prior: float | None = None, drawn: np.ndarray | None = None) -> PerLength:
    """``trusted``: 1 for a trusted positive. ``drawn``: 1 for a text of the
    unlabelled set, all texts unless given. The class prior is estimated unless
    given. Without positives or sign of negatives the score is the same everywhere."""
    n = len(texts)
    trusted = np.asarray(trusted, np.float64)
    drawn = np.ones(n) if drawn is None else np.asarray(drawn, np.float64)
    if not trusted.sum() or not drawn.sum() or np.array_equal(trusted, drawn):
        share = ((trusted * drawn).sum() + 1) / (drawn.sum() + 2)
        return _constant(share)
    if prior is None:
        prior = estimated_prior(texts, trusted, drawn)
        if prior >= HIGH:
            return _constant(HIGH)
    return _fitted(texts, trusted, drawn, min(max(prior, LOW), HIGH))


def _constant(prior: float) -> PerLength:
    prior = min(max(prior, LOW), HIGH)
    return PerLength(np.zeros(FEATURES), float(np.log(prior / (1 - prior))))


def estimated_prior(texts: list[str], trusted: np.ndarray, drawn: np.ndarray) -> float:
    """Share of positives in the unlabelled text. Above any cut of a score lies at
    least that share times the positives' share there; the cut that comes nearest,
    with a margin for chance, is taken. Each half is scored by a classifier that
    tells positives of the other half from its unlabelled text."""
    half = np.arange(len(texts)) % 2 == 0
    out = []
    for part in (half, ~half):
        p, u = trusted[part], drawn[part]
        if min(p.sum(), u.sum(), trusted[~part].sum(), drawn[~part].sum()) < 1:
            return HIGH
        other = _fitted([t for t, k in zip(texts, part) if not k], trusted[~part], drawn[~part], None)
        m = other.margins([t for t, k in zip(texts, part) if k])
        order = np.argsort(-m, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(m[order]) != 0, True))  # cuts lie between different scores
        above_p, above_u = np.cumsum(p[order])[ends] / p.sum(), np.cumsum(u[order])[ends] / u.sum()
        margin = np.sqrt(np.log(40) / 2 / u.sum()) + np.sqrt(np.log(40) / 2 / p.sum())
        some = above_p > 0
        best = np.argmin((above_u[some] + margin) / above_p[some])
        out.append(above_u[some][best] / above_p[some][best])
    return float(np.mean(out))


def _fitted(texts: list[str], trusted: np.ndarray, drawn: np.ndarray, prior: float | None) -> PerLength:
    """With a prior, by the non-negative risk; without, positives against unlabelled text."""
    n, p_n, u_n = len(texts), trusted.sum(), drawn.sum()
    p, _ = class_counts(texts, trusted)
    u = p if np.array_equal(trusted, drawn) else class_counts(texts, drawn)[0]
    # features whose share differs between positives and unlabelled text; texts of both sets vary together
    a, b = (p + 1) / (p_n + 2), (u + 1) / (u_n + 2)
    var = 1 / p_n + 1 / u_n - 2 * (trusted @ drawn) / (p_n * u_n)
    z = (a - b) / np.sqrt(b * (1 - b) * max(var, 1e-12))
    wanted = (np.maximum(p, u) >= min(LEAST_TEXTS, n // 10)) & (np.abs(z) >= LEAST_Z)
    rows = Rows(texts, wanted)
    wide = np.sqrt(np.maximum(rows.sizes(), 1))  # rows of length 1
    w = np.zeros(rows.m + 1)
    start = 0.5 if prior is None else prior
    w[-1] = np.log(start / (1 - start))
    first, second = np.zeros_like(w), np.zeros_like(w)
    in_p, in_u = trusted / p_n, drawn / u_n
    for t in range(1, STEPS + 1):
        m = rows.times(w[:-1]) / wide + w[-1]
        s = sigmoid(m)
        if prior is None:
            g = (in_p * (s - 1) + in_u * s) / 2
        else:
            as_bad = np.logaddexp(0, m)  # loss of calling a text bad
            negative = in_u @ as_bad - prior * (in_p @ as_bad)
            g_negative = in_u * s - prior * in_p * s
            g = prior * in_p * (s - 1) + g_negative if negative >= 0 else -g_negative
        grad = np.append(rows.back(g / wide) + PENALTY * w[:-1], g.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(FEATURES)
    weights[wanted] = w[:-1]
    return PerLength(weights, float(w[-1]))


class PerLength(Linear):
    """Sums of weights are divided by the root of the number of features."""

    def margins(self, texts):
        text, feature = features(texts, self.wanted)
        n = len(texts)
        return np.bincount(text, self.weights[feature].astype(np.float64), n) / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1)) + self.bias


def drawn_sample(docs: DataFrame, labels: DataFrame, most: int = ROWS) -> DataFrame:
    """(text, y) of documents that are not held out: y is 1 for a trusted positive,
    2 for a text of the unlabelled set, 3 for both. About ``most`` unlabelled
    ones, from all documents, and ``most`` / 2 positives are drawn by hashes of the id."""
    allowed = F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)
    good = labels.where(allowed & (F.col("quality") == 1)).select("doc_id").distinct()
    rows = docs.where(allowed).select("doc_id", "text")
    share = lambda df, n: int(_STEPS * min(1.0, n / max(df.count(), 1)))
    good = good.where(draw(F.col("doc_id")) < share(good, most // 2)).limit(most).withColumn("_good", F.lit(1))
    any_ = draw(F.xxhash64(F.lit("unlabelled"), "doc_id")) < share(rows, most)
    rows = rows.where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS)).join(F.broadcast(good), "doc_id", "left")
    y = F.coalesce("_good", F.lit(0)) + F.when(any_, 2).otherwise(0)
    # repeated ids: one text each
    return rows.withColumn("y", y).where("y > 0").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def fit_drawn(texts: list[str], y: np.ndarray) -> PerLength:
    kind = np.asarray(y).astype(np.int64)
    return fit_pu(texts, kind & 1, drawn=kind >> 1)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts hold no feature and get the bias's score; a null id is
    not held out and never a training row; equal texts get equal scores; without
    labels every score is the same; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    model = train(drawn_sample(docs, labels), fit_drawn)
    out = score(docs.select(F.col("doc_id").alias("row"), "text"), model, threshold, PerLength)
    return out.select(F.col("row").alias("doc_id"), (crc_mod(F.col("row"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
