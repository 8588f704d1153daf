"""Toxicity: a linear classifier on character n-grams whose features are
scaled by naive Bayes log-count ratios.

The ratio of a feature is that of the smoothed shares of toxic and other
training texts that hold it. Features whose ratio is no more than noise are left
out; logistic regression over the others, each worth its ratio, gives the
weights. It is fitted on a bounded sample of labelled rows inside one task and
scores every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, small_batches, table, whole_row
from .ngrams import FEATURES, Linear, Rows, class_counts
from .tokens import text_list
from .training import labelled_sample, lbfgs, sigmoid

#: A feature is kept if it is in so many training texts and its log ratio is so many standard errors from 0.
LEAST_TEXTS, LEAST_Z = 5, 2.0
PENALTY = 1e-3


def fit(texts: list[str], y: np.ndarray) -> Linear:
    """The classifier, its bias set so that 0.5 is the cut that gives the best F1
    on texts left out: two halves, each scored by a classifier of the other."""
    y = np.asarray(y, np.float64)
    model = fit_plain(texts, y)
    half = np.arange(len(y)) % 2 == 0
    if min(y[half].sum(), y[~half].sum()) < 20:
        return model
    out = np.empty(len(y))
    for part in (half, ~half):
        other = fit_plain([t for t, k in zip(texts, part) if not k], y[~part])
        out[part] = other.margins([t for t, k in zip(texts, part) if k])
    order = np.argsort(-out, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1[:-1]))
    model.bias -= float(np.clip((out[order[best]] + out[order[best + 1]]) / 2, -2, 2))
    return model


def fit_plain(texts: list[str], y: np.ndarray) -> Linear:
    """Without texts of both classes, a constant score: the smoothed share of class 1."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Linear(np.zeros(FEATURES), float(np.log((n1 + 1) / (n0 + 1)) if len(y) else -1.0))
    p, q = class_counts(texts, y)
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    wanted = (p + q >= min(LEAST_TEXTS, len(y) // 10)) & (np.abs(ratio) >= LEAST_Z * np.sqrt(1 / (p + 1) + 1 / (q + 1)))
    rows, r = Rows(texts, wanted), ratio[wanted]
    # the rarer class weighs more, by the root of the ratio of the classes
    weight = np.where(y > 0, np.sqrt(n0 / n1), 1.0)
    weight /= weight.sum()

    def loss(v):
        m = rows.times(v[:-1] * r) + v[-1]
        g = weight * (sigmoid(m) - y)
        return weight @ (np.logaddexp(0, m) - y * m) + PENALTY / 2 * (v[:-1] @ v[:-1]), np.append(r * rows.back(g) + PENALTY * v[:-1], g.sum())

    v = lbfgs(loss, np.zeros(rows.m + 1))
    weights = np.zeros(FEATURES)
    weights[wanted] = v[:-1] * r
    return Linear(weights, float(v[-1]))


def train(sample: DataFrame, fitter) -> bytes:
    """Fits inside one task; returns the packed model."""

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts += text_list(b.column("text"))
            y += b.column("y").to_pylist()
        # rows arrive in any order: sorted, the sums of floats are the same each time
        order = sorted(range(len(texts)), key=texts.__getitem__)
        model = fitter([texts[i] for i in order], np.array([y[i] for i in order], np.float64))
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.pack()], pa.binary())})
        pa.default_memory_pool().release_unused()

    # a sample without rows may run no task at all
    row = sample.select("text", "y").repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row[0]) if row else fitter([], np.zeros(0)).pack()


def score(rows: DataFrame, model: bytes, threshold: float, kind: type[Linear] = Linear) -> DataFrame:
    """Rows (row, text) as (row, score, predicted); with no column text, the one inside ``row`` is scored."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    own = "text" in rows.columns

    def run(batches):
        loaded = kind.unpack(shared.value)
        for b in batches:
            s = loaded.scores(text_list(b.column("text") if own else b.column("row").field("text")))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["row", "score", "predicted"])

    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def toxicity_model(docs: DataFrame, labels: DataFrame) -> bytes:
    small_batches(docs.sparkSession)
    return train(labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 5) != 0), fit)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts hold no feature and get the bias's score; a null id is
    not held out and never a training row; equal texts get equal scores; without
    labels every score is the same; an empty table gives no rows."""
    out = score(docs.select(F.col("doc_id").alias("row"), "text"), toxicity_model(docs, labels), threshold)
    return out.select(F.col("row").alias("doc_id"), (crc_mod(F.col("row"), 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and empty texts, null and repeated ids and an empty table as in
    toxicity(); without labels of both kinds no row goes."""
    return score(docs.select(whole_row(docs).alias("row")), toxicity_model(docs, labels), threshold).where("predicted = 0").select("row.*")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
