"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rows a classifier is fitted on, about; and most characters of such a row.
TRAIN_ROWS, TRAIN_CHARS = 8_000, 200_000
_STEPS = 1 << 20


def draw(key: Column) -> Column:
    """A number from 0 to _STEPS - 1 by which ids are drawn, alike in every run."""
    return F.pmod(F.xxhash64(F.lit("train"), key), F.lit(_STEPS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int = TRAIN_ROWS) -> DataFrame:
    """(text, y): documents whose ids ``allowed`` lets in, about ``most`` of them,
    drawn by a hash of the id. A null label counts as none; where labels of an id
    differ, the highest holds."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    part = known.where(draw(F.col("doc_id")) < int(_STEPS * min(1.0, most / max(n, 1)))).limit(2 * most)
    rows = docs.where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS)).select("doc_id", "text")
    # repeated ids: one text each
    return rows.join(F.broadcast(part), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def lbfgs(f, x: np.ndarray, steps: int = 40, memory: int = 8) -> np.ndarray:
    """Minimises f, which returns value and gradient."""
    past: list = []
    fx, g = f(x)
    for _ in range(steps):
        q, seen = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ q)
            seen.append(a)
            q -= a * y
        q *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y, r), a in zip(past, reversed(seen)):
            q += s * (a - r * (y @ q))
        step, slope = 1.0, g @ q
        while True:
            nx = x - step * q
            nf, ng = f(nx)
            if nf <= fx - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = nx - x, ng - g
        done = abs(fx - nf) < 1e-7 * max(abs(fx), 1e-12)
        if s @ y > 1e-12:
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        x, fx, g = nx, nf, ng
        if done:
            break
    return x


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))
