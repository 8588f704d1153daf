"""Squared Euclidean distances of integer vectors, exact in 64 bits."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2sq(a: str | Column, b: str | Column, dims: int) -> Column:
    """Unrolled, so that it stays in compiled code."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    parts = []
    for i in range(dims):
        d = (F.get(x, F.lit(i)) - F.get(y, F.lit(i))).cast("long")
        parts.append(d * d)
    return reduce(add, parts)


def bbox_bound(q: str, low: str, high: str) -> Column:
    """Least squared distance from a vector to a box. There is one a query and list, so
    it is kept short by higher-order functions instead of unrolled."""
    outside = F.zip_with(F.zip_with(low, q, lambda l, x: l - x), F.zip_with(q, high, lambda x, h: x - h), lambda a, b: F.greatest(a, b, F.lit(0)).cast("long"))
    return F.aggregate(outside, F.lit(0).cast("long"), lambda t, d: t + d * d)


def matrix_l2sq(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """All squared distances; doubles hold these integers exactly."""
    a, b = rows.astype(np.float64), others.astype(np.float64)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return d.astype(np.int64)


def least_k(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least values of each row, by row, then value, ties to
    the column on the left. Only what reaches the k-th value is sorted."""
    if d.shape[1] > k:
        i, j = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])
    else:
        i, j = np.divmod(np.arange(d.size), max(d.shape[1], 1))
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]
