"""Character n-gram features of whole texts, hashed, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

#: Lengths in bytes of the lower-cased UTF-8 text; each has its own table of 2**BITS features.
LENGTHS = (3, 4, 5, 6, 7)
BITS = 18
FEATURES = len(LENGTHS) << BITS
#: Bytes of text handled at once; longer texts go piece by piece.
PIECE = 1 << 20
_GAP = b"\x00" * 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes of some texts, zeros between them; for each byte its text's number
    less that of the piece's first text, and whether n-grams start there; and the
    first text. A text cut up overlaps in bytes at which no n-gram starts."""
    held, owner, starts, size = [], [], [], 0

    def done():
        buf = np.frombuffer(b"".join(held) + _GAP, np.uint8)
        sizes = [len(x) for x in held]
        live = np.repeat(np.tile([True, False], len(held)), np.ravel([(s, n - s) for s, n in zip(starts, sizes)]))
        return buf, np.repeat(np.array(owner, np.uint32) - np.uint32(owner[0]), sizes), live, owner[0]

    for i, t in enumerate(texts):
        raw = t.lower().encode("utf-8", "replace")
        for at in range(0, max(len(raw), 1), PIECE):
            part = raw[at : at + PIECE + max(LENGTHS) - 1] + _GAP
            if held and (size + len(part) > PIECE or i - owner[0] >= 1 << 32 - BITS):
                yield done()
                held, owner, starts, size = [], [], [], 0
            held.append(part)
            owner.append(i)
            starts.append(min(PIECE, len(raw) - at))
            size += len(part)
    if held:
        yield done()


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; only features where ``wanted`` (by feature) is true."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    split = any(len(t) > PIECE // 4 for t in texts)
    for buf, owner, live, first in _pieces(texts):
        n = len(owner)
        keys = np.ndarray((n,), "<u8", buf, strides=(1,)).copy()
        real = live & (buf[:n] != 0)
        for k, length in enumerate(LENGTHS):
            h = ((keys & np.uint64((1 << 8 * length) - 1)) * _ODD >> np.uint64(64 - BITS)).astype(np.uint32)
            at = np.flatnonzero(real if wanted is None else wanted[k << BITS : (k + 1) << BITS][h] & real)
            pairs = _distinct(owner[at] << np.uint32(BITS) | h[at])
            rows.append((pairs >> np.uint32(BITS)).astype(np.int64) + first)
            cols.append((pairs & np.uint32((1 << BITS) - 1)).astype(np.int32) + np.int32(k << BITS))
    row, col = np.concatenate(rows), np.concatenate(cols)
    if split:  # the pieces of a long text may share features
        pairs = _distinct(row * FEATURES + col)
        row, col = pairs // FEATURES, (pairs % FEATURES).astype(np.int32)
    return row, col


class Linear:
    """Weights of hashed n-grams, a bias, and the logistic score."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0):
        self.weights, self.bias, self.scale = weights.astype(np.float32), bias, scale
        self.wanted = self.weights != 0

    def margins(self, texts: list[str]) -> np.ndarray:
        text, feature = features(texts, self.wanted)
        return np.bincount(text, self.weights[feature].astype(np.float64), len(texts)) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * self.margins(texts), -500, 500)))

    def pack(self) -> bytes:
        at = np.flatnonzero(self.wanted)
        return zlib.compress(np.array([self.bias, self.scale], "<f8").tobytes() + np.array([len(at)], "<i8").tobytes() + at.astype("<i4").tobytes() + self.weights[at].astype("<f4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Linear:
        raw = zlib.decompress(data)
        bias, scale = np.frombuffer(raw, "<f8", 2)
        n = int(np.frombuffer(raw, "<i8", 1, 16)[0])
        w = np.zeros(FEATURES, np.float32)
        w[np.frombuffer(raw, "<i4", n, 24)] = np.frombuffer(raw, "<f4", n, 24 + 4 * n)
        return cls(w, float(bias), float(scale))


class Rows:
    """Sparse 0/1 rows of selected features, for training, in parts of ``per`` texts:
    products are taken part by part, so nothing as large as all of it is made beside it."""

    def __init__(self, texts: list[str], wanted: np.ndarray, per: int = 200):
        number = np.cumsum(wanted) - 1
        self.n, self.m, self.per = len(texts), int(wanted.sum()), per
        self.parts = []
        for i in range(0, len(texts), per):
            r, c = features(texts[i : i + per], wanted)
            self.parts.append((r.astype(np.uint16), number[c].astype(np.int32)))

    def _places(self):
        return ((slice(i * self.per, (i + 1) * self.per), r, c) for i, (r, c) in enumerate(self.parts))

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for at, r, c in self._places():
            out[at] = np.bincount(r, w[c], len(out[at]))
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.m)
        for at, r, c in self._places():
            out += np.bincount(c, g[at][r], self.m)
        return out

    def sizes(self) -> np.ndarray:
        """Features of each row."""
        return self.times(np.ones(self.m))


def class_counts(texts: list[str], positive: np.ndarray, per: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """By feature, the number of positive and of other texts that hold it."""
    pos, all_ = np.zeros(FEATURES), np.zeros(FEATURES)
    for i in range(0, len(texts), per):
        r, c = features(texts[i : i + per])
        all_ += np.bincount(c, minlength=FEATURES)
        pos += np.bincount(c, positive[i : i + per][r].astype(np.float64), FEATURES)
    return pos, all_ - pos
