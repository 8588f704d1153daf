"""Suffix arrays by two-stage sorting, and common prefixes, in numpy.

Only suffixes smaller than their successors are sorted directly; scanning the
buckets of first bytes in order induces the place of every other suffix. Orders
and prefixes are exact up to ``depth`` bytes, which is all that a search for
repeats of that length needs; equal stretches are skipped by their hashes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ODD = np.random.default_rng(6).integers(1, 2**63, 20, dtype=np.uint64) * _U(2) + _U(1)


class Hashes:
    """64-bit hashes of all stretches of 1, 2, 4, ... ``most`` bytes of a text.
    ``seed`` picks one of two families."""

    def __init__(self, text: np.ndarray, most: int, seed: int = 0):
        n = len(text)
        h = (text.astype(np.uint64) + _U(1)) * _ODD[10 * seed]
        self.of = {1: h}
        size = 1
        while size < most:
            # beyond the end, stretches count as filled up with nothing
            nxt = np.zeros(n, np.uint64)
            nxt[: max(n - size, 0)] = h[size:]
            h = (h ^ (h >> _U(29))) * _ODD[10 * seed + size.bit_length()] + nxt
            size *= 2
            self.of[size] = h
        self.sizes = sorted(self.of, reverse=True)

    def at(self, size: int, i: np.ndarray) -> np.ndarray:
        h = self.of[size]
        return np.where(i < len(h), h[np.minimum(i, len(h) - 1)], 0)

    def window(self, length: int) -> np.ndarray:
        """Hash of the ``length`` bytes from each position that has so many."""
        n = len(self.of[1]) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, at, left = np.zeros(n, np.uint64), 0, length
        for size in self.sizes:
            while left >= size:
                out = (out ^ (out >> _U(31))) * _ODD[9] + self.of[size][at : at + n]
                at, left = at + size, left - size
        return out ^ (out >> _U(32))


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the end counts as smallest."""
    n = len(text)
    nxt = np.concatenate([text[1:].astype(np.int16), [-1]])
    change = np.flatnonzero(text != nxt)
    at = change[np.searchsorted(change, np.arange(n))]
    return text[at] < nxt[at]


def _sort_directly(text: np.ndarray, own: np.ndarray, hashes: Hashes, depth: int) -> np.ndarray:
    """Suffixes ``own`` in order of their first ``depth`` bytes."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    keys = np.ndarray((len(text),), ">u8", padded, strides=(1,))
    order = own[np.argsort(keys[own].astype(np.uint64), kind="stable")]
    out = order.copy()
    k = keys[order].astype(np.uint64)
    new = np.concatenate([[True], k[1:] != k[:-1]])
    place = np.arange(len(order))
    done = np.full(len(order), 8)
    while True:
        # groups of suffixes still equal: only those of two or more, not yet compared to ``depth``
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        open_ = np.repeat((size > 1) & (done[first] < depth), size)
        if not open_.any():
            return out
        order, place, done, new = order[open_], place[open_], done[open_], new[open_]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(new)))
        for step in hashes.sizes:
            if step < 8:
                break
            h = hashes.at(step, order + done)
            same = (np.minimum.reduceat(h, first) == np.maximum.reduceat(h, first)) & (done[first] < depth)
            done = done + step * np.repeat(same, size)
        at = np.minimum(order + done, len(text))
        k = np.where(at < len(text), keys[np.minimum(at, len(text) - 1)].astype(np.uint64), 0)
        short = np.where(at < len(text), 1, 0)  # the end before a zero byte
        group = np.cumsum(new)
        move = np.lexsort((short, k, group))
        order, done, k, short = order[move], done[move] + 8, k[move], short[move]
        out[place] = order
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (short[1:] != short[:-1]) | (group[1:] != group[:-1])])


def suffix_array(text: np.ndarray, depth: int, hashes: Hashes | None = None) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    hashes = hashes or Hashes(text, 256)
    small = smaller_than_next(text)
    direct = _sort_directly(text, np.flatnonzero(small), hashes, depth) if small.any() else np.zeros(0, np.int64)
    starts = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []

    def place(done: np.ndarray, c: int) -> None:
        """Induces the predecessors, of larger first byte, of suffixes in order."""
        before = done[done > 0] - 1
        b = text[before]
        before, b = before[b > c], b[b > c]
        order = np.argsort(b, kind="stable")
        before, b = before[order], b[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        for part, first in zip(np.split(before, cuts), b[np.concatenate([[0], cuts])] if len(b) else []):
            induced[first].append(part)

    for c in range(256):
        large = induced[c]
        edge = np.concatenate(large) if large else np.zeros(0, np.int64)
        while len(edge):  # runs of one byte
            before = edge[edge > 0] - 1
            edge = before[text[before] == c]
            if len(edge):
                large.append(edge)
        bucket = np.concatenate([*large, direct[starts[c] : starts[c + 1]]]) if large else direct[starts[c] : starts[c + 1]]
        if len(bucket):
            out.append(bucket)
            place(bucket, c)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, hashes: Hashes, depth: int) -> np.ndarray:
    """Common prefix of each suffix and the next in ``order``; exact up to ``depth``."""
    a, b = order[:-1], order[1:]
    n = len(hashes.of[1])
    length = np.zeros(len(a), np.int64)
    for step in hashes.sizes:
        # the longest stretch as often as ``depth`` holds it, each shorter one once
        for _ in range(max(1, depth // step) if step == hashes.sizes[0] else 1):
            fits = np.maximum(a, b) + length + step <= n
            same = fits & (hashes.at(step, a + length) == hashes.at(step, b + length))
            length += step * same
    return length
