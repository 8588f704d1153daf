"""Patched frame-of-reference coding of integer arrays.

A block holds 256 values. Its minimum is subtracted; what remains is packed at
the width that suffices for a given share of the values; the others keep their
low bits in place and their high bits in an exception list. An index has the
start of every block, so a block can be read alone.

Segment: "VGP1", then as little-endian u32 the counts of values and blocks and
the byte length of the bodies; u32 starts of the blocks; the bodies. Body: u32
minimum, u8 width, u8 exceptions, the packed values (four lanes of 64 values, each
``width`` words of 64 bits), exception positions (u8) and high bits (u32).
"""

from __future__ import annotations

import numpy as np

BLOCK, LANE = 256, 64
MAGIC = b"VGP1"


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) values below 2**width to (n, 4 * width) words."""
    lanes = v.reshape(-1, LANE).astype(np.uint64)
    out = np.zeros((len(lanes), width), np.uint64)
    for i in range(LANE):
        at, off = divmod(i * width, LANE)
        out[:, at] |= lanes[:, i] << np.uint64(off)
        if off + width > LANE:
            out[:, at + 1] |= lanes[:, i] >> np.uint64(LANE - off)
    return out.reshape(len(v), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.reshape(-1, width)
    out = np.empty((len(rows), LANE), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANE):
        at, off = divmod(i * width, LANE)
        x = rows[:, at] >> np.uint64(off)
        if off + width > LANE:
            x |= rows[:, at + 1] << np.uint64(LANE - off)
        out[:, i] = x & mask
    return out.reshape(-1, BLOCK)


def encode(values: np.ndarray, share: float = 0.95) -> bytes:
    """Values from 0 to 2**32 - 1, in order; ``share`` is the percentile that
    chooses a block's width."""
    n = len(values)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint32)
    v[:n] = values
    if n:
        v[n:] = v[n - 1]
    v = v.reshape(blocks, BLOCK)
    least = v.min(axis=1, initial=2**32 - 1)
    v = v - least[:, None]
    # bits of the value below which ``share`` of the block lies
    kth = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    at = np.partition(v, kth, axis=1)[:, kth] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.uint8)
    high = v >> np.minimum(width, 31)[:, None] >> (width == 32)[:, None].astype(np.uint8)
    outlier = high > 0
    many = outlier.sum(axis=1)
    low = np.where(outlier, v & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None], v)
    body = 6 + 32 * width.astype(np.int64) + 5 * many
    starts = np.concatenate([[0], np.cumsum(body)]).astype(np.int64)
    out = np.zeros(starts[-1], np.uint8)
    head = np.empty((blocks, 6), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4], head[:, 5] = width, many
    out[starts[:-1, None] + np.arange(6)] = head
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            packed = _pack(low[own], int(w)).astype("<u8").view(np.uint8).reshape(len(own), -1)
            out[starts[own, None] + 6 + np.arange(packed.shape[1])] = packed
    b, p = np.nonzero(outlier)
    if len(b):
        nth = np.arange(len(b)) - np.concatenate([[0], np.cumsum(many)])[b]
        at = starts[b] + 6 + 32 * width[b].astype(np.int64)
        out[at + nth] = p
        out[(at + many[b] + 4 * nth)[:, None] + np.arange(4)] = high[b, p].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = np.array([n, blocks, len(out)], "<u4").tobytes()
    return MAGIC + head + starts[:-1].astype("<u4").tobytes() + out.tobytes()


def size_of(data: bytes | memoryview, at: int = 0) -> int:
    """Bytes of the segment that starts at ``at``."""
    n, blocks, body = np.frombuffer(data, "<u4", 3, at + 4)
    return 16 + 4 * int(blocks) + int(body)


def decode(data: bytes | memoryview, at: int = 0, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the segment at ``at``; of blocks ``first`` to ``last`` only, if given."""
    if bytes(data[at : at + 4]) != MAGIC:
        raise ValueError("not a segment")
    n, blocks, body = (int(x) for x in np.frombuffer(data, "<u4", 3, at + 4))
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(data, "<u4", blocks, at + 16).astype(np.int64)[first:last]
    raw = np.frombuffer(data, np.uint8, body, at + 16 + 4 * blocks)
    if not len(starts):
        return np.zeros(0, np.uint32)
    least = raw[starts[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, many = raw[starts + 4], raw[starts + 5].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            words = raw[starts[own, None] + 6 + np.arange(32 * int(w))].copy().view("<u8")
            out[own] = _unpack(words, int(w))
    b = np.repeat(np.arange(len(starts)), many)
    if len(b):
        nth = np.arange(len(b)) - np.concatenate([[0], np.cumsum(many)])[b]
        at_ = starts[b] + 6 + 32 * width[b].astype(np.int64)
        high = raw[(at_ + many[b] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
        out[b, raw[at_ + nth]] |= high.astype(np.uint64) << width[b].astype(np.uint64)
    out += least[:, None]
    return out.ravel()[: (n if last == blocks else last * BLOCK) - first * BLOCK].astype(np.uint32)
