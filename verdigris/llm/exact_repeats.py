"""Removal of repeated byte strings across all documents, by suffix arrays.

Every LENGTH-byte string of a text has one anchor: the stretch of ANCHOR bytes in
it with the least hash, the last of equals. Equal strings have equal anchors at
equal places, so strings that repeat share an anchor value; values that occur
once are dropped by a count. A run of strings with one anchor is a context. Of
equal contexts one stands for all; different contexts of one anchor value meet in
one piece of text, whose suffix array and adjacent common prefixes tell which of
their strings repeat. Values with more than MOST contexts are not gathered: their
strings are counted by 128-bit hashes, in pieces of GRIDS neighbouring starts. A
piece repeats as a whole if the stretch it spans does, and not at all if what its
strings have in common does not; other pieces are divided.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table, text_key
from .suffix import Hashes, common_prefixes, suffix_array

LENGTH, ANCHOR = 400, 64
#: Most contexts of one anchor value in a suffix array; bytes of contexts sorted at once, about.
MOST, PIECE = 1000, 1 << 20
#: Starts in a piece, level by level.
GRIDS = (64, 16, 4, 1)
#: Bytes in which anchors are searched at once; positions take 20 bits beside the hash.
STRETCH = 1 << 20

_U = np.uint64
_POS = _U((1 << 20) - 1)


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    p = np.full(rows * width, 2**64 - 1, np.uint64)
    p[: len(x)] = x
    p = p.reshape(rows, width)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    back = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For some documents, of which document i ends at ends[i] in ``text``, all
    shorter together than STRETCH: (document, first start, last start, anchor value,
    context value, anchor's place after the first start) of each context; starts are counted from the document's own."""
    begins = np.concatenate([[0], ends[:-1]])
    hashes = Hashes(text, 256)
    h = hashes.window(ANCHOR)
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    place = np.arange(len(h), dtype=np.uint64)
    # rightmost of equals: a later place makes a smaller value
    least = _least_in_windows((h & ~_POS) | (_POS - place), LENGTH - ANCHOR + 1)
    anchor = (_POS - (least & _POS)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), ends - begins)[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= ends[doc]
    start = np.flatnonzero(inside)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    a, d = anchor[start], doc[start]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    first = start[new]
    last = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
    own = hashes.window(LENGTH)
    c = (own[first] * _U(3) ^ (own[last] >> _U(7))) * _U(0xC2B2AE3D27D4EB4F) + own[last] + (last - first).astype(np.uint64)
    return doc[first], first - begins[doc[first]], last - begins[doc[first]], h[a[new]].view(np.int64), c.view(np.int64), a[new] - first


def _stretches(raws: list[bytes]):
    """Numbers of texts, offsets and bytes: texts together up to STRETCH, longer
    ones in stretches that overlap so that each string lies whole in one."""
    held, size = [], 0
    for i, raw in enumerate(raws):
        for at in range(0, max(len(raw) - LENGTH + 1, 0), STRETCH - LENGTH):
            part = raw[at : at + STRETCH - 1]
            if held and size + len(part) >= STRETCH:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _repeated_runs(parts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each context, runs (first, last) of starts whose string repeats among them."""
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no byte of UTF-8
    hashes = Hashes(text, 256)
    order = suffix_array(text, LENGTH, hashes)
    reach = common_prefixes(order, hashes, LENGTH) >= LENGTH
    mark = np.zeros(len(text), bool)
    mark[order[:-1][reach]] = True
    mark[order[1:][reach]] = True
    out, at = [], 0
    for p in parts:
        n = len(p) - LENGTH + 1  # a string may not reach past its context
        m = np.concatenate([[False], mark[at : at + n], [False]])
        flips = np.flatnonzero(m[1:] != m[:-1])
        out.append(list(zip(flips[::2].tolist(), (flips[1::2] - 1).tolist())))
        at += len(p) + 1
    return out


def _marks(rows: DataFrame) -> DataFrame:
    """Runs (did, k1, k2, s, e) of repeated starts, from contexts (a, did, k1, k2, lo, body) dealt by a and sorted."""

    def solve(held):
        out = []
        for (did, k1, k2, lo), runs in zip([h[0] for h in held], _repeated_runs([h[1] for h in held])):
            out += [(did, k1, k2, lo + s, lo + e) for s, e in runs]
        cols = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip(("did", "k1", "k2", "s", "e"), cols)})

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for a, did, k1, k2, lo, body in zip(*[b.column(n).to_pylist() for n in ("a", "did", "k1", "k2", "lo", "body")]):
                if size >= PIECE and a != last:  # a value's contexts stay together
                    yield solve(held)
                    held, size = [], 0
                held.append(((did, k1, k2, lo), body))
                size += len(body)
                last = a
        if held:
            yield solve(held)

    return rows.mapInArrow(run, "did long, k1 long, k2 long, s long, e long")


#: A context by its place.
PLACE = ["did", "k1", "k2", "lo"]


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """Pieces of ``size`` starts of contexts (a, PLACE, off, body, wanted): s and e,
    the starts that the context has of it, its hashes c1, c2 of what its strings
    have in common and u1, u2 of the stretch that they span. ``wanted`` holds ranges
    of starts, counted from the context's first. Pieces are counted from the anchor,
    so that equal strings of two contexts lie in the same piece."""

    def run(batches):
        names = ["a", *PLACE, "off", "body", "wanted"]
        for b in batches:
            out = []
            for a, did, k1, k2, lo, off, body, wanted in zip(*[b.column(n).to_pylist() for n in names]):
                text = np.frombuffer(body, np.uint8)
                shift = LENGTH - ANCHOR - off  # of a start, to its place on the anchor's grid
                strings, common = [], []
                for seed in (0, 1):
                    h = Hashes(text, 256, seed)
                    strings.append(h.window(LENGTH).astype(np.uint64))
                    common.append(h.window(LENGTH - size + 1))
                last = len(strings[0]) - 1
                for first, end in [(0, last)] if wanted is None else [(w["s"], w["e"]) for w in wanted]:
                    for piece in range((first + shift) // size, (end + shift) // size + 1):
                        begin = piece * size - shift
                        s, e = max(begin, first), min(begin + size - 1, end)
                        # the strings of the whole piece share the bytes from its last start on
                        c = [int(x[begin + size - 1]) for x in common] if begin + size - 1 < len(common[0]) else [0, 0]
                        u = [(int(x[s]) * 3 + (int(x[e]) >> 7) + (e - s)) & (1 << 64) - 1 for x in strings]
                        out.append((did, k1, k2, lo, s, e, *[_signed(x ^ _grid(a, piece)) for x in c], *[_signed(x ^ _grid(a, piece * 1000 + s - begin)) for x in u]))
            cols = list(zip(*out)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=[*PLACE, "s", "e", "c1", "c2", "u1", "u2"])

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in [*PLACE, "s", "e", "c1", "c2", "u1", "u2"]))


def _grid(a: int, piece: int) -> int:
    return ((a & (1 << 64) - 1) ^ (piece + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _marks_of_hot(rows: DataFrame) -> DataFrame:
    """Runs of repeated starts of contexts whose anchor value has many others."""
    rows = rows.select("a", *PLACE, "off", "body")
    todo, found = rows.withColumn("wanted", F.lit(None).cast("array<struct<s:long,e:long>>")), None
    for size in GRIDS:
        pieces = cut(_pieces(todo, size), "pieces")
        twice = lambda *h: cut(pieces.groupBy(*h).agg(F.count("*").alias("n")).where("n > 1").select(*h), "twice")  # noqa: B023, E731
        judged = pieces.join(twice("u1", "u2").withColumn("all", F.lit(True)), ["u1", "u2"], "left")
        if size > 1:
            judged = judged.join(twice("c1", "c2").withColumn("some", F.lit(True)), ["c1", "c2"], "left")
        judged = cut(judged, "judged")
        new = judged.where("all").select("did", "k1", "k2", (F.col("lo") + F.col("s")).alias("s"), (F.col("lo") + F.col("e")).alias("e"))
        found = new if found is None else found.unionByName(new)
        if size > 1:
            # of pieces that repeat as a whole one stays, for those that share only a part with it
            one = judged.where("all").groupBy("u1", "u2").agg(F.min(F.struct(*PLACE, "s", "e")).alias("p")).select("p.*")
            rest = judged.where("all is null and some").select(*PLACE, "s", "e").unionByName(one).groupBy(*PLACE).agg(F.collect_list(F.struct("s", "e")).alias("wanted"))
            todo = cut(rows.join(rest, PLACE), "divided")
    return found


def repeated_starts(docs: DataFrame) -> DataFrame:
    """Runs (did, k1, k2, s, e) of starts whose string also starts elsewhere, for
    distinct texts; texts that occur twice as a whole are left to the caller.
    ``docs`` has did, k1, k2 and raw."""

    def find(batches):
        for b in batches:
            raws = b.column("raw").to_pylist()
            keys = [b.column(n).to_numpy() for n in ("did", "k1", "k2")]
            for held in _stretches(raws):
                which = np.array([i for i, _, _ in held])
                offset = np.array([at for _, at, _ in held])
                d, lo, hi, a, c, off = contexts(np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.cumsum([len(p) for _, _, p in held]))
                i = which[d]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), *[pa.array(k[i]) for k in keys], pa.array(lo + offset[d]), pa.array(hi + offset[d]), pa.array(off)], names=["a", "c", "did", "k1", "k2", "lo", "hi", "off"])

    long = docs.where(F.octet_length("raw") >= LENGTH)
    found = cut(long.mapInArrow(find, "a long, c long, did long, k1 long, k2 long, lo long, hi long, off long"), "anchors")
    # places: of whole copies of a text only the row of the least id counts
    place = F.struct("did", "k1", "k2", "lo", "hi", "off")
    same = found.groupBy("a", "c", "k1", "k2", "lo").agg(F.min("did").alias("did"), F.first("hi").alias("hi"), F.first("off").alias("off"))
    kinds = same.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    kinds = cut(kinds, "contexts")
    values = kinds.groupBy("a").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("n > 1")
    values = cut(values, "values")
    # contexts that occur twice: every string of theirs repeats, at every place
    twice = kinds.where("n > 1").select("a", "c")
    whole = found.join(twice, ["a", "c"]).select("did", "k1", "k2", F.col("lo").alias("s"), F.col("hi").alias("e"))
    # one place of each context whose anchor value has others, with its bytes
    wanted = kinds.join(values.where("kinds > 1").select("a", "kinds"), "a").select("a", "kinds", "at.*")
    per_text = wanted.groupBy("did", "k1", "k2").agg(F.collect_list(F.struct("a", "kinds", "lo", "hi", "off")).alias("w"))

    def bodies(batches):
        for b in batches:
            out = []
            for did, k1, k2, raw, w in zip(*[b.column(n).to_pylist() for n in ("did", "k1", "k2", "raw", "w")]):
                out += [(x["a"], x["kinds"], did, k1, k2, x["lo"], x["off"], raw[x["lo"] : x["hi"] + LENGTH]) for x in w]
            cols = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 7 + [pa.binary()])], names=["a", "kinds", "did", "k1", "k2", "lo", "off", "body"])

    texts = long.select("did", "k1", "k2", "raw").join(cut(per_text, "wanted"), ["did", "k1", "k2"])
    taken = cut(texts.mapInArrow(bodies, "a long, kinds long, did long, k1 long, k2 long, lo long, off long, body binary"), "bodies")
    few = taken.where(F.col("kinds") <= MOST).drop("kinds", "off")
    marks = whole.unionByName(_marks(few.repartition("a").sortWithinPartitions("a")))
    many = taken.where(F.col("kinds") > MOST)
    return marks if many.isEmpty() else marks.unionByName(_marks_of_hot(many))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    if asked for, ``kept`` (the remaining bytes).

    Null and empty texts have no bytes; texts below LENGTH keep all; texts that
    occur twice, in repeated rows too, and reach LENGTH lose all; ids, null or
    repeated, play no part; an empty table gives no rows."""
    small_batches(docs.sparkSession, 500)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("did"), *text_key(F.col("text")), raw.alias("raw"))
    ids = rows.select("doc_id", "did", "k1", "k2", F.octet_length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha"), *([F.col("raw")] if keep_text else []))
    ids = cut(ids, "ids")
    copies = cut(ids.where(F.col("n_bytes") >= LENGTH).groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    runs = repeated_starts(rows)
    per_text = runs.groupBy("did", "k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    per_text = cut(per_text.join(copies, ["k1", "k2"], "left_anti"), "runs")

    def apply(batches):
        for b in batches:
            out = []
            for did, k1, k2, raw, runs in zip(*[b.column(n).to_pylist() for n in ("did", "k1", "k2", "raw", "runs")]):
                kept, end, removed, spans = [], 0, 0, 0
                for s, e in sorted((r["s"], r["e"]) for r in runs):
                    if s > end or not spans:
                        kept.append(raw[end:s])
                        spans, removed, end = spans + 1, removed + e + LENGTH - s, e + LENGTH
                    elif e + LENGTH > end:
                        removed, end = removed + e + LENGTH - end, e + LENGTH
                kept.append(raw[end:])
                left = b"".join(kept)
                out.append((did, k1, k2, removed, spans, hashlib.sha256(left).hexdigest(), left if keep_text else b""))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=["did", "k1", "k2", "removed", "spans", "left_sha", "left"])

    changed = rows.select("did", "k1", "k2", "raw").join(per_text, ["did", "k1", "k2"]).mapInArrow(apply, "did long, k1 long, k2 long, removed long, spans long, left_sha string, left binary")
    changed = cut(changed, "changed")
    out = ids.join(changed, ["did", "k1", "k2"], "left").join(copies, ["k1", "k2"], "left")
    all_ = F.col("copies").isNotNull()
    columns = [
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(all_, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(all_, F.lit("").cast("binary")).otherwise(F.coalesce("left", "raw")).alias("kept"))
    return out.select(*columns)


def op6_exact_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: All strings of LENGTH bytes, counted by 64-bit hashes.
OP6_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, unnest(list_transform(range(octet_length(b) - 399), lambda i: hash(b[i + 1:i + 400]))) AS h, unnest(range(octet_length(b) - 399)) AS p FROM d WHERE octet_length(b) >= 400),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM w JOIN t USING (h)),
g AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM s),
x AS (SELECT r, span, min(p) AS a, max(p) + 400 AS z FROM g GROUP BY r, span),
k AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM x GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda i: hex(b[coalesce(z[i - 1], 0) + 1:coalesce(a[i], octet_length(b))])), '')) END) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""
