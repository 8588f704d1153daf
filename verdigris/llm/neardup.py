"""Near-duplicate documents by Order MinHash.

A text is its sequence of words. Each of its shingles of SHINGLE words carries
the number of its occurrence; of each of SKETCHES hash functions the DRAWN least
labelled shingles, in text order, make one key, so that texts with the same
shingles in another order get other keys. Texts that share a key are
candidates. Those with equal words are one text from the start.

A candidate pair is linked if an alignment within a band finds an edit similarity
of LIKE or more: insertions, deletions and substitutions of words turn one into
the other, one fifth of the longer text's words at most. Classes are the
connected components of the links.

Every text of a bucket (the texts of one key) is compared with its leader, the
text whose keys are the most frequent. That joins most texts of a large group in
one class, but rules no pair out: in buckets that still hold several classes all
pairs of different classes are compared, in memory and block against block, so
that no task holds more than two blocks and no pair becomes a row. A pair is
looked at in the first bucket that it shares, and aligned only if the words in
common, counted without their order, allow the similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_hash, small_batches, spent, table, whole_row, words_of
from .components import components

#: Texts whose labelled shingles have a Jaccard similarity s share a key with probability s ** DRAWN, so all
#: SKETCHES miss 1 of 1000 pairs at 0.4 (one word in twelve changed) and 4 of 100 at 0.28.
SHINGLE, SKETCHES, DRAWN = 5, 40, 2
#: Similarity, as a fraction.
LIKE = (4, 5)
#: Most texts and, about, most words of a block.
BLOCK, BLOCK_WORDS = 2048, 1 << 21
#: Words sketched at once; a longer text is sketched alone.
CHUNK = 1 << 19
#: Bits of a position beside a hash.
PLACE = 24
#: Counters of a text's words by hash, for bounds on common words.
COUNTERS = 1024
#: Salts over which the rows of one class are dealt.
SALTS = 16

_U = np.uint64
_MULT = np.random.default_rng(20).integers(1, 2**63, SHINGLE + 2 * SKETCHES + 2, dtype=np.uint64) * _U(2) + _U(1)
_PLACES, _TOP = _U((1 << PLACE) - 1), _U(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x *= _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hash of the SHINGLE words from each position on."""
    n = max(len(words) - SHINGLE + 1, 0)
    w = words.astype(np.uint64) + _U(1)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h += w[j : j + n] * _MULT[j]
        h ^= h >> _U(32)
        h *= _MULT[SHINGLE]
    return h


def _least(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(DRAWN, texts): the least values of each text, their last PLACE bits cleared, and their positions."""
    if len(v) >= 1 << PLACE:  # one very long text
        v = v & ~_PLACES
        at = np.argpartition(v, min(DRAWN, len(v) - 1))[:DRAWN]
        at = at[np.lexsort((at, v[at]))]
        return v[at, None], at[:, None]
    v = (v & ~_PLACES) | np.arange(len(v), dtype=np.uint64)
    out = []
    for _ in range(DRAWN):
        m = np.minimum.reduceat(v, first)
        v[(m[m != _TOP] & _PLACES).astype(np.int64)] = _TOP
        out.append(m)
    out = np.stack(out)
    return out & ~_PLACES, (out & _PLACES).astype(np.int64)


def sketches(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(texts, SKETCHES) keys of texts, of which text i ends at ends[i] in
    ``words``; each has SHINGLE words or more."""
    starts = np.concatenate([[0], ends[:-1]])
    h = shingles(words)
    count = ends - starts - SHINGLE + 1
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    text = np.repeat(np.arange(len(ends)), count)
    h = h[np.arange(len(text)) - first[text] + starts[text]]
    # the number of the occurrence: equal shingles of a text meet in a stable sort
    own = _mix(h + text.astype(np.uint64) * _MULT[SHINGLE + 1])
    order = np.argsort(own, kind="stable")
    runs = own[order]
    new = np.concatenate([[True], runs[1:] != runs[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    nth = np.empty(len(runs), np.uint64)
    nth[order] = np.arange(len(runs)) - begin
    h = _mix(h + nth * _MULT[0])
    out = np.empty((len(ends), SKETCHES), np.uint64)
    for j in range(SKETCHES):
        least, at = _least(_mix((h ^ _MULT[SHINGLE + j]) * _MULT[SHINGLE + SKETCHES + j]), first)
        key = np.full(len(ends), _U(j))
        for m in np.take_along_axis(least, np.argsort(at, axis=0, kind="stable"), 0):
            key = _mix(key * _MULT[1] + m)
        out[:, j] = key
    return out


def sketched(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Written table: the columns ``keep``, row (a number), k1 and k2 (128 bits that
    stand for the words, or for the text if it has none; null for null and empty
    texts), n (words), keys and words (four bytes each)."""
    small_batches(docs.sparkSession, 500)
    text = F.col("text")
    w = docs.select(*keep, F.monotonically_increasing_id().alias("row"), text, F.transform(words_of(text), lambda x: F.xxhash64(x)).alias("w"))
    key = lambda seed: F.when(F.size("w") > 0, F.xxhash64(F.lit(seed), "w")).when(text != "", F.xxhash64(F.lit(seed + 1), "text"))
    names = w.columns[: len(keep)]
    w = w.select(*names, "row", key(0).alias("k1"), key(7).alias("k2"), "w")

    def run(batches):
        for b in batches:
            lists = b.column("w")
            flat = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy().astype(np.int64)) if b.num_rows else np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            small = (flat >> _U(32)).astype("<u4")
            keys: list = [None] * len(ends)
            long = np.flatnonzero(ends - starts >= SHINGLE)
            at = 0
            while at < len(long):
                to, size = at + 1, ends[long[at]] - starts[long[at]]
                while to < len(long) and size + ends[long[to]] - starts[long[to]] <= CHUNK:
                    size += ends[long[to]] - starts[long[to]]
                    to += 1
                part = long[at:to]
                pieces = [flat[starts[i] : ends[i]] for i in part]
                own = sketches(np.concatenate(pieces), np.cumsum([len(x) for x in pieces])).view(np.int64)
                for i, k in zip(part, own):
                    keys[i] = k
                at = to
            words = [small[s:e].tobytes() for s, e in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ends - starts), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=[*b.schema.names[:-1], "n", "keys", "words"])

    schema = T.StructType([*w.drop("w").schema.fields, T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())])
    return cut(w.mapInArrow(run, schema), "sketches")


class Text:
    """Words of a text, and how often each occurs."""

    def __init__(self, raw: bytes):
        self.words = np.frombuffer(raw, "<u4")
        self.kinds = None

    def __len__(self):
        return len(self.words)

    def common(self, other: Text) -> int:
        """Words in common, without regard to order."""
        for t in (self, other):
            if t.kinds is None:
                t.kinds = np.unique(t.words, return_counts=True)
        (a, m), (b, n) = self.kinds, other.kinds
        if not len(b):
            return 0
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        same = b[at] == a
        return int(np.minimum(m[same], n[at[same]]).sum())


class Places:
    """Bits of the places at which a word stands, from a window on. Frequent
    words have one number of as many bits as the text has words, others a list."""

    def __init__(self, words: list[int]):
        at: dict[int, list[int]] = {}
        for i, x in enumerate(words):
            at.setdefault(x, []).append(i)
        many = max(64, len(words) >> 11) if len(words) > 4096 else 0
        self.lists, self.bits = {}, {}
        for x, own in at.items():
            if len(own) <= many:
                self.lists[x] = own
            else:
                raw = np.zeros(len(words) // 8 + 1, np.uint8)
                np.bitwise_or.at(raw, np.array(own) >> 3, (1 << (np.array(own) & 7)).astype(np.uint8))
                self.bits[x] = int.from_bytes(raw.tobytes(), "little")

    def window(self, x: int, start: int, full: int) -> int:
        p = self.bits.get(x)
        if p is not None:
            return (p >> start if start >= 0 else p << -start) & full
        p = 0
        for i in self.lists.get(x, ()):
            if i >= start:
                p |= 1 << (i - start)
        return p & full


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Least number of insertions, deletions and substitutions that turn a into
    b, ``most`` + 1 if they are more.

    The band of 2 * most + 1 diagonals goes down with the words of the shorter
    text; its column is two bit vectors, of places where the count of edits rises
    and where it falls from one row to the next. The count itself is followed on
    the diagonal that ends in the last cell."""
    if len(a) < len(b):
        a, b = b, a
    edits = len(a) - len(b)
    if edits > most:
        return most + 1
    places, full, goal = Places(a.tolist()), (1 << 2 * most + 1) - 1, most + edits
    rise, fall = full & ~((1 << most) - 1), 0
    for j, x in enumerate(b.tolist()):
        same = places.window(x, j - most, full)
        # no edit on the diagonal that leads to a cell
        free = ((((same & rise) + rise) ^ rise) | same | fall) & full
        right_up, right_down = fall | (full & ~(free | rise)), free & rise
        if not free >> goal & 1:
            edits += 1
        free >>= 1
        rise, fall = right_down | (full & ~(free | right_up)), free & right_up
    return min(edits, most + 1)


def reaches(least: int, most: int, common: int) -> bool:
    """Whether so many words in common, of texts of such lengths, allow LIKE."""
    return min(least, common) * LIKE[1] >= most * LIKE[0]


def alike(x: Text, y: Text) -> bool:
    least, most = sorted((len(x), len(y)))
    if not reaches(least, most, least) or not reaches(least, most, x.common(y)):
        return False
    limit = most * (LIKE[1] - LIKE[0]) // LIKE[1]
    return edits_within(x.words, y.words, limit) <= limit


def _near(n: str, m: str) -> Column:
    return F.least(n, m) * LIKE[1] >= F.greatest(n, m) * LIKE[0]


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Of pairs (u, v), those that are alike."""
    own = lambda name, to: words.select(F.col("row").alias(name), F.col("words").alias(to)).hint("merge")
    full = pairs.join(own("u", "a"), "u").join(own("v", "b"), "v")

    def run(batches):
        for b in batches:
            keep = [alike(Text(x), Text(y)) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())]
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return full.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _cells(open_: DataFrame) -> DataFrame:
    """Memberships (key, row, label, n) of buckets with several classes, dealt to
    cells (key, kind, i, j). The largest class of a bucket is parted into blocks,
    and so is all else; each block of the second sort meets each of both sorts.
    ``side`` tells the two blocks of a cell apart, and is 0 throughout where a
    block meets itself."""
    by_class = open_.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    top = by_class.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("m"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda c, s: F.greatest(F.ceil(c / F.lit(BLOCK)), F.ceil(s / F.lit(BLOCK_WORDS)), F.lit(1)).cast("int")
    top = top.select("key", F.col("m.label").alias("main"), blocks(F.col("m.c"), F.col("m.s")).alias("a"), blocks(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s")).alias("b"))
    rows = open_.join(top, "key").withColumn("main", F.col("label") == F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("row"), F.when(F.col("main"), F.col("a")).otherwise(F.col("b"))).cast("int"))
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none, own = F.lit(0), F.col("own")
    others = F.transform(upto("b"), lambda j: cell(1, F.least(j, own), F.greatest(j, own), F.when(j == own, 0).when(j > own, 1).otherwise(2)))
    cells = (
        F.when((F.col("a") == 1) & (F.col("b") == 1), F.array(cell(2, none, none, none)))
        .when(F.col("main"), F.transform(upto("b"), lambda j: cell(0, own, j, F.lit(1))))
        .otherwise(F.concat(F.transform(upto("a"), lambda i: cell(0, i, own, F.lit(2))), others))
    )
    return rows.select("key", "row", "label", "n", F.explode(cells).alias("cell")).select("key", "row", "label", "n", "cell.*")


def _compared(jk: int, label, n, side, keys, raws) -> list[tuple[int, int]]:
    """Links between labels of texts that differ in label and in side, in a cell whose key is the jk-th of their keys."""
    texts = [Text(x) for x in raws]
    counts = None
    if len(texts) > 8:
        counts = np.zeros((len(texts), COUNTERS), np.uint16 if n.max() < 1 << 16 else np.uint32)
        for i, t in enumerate(texts):
            counts[i] = np.bincount(t.words % COUNTERS, minlength=COUNTERS)
    up: dict[int, int] = {}

    def top(x):
        while x in up:
            x = up[x]
        return x

    out = []
    for x in range(len(texts) - 1):
        y = np.arange(x + 1, len(texts))
        least, most = np.minimum(n[y], n[x]), np.maximum(n[y], n[x])
        y = y[(label[y] != label[x]) & ((side[y] != side[x]) | (side[x] == 0)) & (least * LIKE[1] >= most * LIKE[0])]
        if jk and len(y):  # pairs that share an earlier key meet there
            y = y[~(keys[y, :jk] == keys[x, :jk]).any(axis=1)]
        if counts is not None and len(y):
            bound = np.minimum(counts[y], counts[x]).sum(axis=1, dtype=np.int64)
            y = y[bound * LIKE[1] >= np.maximum(n[y], n[x]) * LIKE[0]]
        for i in y.tolist():
            p, q = top(int(label[x])), top(int(label[i]))
            if p != q and alike(texts[x], texts[i]):
                out.append((p, q))
                up[max(p, q)] = min(p, q)
    return out


def _links_of_cells(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of labels found in the cells; texts has row, keys and words."""
    full = cells.join(texts.select("row", "keys", "words").hint("merge"), "row")
    place = ["key", "kind", "i", "j"]
    names = ["label", "n", "side", "keys", "words"]

    def solve(held):
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows < 2:
            return []
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, SKETCHES)
        jk = int(np.flatnonzero(keys[0] == t.column("key")[0].as_py())[0])
        numbers = [t.column(c).to_numpy() for c in names[:3]]
        return _compared(jk, *numbers, keys, t.column("words").to_pylist())

    def packed(found):
        u, v = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(batches):
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in place]
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
            found = []
            for s, e in zip(new, [*new[1:], b.num_rows]):
                this = tuple(int(c[s]) for c in cols)
                if held and this != last:
                    found += solve(held)
                    held = []
                held.append(b.slice(s, e - s))
                last = this
            yield packed(found)
        if held:
            yield packed(solve(held))

    return full.select(*place, *names).repartition(*place).sortWithinPartitions(*place).mapInArrow(run, "u long, v long")


def classes(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, class) of those distinct texts (row, n, keys) of a sketched table that
    have links; class is the least row of the class.

    Joins with words are merge joins whatever the size, so that a small table is
    read as a large one is."""
    bands = texts.where("keys is not null").select("row", "n", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = cut(bands.join(shared, "key"), "members")
    weight = cut(members.groupBy("row").agg(F.sum("size").alias("weight")), "weights")
    words = cut(rows.select("row", "keys", "words").join(weight.select("row").hint("merge"), "row"), "words")
    # leaders: the text of the greatest weight
    lead = members.join(weight, "row").groupBy("key").agg(F.max(F.struct("weight", (-F.col("row")).alias("v"), "n")).alias("top"))
    lead = lead.select("key", (-F.col("top.v")).alias("v"), F.col("top.n").alias("m"))
    pairs = members.join(lead, "key").where((F.col("row") != F.col("v")) & _near("n", "m")).select(F.col("row").alias("u"), "v").distinct()
    found = cut(_verified(pairs, words), "links")
    first = components(found)
    labelled = cut(members.join(first.withColumnRenamed("node", "row"), "row", "left").select("key", "row", "n", F.coalesce("label", "row").alias("label")), "labelled")
    several = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
    open_ = cut(labelled.join(several, "key"), "open")
    more = cut(_links_of_cells(_cells(open_), words), "links")
    second = components(more)
    # texts of the first step's classes, and those that only the second one linked
    by_row = first.select(F.col("node").alias("row"), "label").join(second.select(F.col("node").alias("label"), F.col("label").alias("over")), "label", "left").select("row", F.coalesce("over", "label").alias("class"))
    alone = second.select(F.col("node").alias("row"), F.col("label").alias("class")).join(first.select(F.col("node").alias("row")), "row", "left_anti")
    out = cut(by_row.unionByName(alone), "labels")
    spent(members, weight, words, found, first, labelled, open_, more, second)
    return out


def classes_of(rows: DataFrame) -> DataFrame:
    """Of a sketched table: (k1, k2, class) for all texts that are not null or
    empty; class is the row of one text of it."""
    reps = cut(rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("row").alias("row")), "reps")
    texts = cut(rows.select("row", "n", "keys").join(reps.select("row"), "row"), "texts")
    label = classes(rows, texts)
    out = cut(reps.join(label, "row", "left").select("k1", "k2", F.coalesce("class", "row").alias("class")), "classes")
    spent(reps, texts, label)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class),
    class_size (documents in it).

    Null and empty texts are alone in their class; texts without words are alike
    only if they are equal, texts of less than SHINGLE words only if their words
    are; a null id is never a class_id unless all ids of the class are null;
    repeated rows are members like others; an empty table gives no rows."""
    rows = sketched(docs.select("doc_id", "text"), [F.col("doc_id")])
    named = classes_of(rows)
    own = cut(rows.select("doc_id", "row", "k1", "k2").join(named, ["k1", "k2"], "left").select("doc_id", "row", F.coalesce("class", "row").alias("class")), "members")
    spent(rows, named)
    sizes = own.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1")
    # a class may hold a large share of all rows: its one row is joined under several salts
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = own.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["class", "salt"], "left")
    many = F.col("class_size").isNotNull()
    return out.select("doc_id", F.when(many, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all their columns, one of each class: that of the least
    doc_id (nulls last; of one id, the least by hashes of the text and of the
    row), and all rows of null and empty texts. An empty table gives no rows."""
    rows = sketched(docs, [whole_row(docs).alias("doc"), row_hash(docs).alias("tie")])
    named = classes_of(rows)
    order = F.struct(F.col("doc.doc_id").isNull().alias("a"), F.col("doc.doc_id").alias("b"), F.xxhash64("doc.text").alias("c"), F.col("tie").alias("d"), F.col("row").alias("e"))
    own = rows.where("k1 is not null").select("k1", "k2", order.alias("o")).join(named, ["k1", "k2"])
    kept = cut(own.groupBy("class").agg(F.min("o").alias("o")).select(F.col("o.e").alias("row")), "kept")
    out = cut(rows.where("k1 is not null").select("doc", "row").join(kept.hint("merge"), "row").select("doc").unionByName(rows.where("k1 is null").select("doc")), "kept")
    spent(rows, named, kept)
    return out.select("doc.*")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
