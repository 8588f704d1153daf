"""Top-k, exact repeats, near duplicates, components and the pipeline against brute force."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import regex

import corpus_pipeline
from verdigris.llm import exact_repeats, neardup, suffix, topk
from verdigris.llm.common import cut
from verdigris.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def brute_top(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(1024 * float(np.float32(x)))) for x in v]
    out = set()
    for i, q in good.items():
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in good.items() if j != i)[:k]
            out |= {(i, n + 1, j, -x) for n, (x, j) in enumerate(s)}
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(0)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125]) for _ in range(3)]) for i in range(150)] + [(i, [0.5, 0.5, 0.5]) for i in range(200, 260)]
    rows += [(300, None), (310, [None, 1.0, 1.0]), (320, [float("nan"), 1.0, 0.0]), (330, [float("inf"), 1.0, 0.0]), (None, [1.0, 1.0, 1.0]), (340, [1e7, -3.0, 0.1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    assert set(map(tuple, topk.search(df, 10).collect())) == brute_top(rows, 10, 10)


def test_topk_edges(spark):
    df = spark.createDataFrame([(0, [0.5]), (0, [0.25]), (1, [1.0]), (1, [2.0]), (100, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df).collect())) == [(0, 1, 1, 256 * 2048), (0, 2, 1, 256 * 1024), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 0, 0), (100, 3, 1, 0), (100, 4, 1, 0)]
    assert topk.search(df.limit(0)).collect() == [] and topk.search(df.where("vec_id = 1")).collect() == []
    for big in ([(0, [1e19]), (1, [0.0])], [(0, [1e8]), (1, [1e8])]):
        with pytest.raises(Exception, match="does not fit 64 bits"):
            topk.search(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n, letters in ((1, 2), (40, 1), (50, 2), (700, 3), (600, 200)):
        t = rng.integers(0, letters, n).astype(np.uint8)
        t = np.concatenate([t, t[: n // 2], t])
        b = t.tobytes()
        order = suffix.suffix_array(t, 10**6)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        reach = suffix.common_prefixes(order, suffix.Hashes(t, 256), 400)
        for j, x in enumerate(reach):
            p, q = b[order[j] :], b[order[j + 1] :]
            own = next((i for i, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
            assert min(x, 400) == min(own, 400)


def brute_repeats(rows, length=400):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[p : p + length] for _, b in raws for p in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(n))
    p, q = some(150), some(200)
    rows = [(1, None), (2, ""), (3, "short"), (None, p), (None, p), (4, some(90) + p + some(80)), (5, p[:450] + "é" * 300 + p), (6, "a" * 1500), (7, "ab" * 700), (8, q + q), (9, some(10) + q[50:]), (10, q[:600]), (11, "short"), (11, "short"), (12, "x" + "a" * 500 + "y"), (13, some(400))]
    return rows + [(100 + i, some(30) + p[i % 50 :] + some(30)) for i in range(25)]


@pytest.mark.parametrize("most,piece,stretch", [(1000, 1 << 20, 1 << 20), (3, 5000, 1 << 20), (1000, 1000, 3000)])
def test_repeats(spark, monkeypatch, most, piece, stretch):
    for name, value in (("MOST", most), ("PIECE", piece), ("STRETCH", stretch)):
        monkeypatch.setattr(exact_repeats, name, value)
    rows = repeat_rows()
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int")
    assert sorted(map(tuple, exact_repeats.remove_repeats(df).collect()), key=str) == brute_repeats(rows)
    if most == 1000 and piece > 1000:
        for r in exact_repeats.remove_repeats(df, keep_text=True).collect():
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert exact_repeats.remove_repeats(df.limit(0)).count() == 0


def words_of(text):
    return [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]


def edits(a, b):
    """Least number of edits, cell by cell."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute_links(texts):
    """Pairs of an edit similarity of 0.8 or more, among all that length and common words allow."""
    counts = [collections.Counter(t) for t in texts]
    out = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = texts[i], texts[j]
        most = max(len(a), len(b))
        if 5 * min(len(a), len(b)) >= 4 * most and 5 * (counts[i] & counts[j]).total() >= 4 * most:
            start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            end = next((k for k, (x, y) in enumerate(zip(a[start:][::-1], b[start:][::-1])) if x != y), min(len(a), len(b)) - start)
            if 5 * edits(a[start : len(a) - end], b[start : len(b) - end]) <= most:
                out.append((i, j))
    return out


def brute_classes(rows):
    """Least id of each class, by all pairs."""
    by = {}
    for d, t in rows:
        by.setdefault(tuple(words_of(t)) or ("", t or d), []).append(d)
    texts = list(by)
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in brute_links(texts):
        up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, t in enumerate(texts):
        least[top(i)] = min([*by[t], *[least.get(top(i), by[t][0])]])
    return {d: least[top(i)] for i, t in enumerate(texts) for d in by[t]}


def test_near_duplicates_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in QUERY(spark, FOLDER).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) < len(got)


def test_recall_of_near_pairs(spark):
    """Of all pairs of an edit similarity of 0.8 or more, 0.9 or more are in one class; others are not."""
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in QUERY(spark, folder).collect()}
    want = brute_classes(rows)
    near = [(d, c) for d, c in want.items() if d != c]
    assert len(near) > 50 and sum(got[d] == got[c] for d, c in near) >= 0.98 * len(near)
    assert all(want[d] == want[c] for d, c in got.items())


QUERY = neardup.op9_near_duplicates


def planted():
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    base, shared = some(200), some(60)
    rows = []
    for i in range(40):
        w = base[:]
        for _ in range(2):
            w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(some(40) + shared + some(40))) for i in range(30)]
    moved = base[100:] + base[:100]  # the same words in another order
    rows += [(200, " ".join(moved)), (201, "one two"), (202, "One, two!"), (203, "one two three"), (204, None), (205, ""), (206, "!!")]
    return rows + [(207, " ".join(["line of words here again"] * 30)), (208, " ".join(["line of words here again"] * 29)), (300, " ".join(some(3000)))]


def test_planted_groups(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(df).collect()}
    want = brute_classes(rows)
    assert {d: c for d, (c, _) in got.items()} == want
    assert all(got[i] == (0, 40) for i in range(40)) and got[200][0] == 200 and got[202][0] == 201
    assert all(got[d][0] == d for d in (204, 205, 206))


def second_generation():
    """A text, 100 copies of it with one change, and copies of such copies that
    are alike their parent and not the text."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 101):
        w = base[:]
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            for p in rng.sample(range(5, 195), 4):
                w[p] = f"m{i}x{p}"
            rows.append((1000 + i, " ".join(w)))
    return rows


def test_copies_of_copies_in_a_large_group(spark):
    rows = second_generation()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == brute_classes(rows)


def test_one_of_each_group_stays(spark):
    rows = planted()
    df = spark.createDataFrame([(*r, "x") for r in [*rows, (201, "one two"), (201, "one two"), (None, "one two"), (None, None)]], "doc_id long, text string, k1 string")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns
    want = {*brute_classes(rows).values()}
    left = [r.doc_id for r in out.collect()]
    assert sorted(x for x in left if x is not None) == sorted(want) and left.count(None) == 1
    assert neardup.deduplicate(df.limit(0)).count() == 0 and neardup.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Texts that share a passage and are unlike, among near copies: any cut into blocks gives the same."""
    rng = random.Random(8)
    some = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared = some(90)
    rows = [(i, " ".join(some(60) + shared)) for i in range(60)]
    for i in range(60, 90):
        w = rows[rng.randrange(60)][1].split()
        for p in rng.sample(range(150), 12):
            w[p] = f"n{i}x{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert len(set(want.values())) == 60
    for block in (2048, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in neardup.near_duplicates(df).collect()} == want


def test_equal_texts_without_words(spark):
    rows = [(1, "!!"), (2, "!!"), (3, "--"), (4, ""), (5, ""), (6, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(df).collect()}
    assert got == {1: (1, 2), 2: (1, 2)} | {d: (d, 1) for d in (3, 4, 5, 6, 7)}
    assert sorted(r.doc_id for r in neardup.deduplicate(df).collect()) == [1, 3, 4, 5, 6, 7]


def test_extra_columns_keep_their_values(spark):
    rows = [(*r, f"a{i}", i, {"m": i}) for i, r in enumerate([*planted(), (201, "one two"), (None, None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, row int, doc map<string, int>")
    left = neardup.deduplicate(df)
    assert left.columns == df.columns
    all_ = {tuple(map(str, r)) for r in rows}
    assert {tuple(map(str, r)) for r in left.collect()} <= all_
    assert sorted(map(str, left.collect())) == sorted(map(str, neardup.deduplicate(df.repartition(7)).collect()))


def test_edits():
    rng = random.Random(2)
    for i in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(12))]
        b = [rng.randrange(4) for _ in range(rng.randrange(12))]
        d = edits(a, b)
        for most in range(14):
            assert neardup.edits_within(np.array(a, int), np.array(b, int), most) == min(d, most + 1)
    a = np.array([rng.randrange(40) if i % 3 else 7 for i in range(5000)])
    b = np.delete(a, [5, 900, 4000])
    b[[100, 2000]] = 99
    assert neardup.edits_within(a, b, 1000) == 5 and neardup.edits_within(b, a, 4) == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_pipeline(spark):
    """Each stage's rows against brute force or its own operator's report."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        new = cut(stage(spark, docs, FOLDER), "stage")
        seen[name] = ([(r.doc_id, r.text) for r in docs.collect()], new)
        if name != "token ids":
            assert new.columns == docs.columns
        docs = new
    before, after = seen["near-duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == sorted({*brute_classes(before).values()})
    before, after = seen["token ids"]
    assert after.count() == len(before)
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, after.collect()))


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, very long and repeated texts, clashing columns, an empty table."""
    folder = str(tmp_path)
    some = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    long = " ".join(f"w{i % 5003}x{i // 5003}" for i in range(120_000))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (9000, long, None, "s", 1), (9001, "twice the same", "en", "s", 3), (9001, "twice the same", "en", "s", 3), (some[0][0], None, "en", None, None)]
    extra = "row string, doc int, k1 double, _skey string, predicted int, words string"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    own = ("r", 5, 1.5, "k", 1, "w")
    docs = spark.createDataFrame([(*r, *own) for r in some + odd], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, kept, folder), "stage")
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {own}
        assert stage(spark, docs.limit(0), folder).collect() == []
        kept = out
    ids = [r.doc_id for r in kept.collect()]
    assert 9000 in ids and ids.count(None) == 2 and ids.count(9001) <= 3
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, ids))
    docs.limit(0).write.mode("overwrite").parquet(f"{folder}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").write.parquet(f"{folder}/empty/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/empty").collect() == []
