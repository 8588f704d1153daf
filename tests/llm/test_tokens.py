"""Token files and counts against the library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import pfor, token_counts, token_files
from verdigris.llm.common import new_path
from verdigris.llm.tokens import Lookup, default_vocabulary, encoder

TEXTS = ["", "Hello, World! it's 12345", "Über-Straße İ Å ẞ ΣΣ", "don't I'll 'sx", "<|endoftext|>a<|startoftext|>", "a" * 300, "x1" * 90, "tab\tand nbsp em\x1cfs", "éé ́x", "日本語 \U0001f600\U0001f600", "...!?; \n\n --", "word,\nWORD. Word;", "é" * 100, "thestthere" * 40]


@pytest.fixture(scope="module")
def library():
    return encoder(default_vocabulary()).tokenizer


def count(t, s):
    return len(t.encode(s, add_special_tokens=False).ids)


def test_ids_equal_the_library(library):
    e = encoder(default_vocabulary())
    for x, ids in zip(TEXTS, e.encode(TEXTS)):
        assert np.frombuffer(ids, e.dtype).tolist() == library.encode(x, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcTHE.,'! \néÉßİ1|<>µ", max_size=90))
def test_any_text(text):
    e, c = encoder(default_vocabulary()), token_counts.counter(default_vocabulary())
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    table = c.tables([text])[0]
    assert token_counts.prefix_counts(table).tolist() == [count(e.tokenizer, text[:j]) for j in range(len(text) + 1)]


def test_every_prefix(library):
    c = token_counts.counter(default_vocabulary())
    for x in TEXTS:
        table = c.tables([x])[0]
        assert token_counts.prefix_counts(table).tolist() == [count(library, x[:j]) for j in range(len(x) + 1)]
        assert token_counts.total_of(table) == count(library, x)
    table = c.tables([TEXTS[1]])[0]
    k = token_counts.longest_within(table, 4)
    assert token_counts.count_at(table, k) <= 4 < token_counts.count_at(table, k + 1)


def test_lookups():
    made = []
    old = Lookup(lambda w: made.append(w) or w.upper(), {})
    assert [old[w] for w in ("a", "b", "a")] == ["A", "B", "A"] and made == ["a", "b"]
    new = Lookup(old.make, dict(old))
    assert new["a"] == "A" and new["c"] == "C" and made == ["a", "b", "c"] and set(new) == {"a", "c"}
    assert new["x" * 100] and "x" * 100 not in new


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=700), st.sampled_from([0.5, 0.9, 1.0]))
def test_blocks_round_trip(values, share):
    v = np.array(values, np.uint32)
    data = pfor.encode(v, share)
    assert pfor.size_of(data) == len(data) and (pfor.decode(data) == v).all()
    if len(v) > pfor.BLOCK:
        assert (pfor.decode(data, 0, 1, 2) == v[pfor.BLOCK : 2 * pfor.BLOCK]).all()
    with pytest.raises(ValueError):
        pfor.decode(b"nope" + data)


def expected(library, rows):
    out, at = [], 0
    for i, x in rows:
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_equal_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    random.Random(1).shuffle(rows)
    rows += [(10**6, None), (10**6 + 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for per_file in (8192, 30):
        path = new_path(spark, "t")
        token_files.write_files(df, path, shard_docs=per_file)
        assert sorted(map(tuple, token_files.read_files(spark, path).collect())) == sorted(expected(library, sorted(rows)))


def test_files_with_nulls_and_a_hot_id(spark):
    rows = [(7, f"x {i}", 0) for i in range(200)] + [(7, "same", 0)] * 200 + [(8, "q", 0)] * 5 + [(None, "n", 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    path = new_path(spark, "t")
    token_files.write_files(df, path, shard_docs=50)
    got = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [7] * 400 + [8] * 5 + [None] * 2
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert token_files.token_files(df.limit(0)).collect() == []


def test_ids_that_doubles_cannot_tell_apart(spark, monkeypatch):
    ids = [10**18 + i for i in range(400)] + [2**63 - 1 - i for i in range(50)] + [-(2**63) + i for i in range(50)]
    rows = [(i, "a " * (i % 7), "x") for i in ids]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    for records in (512, 1):
        monkeypatch.setattr(token_files, "RECORDS", records)
        monkeypatch.setattr(token_files, "RECORD_IDS", 300)
        path = new_path(spark, "t")
        token_files.write_files(df, path, shard_docs=40)
        got = sorted(token_files.read_files(spark, path).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted(ids)
        assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]


def test_counts(spark, library):
    rows = [(i, x, "c") for i, x in enumerate(TEXTS)] + [(None, None, "c"), (3, "twice", "c"), (3, "twice", "c"), (99, "w " * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts.token_counts(df).select("n_bytes", "n_tokens", "over_limit").collect())
    want = sorted((len((x or "").encode()), count(library, x or ""), count(library, x or "") > 2048) for _, x, _ in rows)
    assert [tuple(r) for r in got] == want
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_other_vocabularies(spark):
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        e = encoder(public_tokenizers.path(name))
        x = ["Hello there, wörld", ""]
        ids = [np.frombuffer(b, e.dtype).tolist() for b in e.encode(x)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate([*x, "long text " * 20_000])], "doc_id long, text string")
        for keep in (False, True):
            got = token_counts.token_counts(df.where(f"doc_id < 2 or not {keep}"), public_tokenizers.path(name), keep_table=keep).orderBy("doc_id").collect()
            assert [r.n_tokens for r in got] == [len(i) for i in e.lists([*x, "long text " * 20_000])][: len(got)]
        assert ids == [list(i) for i in e.lists(x)] and not e.by_word
