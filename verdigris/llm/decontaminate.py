"""Benchmark decontamination by spaced-seed hashing (native).

A seed is a fixed mask over token positions; it hashes the selected tokens and
ignores the others. Seeds of all benchmark items are joined with seeds of all
documents; around a hit the overlap on the same diagonal is verified token by
token. Overlap means SPAN aligned tokens of which at least NEED agree (0.8 of
them or more). Each mask set below is such that any SPAN tokens with SPAN - NEED
substitutions hold a hit.

Two rules for short items: one of LEAST to SPAN - 1 tokens must occur whole, as
common phrases meet it but for a word; one of fewer tokens ("yes", "Paris") is no
evidence and never matches.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_row, words_of

SPAN = 12
NEED = ceil(0.8 * SPAN)
#: Items of fewer tokens are no evidence.
LEAST = 5
#: Offsets of the selected tokens.
MASKS = [(0, 1, 2, 3, 4), (0, 1, 4, 5, 7)]
#: Most benchmark seeds (some 40 bytes each; items take 8 bytes a token more) that are broadcast; beyond, both sides are shuffled by hash.
BROADCAST_SEEDS = 1_000_000


def _seeds(rows: DataFrame, tokens: str, pos: str) -> DataFrame:
    """A row for each mask at each position: adds ``_pos``, ``_m`` and ``_seed``."""
    n = F.size(tokens)
    out = rows.withColumn(pos, F.explode(F.when(n >= LEAST, F.sequence(F.lit(0), n - LEAST))))
    at = lambda i: F.get(F.col(tokens), F.col(pos) + i)
    hashes = [F.xxhash64(F.lit(k), *[at(i) for i in mask]) for k, mask in enumerate(MASKS)]
    fits = [F.when(F.col(pos) + mask[-1] < n, h) for mask, h in zip(MASKS, hashes)]
    return out.withColumn("_seed", F.explode(F.array(*fits))).where("_seed is not null")


def token_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, _item): distinct items with their token hashes, those of LEAST tokens or more."""
    return benchmark.select("item_id", token_hashes(F.col("text")).alias("_item")).where(F.size("_item") >= LEAST).distinct().withColumn("_ik", F.xxhash64("item_id", "_item"))


def _best_overlap() -> Column:
    """Most agreeing tokens in any SPAN positions around the hit, on its diagonal."""
    # the hit: the seed's first token is at document position _p and item position _q.
    # Higher-order functions keep this rare, long expression out of the loop over positions.
    reach = SPAN - LEAST
    same = F.transform(F.sequence(F.lit(-reach), F.lit(SPAN - 1)), lambda j: F.coalesce((F.get("_doc", F.col("_p") + j) == F.get("_item", F.col("_q") + j)).cast("int"), F.lit(0)))
    return F.array_max(F.transform(F.sequence(F.lit(1), F.lit(reach + 1)), lambda i: F.aggregate(F.slice(same, i, SPAN), F.lit(0), lambda a, x: a + x)))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: list[str]) -> DataFrame:
    """(key..., item_id, matched): document-item pairs with a verified overlap
    and the most tokens agreeing in one window of it.

    A key of null stands like any other value; null, empty and short texts hold
    no overlap; repeated rows of the benchmark count once, those of ``docs`` share
    a key and give one row; an empty table on either side gives no rows."""
    items = items_of(benchmark)
    seeds = _seeds(items, "_item", "_q").select("_seed", "_ik", "_q")
    n = seeds.count()
    tokens = docs.select(*key, token_hashes(F.col("text")).alias("_doc"))
    have = _seeds(tokens, "_doc", "_p")
    if n <= BROADCAST_SEEDS:
        hits = have.join(F.broadcast(seeds), "_seed").join(F.broadcast(items), "_ik")
    else:  # documents' tokens are not shuffled by seed: hits first, then tokens by key
        # by key and tokens, so that rows of one key, or of none, are not all joined with each other
        marks = {"_t1": F.xxhash64("_doc"), "_t2": F.xxhash64(F.lit(7), "_doc")}
        thin = have.withColumns(marks).select(*key, "_t1", "_t2", "_p", "_seed").join(seeds.hint("shuffle_merge"), "_seed").drop("_seed").distinct()
        whole = tokens.withColumns(marks).distinct().select(*[F.col(k).alias(f"_of_{k}") for k in key], F.col("_t1").alias("_o1"), F.col("_t2").alias("_o2"), "_doc")
        same = (F.col("_t1") == F.col("_o1")) & (F.col("_t2") == F.col("_o2"))
        for k in key:
            same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        hits = thin.join(whole, same).join(items, "_ik")
    need = F.when(F.size("_item") >= SPAN, F.lit(NEED)).otherwise(F.size("_item"))
    found = hits.select(*key, "item_id", _best_overlap().alias("matched"), need.alias("_need")).where("matched >= _need")
    return found.groupBy(*key, "item_id").agg(F.max("matched").cast("long").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents, all their columns, without those that overlap a benchmark item.

    Judged by text: null and empty texts stay, and of rows of one id each goes or
    stays by its own text. With an empty benchmark all rows stay."""
    keyed = docs.select(whole_row(docs).alias("doc"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    bad = overlaps(keyed.select("k1", "k2", F.col("doc.text").alias("text")), benchmark, ["k1", "k2"]).select("k1", "k2").distinct()
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("doc.*")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM benchmark),
dp AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM d),
bp AS (SELECT item_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS q FROM b WHERE len(t) >= {LEAST}),
m AS (SELECT DISTINCT doc_id, item_id, n, p - q AS diag, q FROM dp JOIN bp USING (w)),
r AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q RANGE BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS c FROM m)
SELECT doc_id, item_id, max(c)::BIGINT AS matched FROM r WHERE c >= CASE WHEN n >= {SPAN} THEN {NEED} ELSE n END GROUP BY doc_id, item_id
"""
