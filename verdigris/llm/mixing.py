"""Mixing sources to target weights by hash-threshold histograms (native).

Every document has a 60-bit hash. For a budget, a source takes the documents
whose hash lies below a threshold: sizes are summed by source and hash bucket,
a running sum finds the bucket in which the budget ends, and only that bucket
is refined with the next 12 bits, until it holds one document; rows equal in id
and text have one hash and are told apart by a hash of their row number. Nothing is
sorted; each level shuffles at most 4096 sums per source and task. As all
budgets of a source use one hash order, the documents of a smaller budget are
among those of a larger one (nested thresholds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_row

BITS, LEVEL_BITS = 60, 12
#: Most sources whose thresholds are broadcast; more are joined by a salted shuffle.
BROADCAST_SOURCES = 20_000
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash_of(doc_id: Column, text: Column, seed: str) -> Column:
    """First 60 bits of an md5 over seed, id and text, as a long."""
    s = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(s.cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point, null after all."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("z"))


def _key_range(df: DataFrame, keys: DataFrame, n: int, by: str = "_h") -> DataFrame:
    """Joins a table of one row per source: broadcast if it has few rows, else
    both sides carry a salt, so that a hot source is spread over SALTS tasks."""
    if n <= BROADCAST_SOURCES:
        return df.join(F.broadcast(keys), "_skey")
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(salted, ["_skey", "_salt"]).drop("_salt")


def targets(per_source: DataFrame, share: float = 1.0, cap: int = 3, cycle: int = 3) -> DataFrame:
    """Adds ``target`` to (_skey, source_size), one row per source.

    Weights are 1..cycle by rank in code-point order. Targets are
    min(weight * level, cap * size) with the one level at which they sum to
    ``share`` of all sizes: what each round of resharing by weight converges to.
    Sorted by size per weight, the capped sources are a prefix, so running sums
    give the level. One row per source is all that meets in one task here.
    """
    one = Window.partitionBy(F.lit(0))
    by_key = one.orderBy("_skey")
    by_room = one.orderBy((F.col("source_size") / F.col("w")), "_skey")
    x = per_source.withColumn("w", (F.row_number().over(by_key) - 1) % cycle + 1)
    x = x.withColumn("_total", F.sum("source_size").over(one) * F.lit(share))
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_capped", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0).cast("long")))
    x = x.withColumn("_w_left", F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in this order, that its share of what is left does not exceed
    fits = (F.col("_total") - F.col("_capped")) * F.col("w") <= F.col("source_size") * cap * F.col("_w_left")
    x = x.withColumn("_fits", F.when(fits, F.struct((-F.col("_capped")).alias("c"), (F.col("_total") - F.col("_capped")).alias("left"), F.col("_w_left").alias("w"))))
    x = x.withColumn("_at", F.max("_fits").over(one))
    own = F.col("_at.left") * F.col("w") / F.col("_at.w")
    limit = (F.col("source_size") * cap).cast("double")
    return x.withColumn("target", F.least(limit, F.coalesce(own, limit)).cast("double")).select("_skey", "source_size", "target")


def _narrowed(rows: DataFrame, open_: DataFrame, n: int, final: bool) -> tuple[DataFrame, DataFrame]:
    """Finds where budgets end among rows (_skey, _x, size) with a hash _x. ``open_``
    has _skey, _rest (the budget) and _base (what lies before). Returns
    (_skey, threshold), and those budgets that end among several rows of one hash
    as (_skey, _rest, _base, _prefix); if ``final``, they end before or after all of these."""
    done, inside, open_ = None, rows, open_.withColumn("_prefix", F.lit(0).cast("long"))
    for shift in range(BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        held = _key_range(inside, open_, n, "_x").where(F.shiftright("_x", shift + LEVEL_BITS) == F.col("_prefix"))
        hist = held.groupBy("_skey", "_rest", "_base", F.shiftright("_x", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"))
        run = Window.partitionBy("_skey").orderBy("_bucket")
        hist = hist.withColumn("_upto", F.col("_base") + F.sum("_sum").over(run))
        # the budget ends in the first bucket whose running sum exceeds it
        edge = hist.where(F.col("_upto") > F.col("_rest")).groupBy("_skey", "_rest").agg(F.min(F.struct("_bucket", "_upto", "_sum", "_n")).alias("_e"))
        edge = cut(edge.select("_skey", "_rest", F.col("_e._bucket").alias("_prefix"), (F.col("_e._upto") - F.col("_e._sum")).alias("_base"), F.col("_e._upto").alias("_upto"), F.col("_e._n").alias("_n")), "mix-edge")
        last = shift == 0
        end = edge.where(F.lit(last and final) | (F.col("_n") == 1))
        near = (F.col("_rest") - F.col("_base")) > (F.col("_upto") - F.col("_rest"))  # the last document only if that comes nearer
        end = end.select("_skey", F.shiftleft(F.col("_prefix") + near.cast("long"), shift).alias("threshold"))
        done = end if done is None else done.unionByName(end)
        open_ = edge.where(F.lit(not (last and final)) & (F.col("_n") > 1)).select("_skey", "_rest", "_base", "_prefix")
        if last or open_.isEmpty():
            return done, open_
        inside = _key_range(rows, open_.select("_skey", "_prefix"), n, "_x").where(F.shiftright("_x", shift) == F.col("_prefix")).drop("_prefix")


def plan_mix(sized: DataFrame, share: float = 1.0, cap: int = 3) -> tuple[DataFrame, int]:
    """From a table (_skey, _h, _row, size): one row per source with its size,
    target, whole repeats and threshold: rows of a smaller _h are taken once more,
    and of those of the same _h, all alike, the ones whose number's hash is below ``tie``.
    And the number of sources."""
    per_source = cut(targets(sized.groupBy("_skey").agg(F.sum("size").alias("source_size")), share, cap), "mix-sources")
    n = per_source.count()
    goal = per_source.withColumn("repeats", F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(cap)).cast("long"))
    goal = goal.withColumn("_rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    open_ = goal.where("_rest > 0 and source_size > 0").select("_skey", "_rest", F.lit(0).cast("long").alias("_base"))
    done, ties = _narrowed(sized.select("_skey", F.col("_h").alias("_x"), "size"), open_, n, False)
    done = done.withColumn("tie", F.lit(0).cast("long"))
    if not ties.isEmpty():
        same = ties.withColumnRenamed("_prefix", "_at")
        rows = _key_range(sized.select("_skey", "_h", "_row", "size"), same.select("_skey", "_at"), n, "_row").where("_h = _at").select("_skey", row_bits().alias("_x"), "size")
        among, _ = _narrowed(rows, same.drop("_at"), n, True)
        done = done.unionByName(among.withColumnRenamed("threshold", "tie").join(same.select("_skey", F.col("_at").alias("threshold")), "_skey"))
    plan = goal.drop("_rest").join(done, "_skey", "left").na.fill(0, ["threshold", "tie"])
    return cut(plan, "mix-plan"), n


def row_bits() -> Column:
    return F.shiftrightunsigned(F.xxhash64("_row"), 64 - BITS)


def sized_rows(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """Written table: ``more``, source key, hash, row number and size of each document."""
    keys = [source_key(F.col("source")).alias("_skey"), hash_of(F.col("doc_id"), F.col("text"), seed).alias("_h"), F.monotonically_increasing_id().alias("_row"), size_of(F.col("text")).alias("size")]
    return cut(docs.select(*more, *keys), "mix-sized")


def _times() -> Column:
    once_more = (F.col("_h") < F.col("threshold")) | ((F.col("_h") == F.col("threshold")) & (row_bits() < F.col("tie")))
    return F.col("repeats") + once_more.cast("long")


def mix_report(docs: DataFrame, seed: str = "mix", share: float = 1.0, cap: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    taken is size times the number of times the mix takes the document. Null
    and empty texts have size 0 and are taken 0 words; a null source is a source
    of its own, ranked last; a null id is hashed by its text; rows equal in id
    and text share a hash, and as many of them are taken as the budget asks for; an
    empty table gives no rows. A source's taken words differ from its target by
    half its boundary document at most."""
    sized = sized_rows(docs, seed, F.col("doc_id"))
    plan, n = plan_mix(sized, share, cap)
    out = _key_range(sized, plan, n)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.0, cap: int = 3) -> DataFrame:
    """The mixed table: rows of ``docs``, each as often as the mix takes it,
    with the columns of ``docs`` only. Documents without words count nothing
    towards any budget and stay once; nulls, repeated rows and an empty table as
    in mix_report()."""
    sized = sized_rows(docs, seed, whole_row(docs).alias("_doc"))
    plan, n = plan_mix(sized.drop("_doc"), share, cap)
    out = _key_range(sized, plan.drop("source_size", "target"), n)
    times = F.when(F.col("size") == 0, 1).otherwise(_times()).cast("int")
    return out.select("_doc", F.explode(F.array_repeat(F.lit(0), times))).select("_doc.*")


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix_report(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS k,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY k),
r AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
        coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
        (sum(w) OVER (ORDER BY source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left FROM s),
lv AS (SELECT (total - capped) AS l, w_left AS wl FROM r WHERE (total - capped) * w <= source_size * 3 * w_left ORDER BY capped LIMIT 1),
t AS (SELECT r.k, source_size, w, least((source_size * 3)::DOUBLE, coalesce(l * w / wl, (source_size * 3)::DOUBLE)) AS target FROM r LEFT JOIN lv ON true),
g AS (SELECT *, least(floor(target / greatest(source_size, 1)), 3)::BIGINT AS reps FROM t),
c AS (SELECT d.*, source_size, target, reps, target - reps * source_size AS rest,
        sum(size) OVER (PARTITION BY d.k ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d JOIN g ON d.k = g.k)
SELECT doc_id, size, source_size, target,
       (size * (reps + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN 1 WHEN upto - size <= rest AND rest - (upto - size) > upto - rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
