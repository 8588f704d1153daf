"""Queries of the scalar functions, the payload and the requests, over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..functions.payload import extract, vector
from ..functions.scalar import DEFAULT_RISK, MCC_RISK, days_from_civil, hour_step, iso_seconds, iso_valid, mcc_risk, minutes_between, quantize, quotient, ratio, weekday, weekday_step

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q_sql(v: str) -> str:
    return f"CASE WHEN ({v}) < 0 THEN -10000 WHEN ({v}) >= 1 THEN 10000 ELSE CAST(floor(({v}) * 10000::FLOAT + 0.5::FLOAT) AS INTEGER) END"


ISO_SPARK, ISO_SQL = "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"


@query(f"SELECT event_id, {q_sql('CAST((value - 50) / 60 AS FLOAT)')} AS q FROM events")
def quantize_scalar(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", quantize(((F.col("value") - 50) / 60).cast("float")).alias("q"))


_r = "CASE WHEN c_acctbal::FLOAT > 0 THEN o_totalprice::FLOAT / c_acctbal::FLOAT ELSE 0::FLOAT END"


@query(f"SELECT o_orderkey, {q_sql(f'({_r}) / 1000::FLOAT')} AS q FROM orders JOIN customer ON o_custkey = c_custkey")
def guarded_ratio(spark, sf_dir):
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", quantize(quotient(ratio(F.col("o_totalprice"), F.col("c_acctbal")), 1000)).alias("q"))


@query("""SELECT CAST((hour(ts) * 10000 + 11) // 23 AS INTEGER) AS hour_step, CAST(((isodow(ts) - 1) * 10000 + 3) // 6 AS INTEGER) AS day_step, count(*) AS n
FROM events GROUP BY 1, 2""")
def hour_weekday_buckets(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    day = weekday(F.unix_date(F.to_date("ts")))
    return e.groupBy(hour_step(F.hour("ts")).alias("hour_step"), weekday_step(day).alias("day_step")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate) + (o_orderkey % 3) AS m, day(o_orderdate) + (o_orderkey % 4) AS d FROM orders),
b AS (SELECT *, y - CASE WHEN m <= 2 THEN 1 ELSE 0 END AS yy, CASE WHEN m > 2 THEN m - 3 ELSE m + 9 END AS mm FROM a)
SELECT o_orderkey, CAST(yy * 365 + yy // 4 - yy // 100 + yy // 400 + (153 * mm + 2) // 5 + d - 1 - 719468 AS BIGINT) AS days FROM b""")
def civil_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    return o.select("o_orderkey", days_from_civil(F.year(t), F.month(t) + k % 3, F.dayofmonth(t) + k % 4).alias("days"))


@query(f"""SELECT event_id, event_id % 7 <> 0 AS valid, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) END AS seconds FROM events""")
def iso_parse_valid(spark, sf_dir):
    text = F.date_format("ts", ISO_SPARK)
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 7 == 0, F.translate(text, "T", " ")).otherwise(text), F.lit("+03:00")).alias("t"))
    ok = iso_valid(F.col("t"))
    return e.select("event_id", ok.alias("valid"), F.when(ok, iso_seconds(F.col("t"))).alias("seconds"))


@query("""WITH l AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, p IS NOT NULL AS has_last, CASE WHEN p IS NOT NULL THEN greatest((s - p) // 60, 0) END AS minutes FROM l""")
def minutes_since_last(spark, sf_dir):
    s = F.unix_timestamp("ts")
    e = read(spark, sf_dir, "events").select("event_id", s.alias("s"), F.lag(s).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("p"))
    return e.select("event_id", F.col("p").isNotNull().alias("has_last"), F.when(F.col("p").isNotNull(), minutes_between(F.col("s"), F.col("p"))).alias("minutes"))


# Own choice: merchant category of an event type.
MCC = {"view": "5411", "signup": "5999", "purchase": "7995", "error": "7802"}
_mcc_sql = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MCC.items()) + " ELSE '0000' END"
_risk_sql = f"CASE {_mcc_sql} WHEN '5411' THEN 0.15::FLOAT WHEN '5999' THEN 0.5::FLOAT WHEN '7995' THEN 0.85::FLOAT WHEN '7802' THEN 0.75::FLOAT ELSE 0.5::FLOAT END"


def mcc_of(event_type):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MCC.items() for x in kv]), event_type), F.lit("0000"))


# all known codes, and two that are none
_codes = [*MCC_RISK, "541", "0000"]
_code_sql = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_codes)) + " END"
_known_sql = f"CASE {_code_sql} " + " ".join(f"WHEN '{c}' THEN {x}::FLOAT" for c, x in MCC_RISK.items()) + f" ELSE {DEFAULT_RISK}::FLOAT END"


@query(f"SELECT {_code_sql} AS mcc, {q_sql(_known_sql)} AS risk, count(*) AS n FROM events GROUP BY 1, 2")
def mcc_risk_lookup(spark, sf_dir):
    code = F.get(F.array(*map(F.lit, _codes)), (F.col("event_id") % 12).cast("int"))
    return read(spark, sf_dir, "events").groupBy(code.alias("mcc"), quantize(mcc_risk(code)).alias("risk")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT *, 'm' || (event_id % 7)::VARCHAR AS merchant FROM events)
SELECT event_id, NOT coalesce(list_contains(list(merchant) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), merchant), false) AS unknown FROM m""")
def unknown_merchant(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("merchant", F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")))
    known = F.collect_list("merchant").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, -1))
    return e.withColumn("known", known).select("event_id", (~F.coalesce(F.array_contains("known", F.col("merchant")), F.lit(False))).alias("unknown"))


def payloads(spark, sf_dir, *more: str) -> DataFrame:
    """(event_id, body), and columns of events that are asked for: transactions made from events. Every 11th holds a null
    amount and every 17th a malformed timestamp, which makes them invalid."""
    i, u = F.col("event_id"), F.col("user_id")
    at = F.date_format("ts", ISO_SPARK)
    before = F.date_format(F.col("ts") - F.make_interval(mins=(i % 2000).cast("int")), ISO_SPARK)
    text = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    number = lambda x: x.cast("string")
    flag = lambda x: F.when(x, "true").otherwise("false")
    last = F.when(i % 3 == 0, F.lit("null")).otherwise(F.concat(F.lit("{"), F.when(i % 10 == 4, "").otherwise(F.concat(F.lit('"timestamp":'), text(F.concat(before, F.lit("Z"))), F.lit(","))), F.lit('"km_from_current":'), number(u % 1000 * 1.25), F.lit("}")))
    parts = [
        '{"id":', text(number(i)), ',"transaction":{"amount":', F.when(i % 11 == 0, "null").otherwise(number(F.col("value") * 20)), ',"installments":', number(i % 13), ',"requested_at":',
        text(F.when(i % 17 == 0, F.translate(at, "T", " ")).otherwise(F.concat(at, F.lit("Z")))), '},"customer":{"avg_amount":', number(u % 50 * 10.0), ',"tx_count_24h":', number(i % 25), ',"known_merchants":["m0",', text(F.concat(F.lit("m"), number(u % 7))),
        ']},"merchant":{"id":', text(F.concat(F.lit("m"), number(i % 7))), ',"mcc":', text(mcc_of(F.col("event_type"))), ',"avg_amount":', number(i % 100 * 1.5), '},"terminal":{"is_online":', flag(F.col("event_type").isin("view", "click")),
        ',"card_present":', flag(i % 2 == 0), ',"km_from_home":', number(i % 1200), '},"last_transaction":', last, "}",
    ]
    return read(spark, sf_dir, "events").select("event_id", *more, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("body"))


_fields = f"""SELECT event_id, event_id % 11 <> 0 AND event_id % 17 <> 0 AS valid, CASE WHEN event_id % 11 = 0 THEN 0::FLOAT ELSE CAST(value * 20 AS FLOAT) END AS amount,
  (event_id % 13)::FLOAT AS installments, CAST(user_id % 50 * 10 AS FLOAT) AS cavg, (event_id % 25)::FLOAT AS txs, CAST(event_id % 100 * 1.5 AS FLOAT) AS mavg,
  CAST(event_id % 1200 AS FLOAT) AS km, CASE WHEN event_id % 3 = 0 THEN 0::FLOAT ELSE CAST(user_id % 1000 * 1.25 AS FLOAT) END AS km_last,
  hour(ts) AS h, isodow(ts) - 1 AS wd, event_id % 3 <> 0 AND event_id % 10 <> 4 AS has_last, (event_id % 2000)::FLOAT AS mins, event_type IN ('view', 'click') AS online,
  event_id % 2 = 0 AS card, event_id % 7 <> 0 AND event_id % 7 <> user_id % 7 AS unknown, {_risk_sql} AS risk, {_mcc_sql} AS mcc, event_type FROM events"""


@query(f"""WITH f AS ({_fields}) SELECT event_id, valid, CAST(floor(amount::DOUBLE * 100) AS BIGINT) AS cents, has_last, CASE WHEN has_last THEN mins::BIGINT END AS minutes, unknown, mcc FROM f""")
def payload_extract(spark, sf_dir):
    f = extract(payloads(spark, sf_dir))
    return f.select("event_id", "valid", F.floor(F.col("amount").cast("double") * 100).alias("cents"), "has_last", "minutes", F.col("unknown_merchant").alias("unknown"), "mcc")


_dims = ", ".join([
    q_sql("amount / 10000::FLOAT"), q_sql("installments / 12::FLOAT"), f"CASE WHEN cavg > 0 THEN {q_sql('(amount / cavg) / 10::FLOAT')} ELSE 0 END", "CAST((h * 10000 + 11) // 23 AS INTEGER)", "CAST((wd * 10000 + 3) // 6 AS INTEGER)",
    f"CASE WHEN has_last THEN {q_sql('mins / 1440::FLOAT')} ELSE -10000 END", f"CASE WHEN has_last THEN {q_sql('km_last / 1000::FLOAT')} ELSE -10000 END", q_sql("km / 1000::FLOAT"), q_sql("txs / 20::FLOAT"),
    "CASE WHEN online THEN 10000 ELSE 0 END", "CASE WHEN card THEN 10000 ELSE 0 END", "CASE WHEN unknown THEN 10000 ELSE 0 END", q_sql("risk"), q_sql("mavg / 10000::FLOAT"),
])


@query(f"WITH f AS ({_fields}), v AS (SELECT event_id, [{_dims}] AS q FROM f WHERE valid) SELECT event_id, " + ", ".join(f"q[{i + 1}] AS d{i}" for i in range(14)) + " FROM v")
def feature_vector14(spark, sf_dir):
    f = extract(payloads(spark, sf_dir)).where("valid")
    return f.select("event_id", *[v.alias(f"d{i}") for i, v in enumerate(vector())])


def raw_requests(spark, sf_dir) -> DataFrame:
    """(event_id, raw): requests of six kinds."""
    i = F.col("event_id")
    body = F.concat(F.when(i % 5 == 0, F.lit("é")).otherwise(F.lit("")), F.repeat(F.lit("x"), (i % 50).cast("int")))
    n = F.octet_length(body).cast("string")
    kinds = [
        F.lit("GET /readXYZ HTTP/1.1\r\nHost: a\r\n\r\n"),
        F.concat(F.lit("POST /fraud-score HTTP/1.1\r\nContent-Length: "), n, F.lit("\r\n\r\n"), body),
        F.concat(F.lit("POST /fraud-score HTTP/1.1\r\ncontent-LENGTH:\t"), n, F.lit("\r\nCONNECTION: Close\r\n\r\n"), body),
        F.lit("POST /fraud-score HTTP/1.1\r\nContent-Length: 4097\r\n\r\n"),
        F.concat(F.lit("PUT /"), F.repeat(F.lit("y"), (i % 600).cast("int"))),
        F.concat(F.lit("POST /fraud-score HTTP/1.1\r\nContent-Length: 60\r\n\r\n"), body),
    ]
    pick = F.when(F.lit(False), "")
    for k, kind in enumerate(kinds):
        pick = pick.when(i % len(kinds) == k, kind)
    return read(spark, sf_dir, "events").select("event_id", pick.alias("raw"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'READY' WHEN 1 THEN 'FRAUD' WHEN 2 THEN 'FRAUD' WHEN 3 THEN 'BAD' WHEN 4 THEN CASE WHEN event_id % 600 + 5 > 256 THEN 'BAD' ELSE 'NEED_MORE' END ELSE 'NEED_MORE' END AS status,
CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS keep_alive, CASE WHEN event_id % 6 IN (1, 2) THEN event_id % 50 + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END END AS body_len FROM events""")
def http_classify(spark, sf_dir):
    c = http.classify(F.col("raw"))
    return raw_requests(spark, sf_dir).select("event_id", c["status"].alias("status"), c["keep_alive"].alias("keep_alive"), c["body_len"].alias("body_len"))


@query("SELECT upstream, count(*) AS n FROM (SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) % 2 AS INTEGER) AS upstream FROM events) GROUP BY upstream")
def round_robin_assign(spark, sf_dir):
    from ..operators.rows import numbered

    e = numbered(read(spark, sf_dir, "events").select("event_id"), "event_id", name="number")
    return e.groupBy(http.upstream(F.col("number"), 2).alias("upstream")).agg(F.count("*").alias("n"))
