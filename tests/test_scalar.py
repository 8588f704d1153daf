"""Golden values of the scalar functions and the payload."""

import json

import pytest
from pyspark.sql import functions as F

from verdigris.functions import http
from verdigris.functions.decide import response_body
from verdigris.functions.payload import extract, vector
from verdigris.functions.scalar import days_from_civil, hour_step, mcc_risk, quantize, weekday, weekday_step


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_quantize_keeps_every_step(spark):
    df = spark.range(10000).select("id", quantize((F.col("id") / 10000).cast("float")).alias("q"))
    assert df.where("id <> q").count() == 0
    assert column(spark, [-0.0001, 1.0, 7.5, None], "float", quantize)[:3] == [-10000, 10000, 10000]


def test_hour_weekday_and_risk(spark):
    hours = [0, 435, 870, 1304, 1739, 2174, 2609, 3043, 3478, 3913, 4348, 4783, 5217, 5652, 6087, 6522, 6957, 7391, 7826, 8261, 8696, 9130, 9565, 10000]
    assert column(spark, list(range(24)), "int", hour_step) == hours
    assert column(spark, list(range(7)), "int", weekday_step) == [0, 1667, 3333, 5000, 6667, 8333, 10000]
    assert column(spark, ["5411", "7995", "541", "9999", None], "string", lambda c: quantize(mcc_risk(c))) == [1500, 8500, 5000, 5000, 5000]


def test_days_run_on(spark):
    df = spark.createDataFrame([(2026, 3, 11), (2026, 13, 1), (2027, 1, 1), (2026, 2, 30), (2026, 3, 2), (1970, 1, 1)], "y int, m int, d int")
    got = [r[0] for r in df.select(days_from_civil(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got[0] == 20523 and got[1] == got[2] and got[3] == got[4] and got[5] == 0
    assert column(spark, [20523], "long", weekday) == [2]


def payload(amount, n, at, avg, count, known, merchant, mcc, mavg, online, card, km, last="none"):
    p = {"id": "x", "transaction": {"amount": amount, "installments": n, "requested_at": at}, "customer": {"avg_amount": avg, "tx_count_24h": count, "known_merchants": known}, "merchant": {"id": merchant, "mcc": mcc, "avg_amount": mavg}, "terminal": {"is_online": online, "card_present": card, "km_from_home": km}}
    if last != "none":
        p["last_transaction"] = last
    return p


A = payload(384.88, 3, "2026-03-11T20:23:35Z", 769.76, 3, ["m"], "m", "5912", 298.95, False, True, 13.71, {"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.86})
B = payload(9505.97, 10, "2026-03-14T05:15:12Z", 81.28, 20, [], "m", "7802", 54.86, False, True, 952.27, None)
C = payload(41.12, 2, "2026-03-11T18:45:53Z", 0, 3, ["z"], "m", "9999", 60.25, True, False, 29.23)
VECTORS = [
    [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299],
    [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55],
    [41, 1667, 0, 7826, 3333, -10000, -10000, 292, 1500, 10000, 0, 10000, 5000, 60],
]


def run(spark, bodies):
    df = spark.createDataFrame([(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    f = extract(df).withColumn("v", F.array(*vector()))
    return [(r.valid, r.v) for r in f.orderBy("i").collect()]


def test_golden_payloads(spark):
    assert run(spark, [A, B, C]) == [(True, v) for v in VECTORS]


def changed(p, path, value):
    p = json.loads(json.dumps(p))
    *up, leaf = path.split(".")
    at = p
    for k in up:
        at = at[k]
    if value == "drop":
        del at[leaf]
    else:
        at[leaf] = value
    return p


def test_payload_edges(spark):
    cases = [
        (changed(A, "transaction.requested_at", "drop"), False),
        (changed(A, "transaction.requested_at", "2026-03-11 20:23:35"), False),
        (changed(A, "transaction.requested_at", "2026-03-11T25:23:35"), False),
        (changed(A, "transaction.amount", None), False),
        (changed(A, "transaction.amount", "1.5"), False),
        (changed(A, "transaction.amount", "drop"), True),
        (changed(A, "last_transaction", 3), False),
        (changed(A, "last_transaction.timestamp", "drop"), True),
        (changed(A, "transaction.requested_at", "2026-03-11T20:23:35+03:00"), True),
        ("not json", False),
        ("[1]", False),
        ("", False),
    ]
    got = run(spark, [c for c, _ in cases])
    assert [g[0] for g in got] == [ok for _, ok in cases]
    assert got[5][1][0] == 0 and got[7][1][5:7] == [-10000, -10000] and got[8][1] == VECTORS[0]
    negative = run(spark, [changed(A, "transaction.amount", -1), changed(A, "last_transaction.timestamp", "2026-03-12T00:00:00Z")])
    assert negative[0][1][0] == -10000 and negative[1][1][5] == 0


def test_http_edges(spark):
    raws = ["GET", "GET /ready HTTP/1.1\r\n\r\n", "GET /ready", "POST /fraud-score HTTP/1.1\r\nContent-Length: 3\r\nContent-Length: 2\r\n\r\nab", "POST /fraud-score HTTP/1.1\r\nConnection: CLOSE\r\n\r\n", "POST /fraud-score HTTP/1.1\r\nContent-Length: 4097\r\n\r\n", "x" * 256, "x" * 257, "GET /ready" + "y" * 8192]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    c = http.classify(F.col("raw"))
    rows = df.select("i", *[v.alias(k) for k, v in c.items()]).orderBy("i").collect()
    assert [r.status for r in rows] == ["NEED_MORE", "READY", "NEED_MORE", "FRAUD", "FRAUD", "BAD", "NEED_MORE", "BAD", "BAD"]
    assert bytes(rows[3].body) == b"ab" and rows[3].keep_alive and not rows[4].keep_alive and rows[4].body_len == 0


def test_http_counts_bytes(spark):
    raws = ["POST /fraud-score HTTP/1.1\r\nContent-Length: 2\r\n\r\né", "POST /fraud-score HTTP/1.1\r\nX: é\r\nContent-Length: 3\r\n\r\né!", "é" * 128, "é" * 129, None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    c = http.classify(F.col("raw"))
    rows = df.select("i", *[v.alias(k) for k, v in c.items()]).orderBy("i").collect()
    assert [r.status for r in rows] == ["FRAUD", "FRAUD", "NEED_MORE", "BAD", "NEED_MORE"]
    assert [bytes(r.body).decode() for r in rows[:2]] == ["é", "é!"] and rows[0].total == len(raws[0].encode())


def test_pipelined(spark):
    post = "POST /fraud-score HTTP/1.1\r\nContent-Length: 1\r\n\r\na"
    ready, close = "GET /ready HTTP/1.1\r\n\r\n", "GET /ready HTTP/1.1\r\nConnection: close\r\n\r\n"
    raws = [post + ready + post, close + post, post + post[:-1], ready * 5, "", None, "x" * 300 + ready]
    df = spark.createDataFrame([(i, r, "k") for i, r in enumerate(raws)], "i int, raw string, status string")
    got = {}
    for r in http.split_buffers(df.drop("status"), most=4).orderBy("i", "number").collect():
        got.setdefault(r.i, []).append(r.status)
    assert got == {0: ["FRAUD", "READY", "FRAUD"], 1: ["READY"], 2: ["FRAUD", "NEED_MORE"], 3: ["READY"] * 4 + ["OVERFULL"], 4: ["NEED_MORE"], 5: ["NEED_MORE"], 6: ["BAD"]}


def test_answers(spark):
    from verdigris.functions.decide import BAD_RESPONSE, ready_response, response

    row = spark.range(1).select(response(F.lit(2), F.lit(False)).alias("a"), response(F.lit(3), F.lit(True)).alias("b"), ready_response(F.lit(True)).alias("c"), ready_response(F.lit(False)).alias("d")).first()
    json_head = "HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nContent-Length: "
    assert row.a == json_head + '35\r\nConnection: close\r\n\r\n{"approved":true,"fraud_score":0.4}'
    assert row.b == json_head + '36\r\n\r\n{"approved":false,"fraud_score":0.6}'
    assert row.c == "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Length: 2\r\n\r\nok" and "close\r\n\r\nok" in row.d
    assert BAD_RESPONSE.startswith("HTTP/1.1 400 Bad Request\r\n") and BAD_RESPONSE.endswith("\r\n\r\n")


def test_bodies(spark):
    got = column(spark, list(range(6)), "int", response_body)
    assert got == ['{"approved":true,"fraud_score":0.0}', '{"approved":true,"fraud_score":0.2}', '{"approved":true,"fraud_score":0.4}', '{"approved":false,"fraud_score":0.6}', '{"approved":false,"fraud_score":0.8}', '{"approved":false,"fraud_score":1.0}']


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_entry(spark, folder):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "frauds", "approved", "body"] and df.count() == 500
