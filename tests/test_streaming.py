import datetime
import random

from conftest import rows

from citegrid.streaming import limits as L

T0 = datetime.datetime(2020, 1, 1)
SCHEMA = "request_id bigint, ip string, ts timestamp, api_key string"


def log(spark, seconds, ip="u"):
    return spark.createDataFrame([(i, ip if isinstance(ip, str) else ip[i], T0 + datetime.timedelta(seconds=s), None) for i, s in enumerate(seconds)], SCHEMA)


def brute(times, hour, day):
    ok = []
    out = []
    for t in times:
        good = sum(t - x < 3600 for x in ok) < hour and sum(t - x < 86400 for x in ok) < day
        out.append(good)
        if good:
            ok.append(t)
    return out


def test_ip_limit_against_brute_force(spark):
    rng = random.Random(1)
    times = sorted(rng.randrange(0, 6 * 86400) for _ in range(300))
    got = {r.request_id: r.accepted for r in L.ip_limit(log(spark, times), 2, 9).collect()}
    assert [got[i] for i in range(300)] == brute(times, 2, 9)


def test_edges(spark):
    assert [a for _, a in rows(L.ip_limit(log(spark, [0, 3599, 3600]), 1, 9), "request_id", "accepted")] == [True, False, True]
    assert L.ip_limit(log(spark, []), 1, 1).count() == 0


def test_what_the_ip_limit_rejects_is_charged_to_all(spark):
    df = log(spark, [0, 1, 2], ["u", "u", "v"])
    got = rows(L.admission(df, None, 1, 9, 2), "request_id", "accepted")
    assert got == [(0, True), (1, False)]  # the third finds the day's budget of two used up


def test_keys(spark):
    df = spark.createDataFrame([(1, "u", T0, "k"), (2, "u", T0, "x"), (3, "u", T0, None)], SCHEMA)
    assert rows(L.admission(df, ["k"]), "request_id") == [(1,)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    df = log(spark, sorted(rng.randrange(0, 86400) for _ in range(60)), [rng.choice("uv") for _ in range(60)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = L.stream_ip_limit(stream, 1, 5).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("limited"), "request_id", "accepted") == rows(L.ip_limit(df, 1, 5), "request_id", "accepted")


def test_ingest_twice_is_ingest_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    one.write.parquet(src)
    read = lambda: spark.readStream.schema(one.schema).parquet(src)
    L.ingest_stream(read(), out, "id", ck)
    L.ingest_stream(read(), out, "id", ck)
    spark.createDataFrame([(2, "c"), (3, "d")], one.schema).write.mode("append").parquet(src)
    L.ingest_stream(read(), out, "id", ck)
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b"), (3, "d")]


def test_breaker(spark):
    df = spark.createDataFrame([("w", i, ok) for i, ok in enumerate([True, False, False, False, True, False])], "worker string, seq int, ok boolean")
    assert rows(L.breaker(df)) == [("w", 1, 3, 3)]
