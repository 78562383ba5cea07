import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tributary.functions import scalar
from tributary.operators import aggregates as A
from tributary.operators import inference, joins, shape
from tributary.operators import windows as W


def at(text):
    return dt.datetime.fromisoformat(text)


def test_ohlcv_fixture(spark):
    rows = [("10:00:05", "AAPL", 150.0, 100), ("10:00:25", "AAPL", 151.0, 50), ("10:00:45", "AAPL", 149.0, 200), ("10:00:55", "AAPL", 150.5, 150), ("10:01:05", "AAPL", 152.0, 100), ("10:00:10", "MSFT", 300.0, 50)]
    df = spark.createDataFrame([(at(f"2023-10-01T{t}"), s, p, v) for t, s, p, v in rows], "ts timestamp, symbol string, price double, volume long")
    got = {(r["symbol"], r["s"]): tuple(r)[2:7] for r in W.ohlcv(df, "symbol", "ts", "price", "volume", ["ts"], "1 minute").select("symbol", scalar.iso_z(F.col("window_start")).alias("s"), "open", "high", "low", "close", "volume").collect()}
    assert got[("AAPL", "2023-10-01T10:00:00Z")] == (150.0, 151.0, 149.0, 150.5, 500)
    assert got[("MSFT", "2023-10-01T10:00:00Z")] == (300.0, 300.0, 300.0, 300.0, 50)


def test_sessions_end_with_last_event(spark):
    rows = [("u1", "10:00"), ("u1", "10:15"), ("u1", "11:00"), ("u2", "10:05"), ("u2", "10:20"), ("u2", "10:30")]
    df = spark.createDataFrame([(u, at(f"2023-10-01T{t}:00")) for u, t in rows], "u string, ts timestamp")
    got = sorted((r["u"], r["session_end"].strftime("%H:%M"), r["events"]) for r in W.sessions(df, "u", "ts", "30 minutes").collect())
    assert got == [("u1", "10:15", 2), ("u1", "11:00", 1), ("u2", "10:30", 3)]


def test_outlier(spark):
    rows = [(5 * i, 20.0) for i in range(10)] + [(50, 100.0), (65, 20.0), (120, 20.0)]
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=s), v) for s, v in rows], "k string, ts timestamp, value double")
    got = W.outliers(df, ["k"], "ts", "value", "60 seconds", "20 seconds").select("value").distinct().collect()
    assert [r["value"] for r in got] == [100.0]


def test_branch_keeps_every_row(spark):
    df = spark.createDataFrame([(1,), (None,), (9,)], "x int")
    yes, no = shape.branch(df, F.col("x") > 5)
    assert (yes.count(), no.count()) == (1, 2)
    assert shape.merge(yes, no.withColumn("y", F.lit(1))).where("y is null").count() == 1


def test_dead_letter(spark):
    raw = ['{"sensor_type": "t", "v": 1}', "{nope", '{"v": 2}', None]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    got = [r["error"] for r in shape.dead_letter(df, F.col("raw"), "sensor_type").collect()]
    assert got == [None, "invalid json", "missing sensor_type", "invalid json"]


def test_join_complete_uses_latest_and_string_keys(spark):
    users = spark.createDataFrame([("1", 1, "Al"), ("1", 2, "Alice"), ("2", 1, "Bob"), ("3", 1, "Eve")], "key string, s int, name string")
    mail = spark.createDataFrame([(1, 1, "a@x"), (2, 1, "b@x")], "key int, s2 int, mail string")
    got = joins.join_complete([(users, ["s"]), (mail, ["s2"])], "key").select("key", "name", "mail").collect()
    assert sorted(map(tuple, got)) == [("1", "Alice", "a@x"), ("2", "Bob", "b@x")]


def test_moving_average_and_batches(spark):
    df = spark.createDataFrame([(i, "s", float(v)) for i, v in enumerate((10, 15, 20, 25))], "seq long, k string, v double")
    assert [r["average"] for r in A.moving_average(df, "k", ["seq"], "v").orderBy("seq").collect()] == [10.0, 12.5, 15.0, 20.0]
    assert [r["batch"] for r in A.batches(df, "k", ["seq"], 3).orderBy("seq").collect()] == [0, 0, 0, 1]


def test_threshold_default(spark):
    df = spark.createDataFrame([(1, "d", None, 105.0), (2, "d", 110.0, None), (3, "d", None, 108.0), (4, "d", None, 115.0)], "seq long, k string, cfg double, v double")
    got = A.latest_setting(df, "k", ["seq"], F.col("cfg"), 100.0).where("v > setting").orderBy("seq").collect()
    assert [(r["v"], r["setting"]) for r in got] == [(105.0, 100.0), (115.0, 110.0)]


def test_top_k(spark):
    df = spark.createDataFrame([("p1", 100), ("p2", 200), ("p1", 150), ("p3", 50), ("p4", 300), ("p2", 180), ("p5", 250)], "p string, s long")
    assert [tuple(r) for r in A.top_k(df, "p", "s", 3).collect()] == [("p4", 300), ("p5", 250), ("p2", 200)]


def test_scalars(spark):
    r = spark.sql("select timestamp'2023-01-01 12:00:00' as ts, 'abc' as s, 0.625d as x, 'a/b/c' as p").select(
        scalar.iso_z(F.col("ts")), scalar.offset_text(F.col("ts")), scalar.capitalise(F.col("s")), scalar.fixed2(F.col("x")), scalar.last_part(F.col("p")), scalar.route_hash(F.col("s"), 7), scalar.parse_iso(F.lit("2023-01-01T12:00:00Z")) == F.col("ts")
    ).first()
    assert tuple(r) == ("2023-01-01T12:00:00Z", "2023-01-01 12:00:00+00:00", "Abc", "0.63", "c", int(hashlib.md5(b"abc").hexdigest()[:8], 16) % 7, True)


def test_embeddings(spark):
    r = inference.embed(spark.createDataFrame([("a b",), (None,)], "t string"), "t").collect()
    assert [len(x["embedding"]) for x in r] == [384, 384]


def test_plans_push_down(spark, data):
    from tributary.plans.registry import QUERIES

    plan = QUERIES["join_timeout"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,signup)" in plan
    assert "props" not in plan.split("ReadSchema")[1][:120]
