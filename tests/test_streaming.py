import json

from pyspark.sql import functions as F

from tributary.operators import folds
from tributary.streaming import twins


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_fold_goes_on_after_restart(spark, tmp_path):
    src, seen = tmp_path / "in", []

    def step(high, row):
        high = row["v"] if high is None else max(high, row["v"])
        return high, [{"k": row["k"], "high": high, "seq": row["seq"]}]

    def once():
        s = twins.file_stream(spark, str(src), "seq long, k string, v long")
        twins.run_once(twins.folded(s, "k", step, ["seq"], "k string, high long, seq long"), str(tmp_path / "ck"), lambda df, i: seen.extend(sorted((r["seq"], r["k"], r["high"]) for r in df.collect())))

    put(src, "1.json", [{"seq": 1, "k": "A", "v": 10}, {"seq": 2, "k": "B", "v": 5}, {"seq": 3, "k": "A", "v": 20}])
    once()
    assert [x[1:] for x in seen] == [("A", 10), ("B", 5), ("A", 20)]
    seen.clear()
    put(src, "2.json", [{"seq": 4, "k": "A", "v": 15}, {"seq": 5, "k": "B", "v": 25}, {"seq": 6, "k": "C", "v": 100}])
    once()
    assert [x[1:] for x in seen] == [("A", 20), ("B", 25), ("C", 100)]


def test_stateful_dedup(spark, tmp_path):
    src, seen = tmp_path / "in", []
    put(src, "1.json", [{"seq": i, "k": "u1", "t": float(t)} for i, t in enumerate((0, 5, 11, 15))])
    s = twins.file_stream(spark, str(src), "seq long, k string, t double")
    twins.run_once(twins.folded(s, "k", folds.dedup_step(10, "t", ["seq"]), ["seq"], "seq long"), str(tmp_path / "ck"), lambda df, i: seen.extend(r["seq"] for r in df.collect()))
    assert sorted(seen) == [0, 2]


def test_windows_emit_open_ones(spark, tmp_path):
    src, seen = tmp_path / "in", {}
    put(src, "1.json", [{"k": "auth", "ts": f"2023-10-01T10:00:{s}Z", "v": v} for s, v in (("00", 200), ("02", 600), ("05", 2500), ("08", 400), ("12", 100))])
    s = twins.file_stream(spark, str(src), "k string, ts timestamp, v double")
    w = twins.windowed(s, ["k"], "ts", "1 minute", "10 seconds", F.count(F.lit(1)).alias("n"))
    twins.run_once(w, str(tmp_path / "ck"), lambda df, i: seen.update({r["window"].start.second: r["n"] for r in df.collect()}))
    assert seen == {0: 4, 10: 1}


def test_collect_emits_full_batches(spark, tmp_path):
    src, seen = tmp_path / "in", []
    put(src, "1.json", [{"k": "a", "v": str(i)} for i in range(5)])
    s = twins.file_stream(spark, str(src), "k string, v string")
    q = twins.collected(s, "k", "v", 3, 1500).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").foreachBatch(lambda df, i: seen.extend((r["n"], r["items"]) for r in df.collect())).start()
    try:
        import time

        end = time.time() + 60
        while time.time() < end and len(seen) < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(n for n, _ in seen) == [2, 3]


def test_late_rows_are_split(spark, tmp_path):
    got = {"on_time": [], "late": []}
    state = {k: (lambda df, i, k=k: got[k].extend(r["x"] for r in df.collect())) for k in got}
    log = str(tmp_path / "watermark")
    for i, rows in enumerate(([(1, 10), (2, 20)], [(3, 14), (4, 16), (5, None)])):  # each batch by a process of its own
        twins.split_late(state, "ts", 5, log)(spark.createDataFrame(rows, "x int, s long").select("x", F.timestamp_seconds("s").alias("ts")), i)
    assert (sorted(got["on_time"]), got["late"]) == ([1, 2, 4, 5], [3])
    got["late"].clear()
    twins.split_late(state, "ts", 5, log)(spark.createDataFrame([(3, 14), (6, 99)], "x int, s long").select("x", F.timestamp_seconds("s").alias("ts")), 1)  # again
    assert got["late"] == [3]


def test_stream_join(spark, tmp_path):
    a, b, seen = tmp_path / "a", tmp_path / "b", []
    put(a, "1.json", [{"k": "o1", "ots": "2024-01-01T00:00:00Z"}, {"k": "o2", "ots": "2024-01-01T00:00:00Z"}])
    put(b, "1.json", [{"k": "o1", "pts": "2024-01-01T00:04:00Z"}, {"k": "o2", "pts": "2024-01-01T00:30:00Z"}])
    left, right = twins.file_stream(spark, str(a), "k string, ots timestamp"), twins.file_stream(spark, str(b), "k string, pts timestamp")
    twins.run_once(twins.join_within(left, right, "k", "ots", "pts", "1 hour", "10 minutes"), str(tmp_path / "ck"), lambda df, i: seen.extend(r["k"] for r in df.collect()), mode="append")
    assert seen == ["o1"]
