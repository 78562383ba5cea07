import json
import sqlite3

from pyspark.sql import functions as F

from tributary.sources import connectors, files, sinks


def test_json_and_lookup(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "u": "x"}\nnope\n{"id": "2"}\n')
    got = files.json_lines(spark, str(tmp_path / "a.jsonl"), "id string, u string").collect()
    assert [(r["id"], r["_raw"]) for r in got] == [("1", None), (None, "nope"), ("2", None)]
    (tmp_path / "p.json").write_text(json.dumps({"p1": {"category": "e", "price": 1.5}, "p2": {"category": "b", "price": 2}}))
    assert sorted(map(tuple, files.json_lookup(spark, str(tmp_path / "p.json"), "category string, price double").collect())) == [("p1", "e", 1.5), ("p2", "b", 2.0)]
    (tmp_path / "arr.json").write_text('[{"p": "A", "n": 1},\n {"p": "B", "n": 2}]')
    assert files.json_array(spark, str(tmp_path / "arr.json"), "p string, n int").count() == 2


def test_csv_and_numbered_lines(spark, tmp_path):
    (tmp_path / "h.csv").write_text("k,v\na,1\nb,2\n")
    (tmp_path / "n.csv").write_text("a,1\nb,2\n")
    assert files.csv_rows(spark, str(tmp_path / "h.csv"), "k string, v int").count() == 2
    assert files.csv_rows(spark, str(tmp_path / "n.csv"), "k string, v int", header=False).count() == 2
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 5000 and all(r["line"] == f"line {r['seq']}" for r in got)


def test_custom_sources(spark, tmp_path):
    connectors.register(spark)
    (tmp_path / "l.txt").write_text("".join(f"{i}\n" for i in range(10)))
    got = spark.read.format("dealt_lines").option("path", str(tmp_path / "l.txt")).load().collect()
    assert sorted((r["seq"], r["part"]) for r in got) == [(i, i % 3) for i in range(10)]
    d = tmp_path / "d"
    d.mkdir()
    for i, words in enumerate((["hello", "world"], ["async", "streams"], ["x", "rocks"])):
        (d / f"f{i}").write_text("\n".join(words) + "\n")
    got = spark.read.format("worker_files").option("path", str(d)).option("workers", 2).load().collect()
    assert sorted(r["line"].upper() for r in got) == ["ASYNC", "HELLO", "ROCKS", "STREAMS", "WORLD", "X"]


def test_sqlite_pages(spark, tmp_path):
    connectors.register(spark)
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as db:
        db.execute("create table e (id integer, user_id text)")
        db.executemany("insert into e values (?, ?)", [(i, f"u{i % 2}") for i in range(1, 13)])
    options = {"path": path, "table": "e", "schema": "id long, user_id string", "page": "5"}
    assert spark.read.format("sqlite_pages").options(**options).load().count() == 12
    got = []
    q = spark.readStream.format("sqlite_pages").options(**options).load().writeStream.foreachBatch(lambda df, i: got.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [x for b in got for x in b] == list(range(1, 13)) and max(map(len, got)) <= 5


def test_resumable_files_and_keyed_sink(spark, tmp_path):
    connectors.register(spark)
    src, out, ck = tmp_path / "in", tmp_path / "out", str(tmp_path / "ck")
    src.mkdir()
    (src / "file1").write_text("line1\nline2\nline3\n")
    (src / "file2").write_text("hello\nworld\n")
    write = sinks.keyed_files(str(out), "file", 2)

    def once():
        s = spark.readStream.format("resumable_files").option("path", str(src)).load().select("file", F.upper("line").alias("line"))
        q = s.writeStream.foreachBatch(write).option("checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    lines = lambda: sorted(json.loads(x)["line"] for p in out.glob("part-*") for x in p.read_text().splitlines())
    once()
    assert lines() == ["HELLO", "LINE1", "LINE2", "LINE3", "WORLD"]
    with (src / "file1").open("a") as f:
        f.write("line4\nline5\n")
    once()
    assert lines() == ["HELLO", "LINE1", "LINE2", "LINE3", "LINE4", "LINE5", "WORLD"]
    write(spark.createDataFrame([("file1", "AGAIN")], "file string, line string"), 99)
    write(spark.createDataFrame([("file1", "AGAIN")], "file string, line string"), 99)
    assert lines().count("AGAIN") == 1


def test_sinks(spark, tmp_path):
    df = spark.range(0, 200, 1, 4).select(F.col("id").alias("value"))
    got = sinks.rotating_files(df, str(tmp_path / "rot"), "r1").collect()
    assert sum(r["lines"] for r in got) == 200 and max(r["lines"] for r in got) <= 20 and len({r["file"].split("-worker-")[1].split("-")[0] for r in got}) == 4
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "rot").glob("output-*")) == 200
    assert sinks.single_file(df, str(tmp_path / "one.jsonl"), ["value"]) == 200
    assert (tmp_path / "one.jsonl").read_text().splitlines()[0] == '{"value":0}'
    sinks.sqlite_table(df.where("value % 10 <> 3"), str(tmp_path / "o.db"), "m")
    with sqlite3.connect(str(tmp_path / "o.db")) as db:
        assert db.execute("select count(*) from m").fetchone()[0] == 180
    kept = {}
    sinks.fan_out({n: (p, lambda d, i, n=n: kept.__setitem__(n, d.count())) for n, p in {"low": F.col("value") < 50, "high": F.col("value") >= 50}.items()})(df, 0)
    assert kept == {"low": 50, "high": 150}


def test_small_sinks(spark, tmp_path, capsys):
    df = spark.range(5).coalesce(1)
    assert sinks.stdout_lines(df) == 5 and capsys.readouterr().out.splitlines()[0] == '{"id":0}'
    held = []
    sinks.memory_rows(held)(df, 0)
    sinks.directory(df, str(tmp_path / "dir"), 2)
    assert len(held) == 5 and len(list((tmp_path / "dir").glob("part-*"))) == 3


def test_written_tables_are_dropped_and_others_are_not(spark, tmp_path):
    from tributary import storage

    mine = storage.written(spark.range(5), "probe")
    other = tmp_path / "tributary" / "data"
    spark.range(5).write.parquet(str(other))
    theirs = spark.read.parquet(str(other))
    folder = mine.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert storage.mounted(spark, "x").startswith("/") and mine.count() == 5
    storage.drop(mine, theirs)
    import os

    assert not os.path.exists(folder) and theirs.count() == 5
