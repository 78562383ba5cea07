"""Queries of sources and sinks: rows are written through a sink to the shared folder and come back through a source."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import connectors, files, sinks
from ..storage import mounted
from .base import events, query, table

_ORDERS = "select o_orderkey, o_custkey, o_orderstatus from orders"
_EVENTS = "select event_id, user_id, event_type from events"
_KIND = "event_id long, user_id long, event_type string"


def _events(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "event_type")


def _parsed(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.select(F.from_json(column, _KIND).alias("x")).select("x.*")


def _folder(spark, tag: str) -> str:
    path = mounted(spark, tag)
    os.makedirs(path, exist_ok=True)
    return path


# ---- files ----


@query(_EVENTS)
def source_lines(spark, sf_dir):
    """A directory of JSON lines, one file per partition, read line by line."""
    path = mounted(spark, "lines")
    sinks.directory(_events(spark, sf_dir).repartition(3), path)
    return _parsed(files.lines(spark, path))


@query(_EVENTS)
def source_json_lines(spark, sf_dir):
    """The same through the JSON reader; files end after 500 rows."""
    path = mounted(spark, "json")
    sinks.directory(_events(spark, sf_dir), path, rows_per_file=500)
    return files.json_lines(spark, path, _KIND).select("event_id", "user_id", "event_type")


@query("select row_number() over (order by n_nationkey) - 1 as seq, n_name as line from nation")
def source_numbered_lines(spark, sf_dir):
    """One file written row by row, and read with its line numbers."""
    path = os.path.join(_folder(spark, "numbered"), "nation.jsonl")
    sinks.single_file(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, ["n_nationkey"])
    return files.numbered_lines(spark, path).select(F.col("seq").cast("long").alias("seq"), F.get_json_object("line", "$.n_name").alias("line"))


@query("select 'named' as kind, n_nationkey, n_name from nation union all select 'bare', n_nationkey, n_name from nation")
def source_csv(spark, sf_dir):
    """CSV with and without a header line."""
    rows, out = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), []
    for kind, header in (("named", True), ("bare", False)):
        path = mounted(spark, f"csv-{kind}")
        rows.write.csv(path, header=header)
        out.append(files.csv_rows(spark, path, "n_nationkey long, n_name string", header=header).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name"))
    return out[0].unionByName(out[1])


@query("select r_regionkey, r_name, upper(r_name) as shown from region")
def source_json_array(spark, sf_dir):
    """A file that is one JSON array, joined with one that is a JSON object of names."""
    rows, folder = table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect(), _folder(spark, "arrays")  # five rows
    with open(os.path.join(folder, "array.json"), "w") as f:
        json.dump([r.asDict() for r in rows], f)
    with open(os.path.join(folder, "lookup.json"), "w") as f:
        json.dump({r["r_name"]: {"shown": r["r_name"].upper()} for r in rows}, f)
    array = files.json_array(spark, os.path.join(folder, "array.json"), "r_regionkey long, r_name string")
    names = files.json_lookup(spark, os.path.join(folder, "lookup.json"), "shown string", "name")
    return array.join(names, F.col("r_name") == F.col("name")).select("r_regionkey", "r_name", "shown")


@query("select n_nationkey as x, n_name as name from nation")
def source_rows(spark, sf_dir):
    """Rows that are given in memory."""
    held: list = []
    sinks.memory_rows(held)(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), 0)
    return files.rows(spark, [tuple(r) for r in held], "x long, name string")


# ---- connectors ----


@query("select s_suppkey, s_name from supplier")
def source_sqlite(spark, sf_dir):
    """A SQLite table, inserted in batches of ten and read page by page."""
    connectors.register(spark)
    path = os.path.join(_folder(spark, "sqlite"), "supplier.db")
    sinks.sqlite_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").orderBy("s_suppkey"), path, "supplier")
    return spark.read.format("sqlite_pages").options(path=path, table="supplier", schema="s_suppkey long, s_name string").load()


@query("select n_name as line, cast((row_number() over (order by n_nationkey) - 1) % 3 as int) as part from nation")
def source_dealt_lines(spark, sf_dir):
    """Line i of a file belongs to partition i mod 3."""
    connectors.register(spark)
    path = os.path.join(_folder(spark, "dealt"), "nation.jsonl")
    sinks.single_file(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, ["n_nationkey"])
    dealt = spark.read.format("dealt_lines").options(path=path, parts=3).load()
    return dealt.select(F.get_json_object("line", "$.n_name").alias("line"), "part")


@query(f"select * from ({_EVENTS}) order by event_id")
def source_worker_files(spark, sf_dir):
    """Worker i of 3 reads files[i::3] through a background thread; the files come from the rotating sink."""
    connectors.register(spark)
    path = mounted(spark, "rotated")
    sinks.rotating_files(_events(spark, sf_dir), path, "run", rows=200)
    return _parsed(spark.read.format("worker_files").options(path=path, workers=3).load().select("line"))


@query("""select 'first' as state, count(*) as lines from events where event_id % 2 = 0 union all select 'second', count(*) from events where event_id % 2 = 1""")
def source_resumable(spark, sf_dir):
    """A stream over growing files: what came in the second run is what the first had not read; a torn last line waits."""
    from ..streaming import twins

    connectors.register(spark)
    folder, ck = _folder(spark, "growing"), _folder(spark, "growing-ck")
    rows, seen = _events(spark, sf_dir), {}
    path = os.path.join(folder, "events.jsonl")
    for name, rest in (("first", 0), ("second", 1)):
        sinks.single_file(rows.where(F.col("event_id") % 2 == rest), f"{path}.{name}.tmp", ["event_id"])
        with open(f"{path}.{name}.tmp") as new, open(path, "a") as f:
            f.write(new.read())  # a few thousand lines of a test file
            f.write('{"torn": ' if name == "first" else "")
        os.remove(f"{path}.{name}.tmp")
        stream = spark.readStream.format("resumable_files").option("path", folder).load()
        twins.run_once(stream, ck, lambda df, batch, name=name: seen.update({name: seen.get(name, 0) + df.count()}), mode="append")
        if name == "first":
            os.truncate(path, os.path.getsize(path) - len('{"torn": '))
    return spark.createDataFrame([(k, n) for k, n in seen.items()], "state string, lines long")


# ---- sinks ----


@query("select count(*) as lines, cast(ceil(count(*) / 20.0) as bigint) as files from orders")
def sink_rotating(spark, sf_dir):
    """Files of at most 20 lines from one worker."""
    path = mounted(spark, "rotating")
    out = sinks.rotating_files(table(spark, sf_dir, "orders").select("o_orderkey").coalesce(1), path, "r")
    read = spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))
    return read.crossJoin(out.agg(F.countDistinct("file").alias("files")))  # one row each


@query("select user_id, count(*) as n, 1::bigint as files from events group by user_id")
def sink_keyed(spark, sf_dir):
    """Parts by key; a batch that is written twice stays once, and a key's rows are in one part."""
    path = mounted(spark, "keyed")
    write = sinks.keyed_files(path, "user_id", 4)
    rows = _events(spark, sf_dir)
    for batch, rest in ((0, 0), (1, 1), (1, 1)):
        write(rows.where(F.col("event_id") % 2 == rest), batch)
    read = spark.read.text([os.path.join(path, f"part-{p}") for p in range(4)]).select(F.from_json("value", _KIND).alias("x"), F.input_file_name().alias("file"))
    return read.groupBy(F.col("x.user_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"))


@query("""select 'high' as side, event_id from events where value > 50 union all select 'low', event_id from events where not coalesce(value > 50, false)""")
def sink_fan_out(spark, sf_dir):
    """One batch to several writers."""
    path = mounted(spark, "fan")
    to = lambda name: lambda df, batch: df.select("event_id").write.parquet(f"{path}/{name}")
    high = F.col("value") > 50
    sinks.fan_out({"high": (high, to("high")), "low": (~F.coalesce(high, F.lit(False)), to("low"))})(events(spark, sf_dir), 0)
    return spark.read.parquet(f"{path}/high").select(F.lit("high").alias("side"), "event_id").unionByName(spark.read.parquet(f"{path}/low").select(F.lit("low").alias("side"), "event_id"))


@query("select count(*) as printed from region")
def sink_stdout(spark, sf_dir):
    """Rows printed as JSON lines."""
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        sinks.stdout_lines(table(spark, sf_dir, "region"))
    return spark.createDataFrame([(len(text.getvalue().splitlines()),)], "printed long")


@query(f"select * from ({_ORDERS})")
def sink_single_file(spark, sf_dir):
    """All rows in one named file, which appears when it is complete."""
    path = os.path.join(_folder(spark, "single"), "orders.jsonl")
    sinks.single_file(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path)
    return files.json_lines(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string").select("o_orderkey", "o_custkey", "o_orderstatus")
