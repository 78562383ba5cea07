"""Sinks: one named file, rotating files, SQLite, keyed partitions that survive a rerun, fan-out."""

from __future__ import annotations

import os
import shutil
import sqlite3
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_line(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns)).alias("value")


def single_file(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """Write a bounded result as one file of JSON lines, row by row through the driver; rows written."""
    if order:
        df = df.orderBy(*order)
    tmp, n = f"{path}.part", 0
    with open(tmp, "w", encoding="utf-8") as f:
        for row in df.select(F.to_json(F.struct(*df.columns)).alias("value")).toLocalIterator():
            f.write(row["value"] + "\n")
            n += 1
    os.replace(tmp, path)
    return n


def rotating_files(df: DataFrame, directory: str, run: str, rows: int = 20) -> DataFrame:
    """Every task writes files of at most ``rows`` lines: output-<run>-worker-<i>-part-<n>; (file, lines) written.

    A file appears under its name only when it is complete; a repeated task
    writes the same names again.
    """
    os.makedirs(directory, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, part, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal part
            name = f"output-{run}-worker-{worker}-part-{part}"
            tmp = os.path.join(directory, f".{name}.{TaskContext.get().taskAttemptId()}")
            with open(tmp, "w", encoding="utf-8") as f:
                f.writelines(x + "\n" for x in held)
            os.replace(tmp, os.path.join(directory, name))
            part += 1
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_pydict({"file": [name], "lines": [n]}, schema=pa.schema([("file", pa.string()), ("lines", pa.int64())]))

        for b in batches:
            for value in b.column(0).to_pylist():
                held.append(value)
                if len(held) == rows:
                    yield flush()
        if held:
            yield flush()

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return df.sparkSession.createDataFrame(lines.mapInArrow(write, "file string, lines long").collect(), "file string, lines long")


def sqlite_table(df: DataFrame, path: str, table: str, batch: int = 10) -> None:
    """Bulk insert through one writer; the table is created first, rows go in by ``executemany``."""
    names = ", ".join(df.columns)
    marks = ", ".join("?" * len(df.columns))
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {table} ({names})")
        held: list[tuple] = []
        for row in df.toLocalIterator():
            held.append(tuple(row))
            if len(held) == batch:
                db.executemany(f"INSERT INTO {table} VALUES ({marks})", held)  # noqa: S608
                held = []
        if held:
            db.executemany(f"INSERT INTO {table} VALUES ({marks})", held)  # noqa: S608


def part_of(key: str, parts: int) -> int:
    return zlib.adler32(key.encode()) % parts


def keyed_files(directory: str, key: str, parts: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink with one file per part; a batch that is run again replaces its own lines.

    Tasks write each part's lines of a batch to a file of that part and batch,
    in the order of the rows; these are then appended to the parts.  Each part
    keeps a log of (batch, length before it), so a rerun truncates the file to
    that length first.  The directory must be mounted where tasks run.
    """
    os.makedirs(directory, exist_ok=True)

    def write(df: DataFrame, batch: int) -> None:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = [part_of(k, parts) for k in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0), b.column(2)], ["part", "turn", "line"])

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, f, done = None, None, []

            def close() -> None:
                f.close()
                os.replace(f.name, _segment(directory, at, batch))
                done.append(at)

            for b in batches:
                for p, line in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                    if p != at:
                        if f:
                            close()
                        at = p
                        f = open(f"{_segment(directory, p, batch)}.{TaskContext.get().taskAttemptId()}", "w", encoding="utf-8")  # noqa: SIM115
                    f.write(line + "\n")
            if f:
                close()
            yield pa.RecordBatch.from_pydict({"part": done}, schema=pa.schema([("part", pa.int32())]))

        rows = df.select(F.monotonically_increasing_id().alias("turn"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.to_json(F.struct(*df.columns)).alias("v"))
        dealt = rows.mapInArrow(deal, "part int, turn long, line string").repartition("part").sortWithinPartitions("part", "turn")
        written = {r["part"] for r in dealt.mapInArrow(store, "part int").collect()}  # at most one number per part
        for p in range(parts):
            path, log = os.path.join(directory, f"part-{p}"), os.path.join(directory, f".part-{p}.log")
            seen = dict(map(int, x.split()) for x in open(log)) if os.path.exists(log) else {}
            size = seen.get(batch, os.path.getsize(path) if os.path.exists(path) else 0)
            with open(log, "a") as f:
                f.write(f"{batch} {size}\n")
            with open(path, "ab") as f:
                f.truncate(size)
                if p in written:
                    with open(_segment(directory, p, batch), "rb") as own:
                        shutil.copyfileobj(own, f)
            if p in written:
                os.remove(_segment(directory, p, batch))

    return write


def _segment(directory: str, part: int, batch: int) -> str:
    return os.path.join(directory, f".part-{part}.batch-{batch}")


def fan_out(writers: dict[str, tuple[Column, Callable[[DataFrame, int], None]]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that sends rows to several writers, computing the batch once."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for predicate, writer in writers.values():
                writer(df.where(F.coalesce(predicate, F.lit(False))), batch)
        finally:
            df.unpersist()

    return write


def stdout_lines(df: DataFrame) -> int:
    """Print rows as JSON lines, one at a time; rows printed."""
    n = 0
    for row in df.select(F.to_json(F.struct(*df.columns)).alias("value")).toLocalIterator():
        print(row["value"])
        n += 1
    return n


def memory_rows(held: list) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends rows to a list, for tests."""
    return lambda df, batch: held.extend(df.collect())


def directory(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """JSON lines in a directory, one file per partition, or more where ``rows_per_file`` says so."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)
