"""Custom sources as Python data sources: paged SQLite, dealt lines, files by worker, resumable directories."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader


class Part(InputPartition):
    def __init__(self, index: int, of: int):
        self.index, self.of = index, of


class Span(InputPartition):
    """Bytes ``start`` to ``end`` of one file, which are whole lines."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def _pages(path: str, table: str, columns: list[str], after: int, page: int) -> Iterator[list[tuple]]:
    """Pages of a table in order of its first column, an increasing id."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        while True:
            got = db.execute(f"SELECT {', '.join(columns)} FROM {table} WHERE {columns[0]} > ? ORDER BY {columns[0]} LIMIT ?", (after, page)).fetchall()  # noqa: S608
            if not got:
                return
            yield got
            after = got[-1][0]


class SqliteSource(DataSource):
    """``sqlite_pages``: options path, table, schema, page (5); the first column is the id and the offset."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_pages"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, schema.names)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return SqliteStream(self.options, schema.names)


class SqliteReader(DataSourceReader):
    def __init__(self, options, names):
        self.path, self.table, self.page, self.names = options["path"], options["table"], int(options.get("page", 5)), list(names)

    def partitions(self):
        return [Part(0, 1)]

    def read(self, partition):
        for page in _pages(self.path, self.table, self.names, -(1 << 63), self.page):
            yield from page


class SqliteStream(SimpleDataSourceStreamReader):
    """A micro-batch is one page; the offset is the last id read."""

    def __init__(self, options, names):
        self.path, self.table, self.page, self.names = options["path"], options["table"], int(options.get("page", 5)), list(names)

    def initialOffset(self) -> dict:
        return {"id": -(1 << 62)}

    def read(self, start: dict):
        got = next(_pages(self.path, self.table, self.names, start["id"], self.page), [])
        return iter(got), {"id": got[-1][0]} if got else start

    def readBetweenOffsets(self, start: dict, end: dict):
        for page in _pages(self.path, self.table, self.names, start["id"], self.page):
            for row in page:
                if row[0] > end["id"]:
                    return
                yield row


class DealtLines(DataSource):
    """``dealt_lines``: options path, parts (3); line i of a file belongs to partition i mod parts."""

    @classmethod
    def name(cls) -> str:
        return "dealt_lines"

    def schema(self) -> str:
        return "seq long, line string, part int"

    def reader(self, schema) -> DataSourceReader:
        return DealtReader(self.options)


class DealtReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("parts", 3))

    def partitions(self):
        return [Part(i, self.parts) for i in range(self.parts)]

    def read(self, partition):
        with open(self.path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if i % partition.of == partition.index:
                    yield i, line.rstrip("\n"), partition.index


class WorkerFiles(DataSource):
    """``worker_files``: options path, workers; worker i reads files[i::workers] through a background thread and a bounded queue."""

    @classmethod
    def name(cls) -> str:
        return "worker_files"

    def schema(self) -> str:
        return "file string, line string, worker int"

    def reader(self, schema) -> DataSourceReader:
        return WorkerFilesReader(self.options)


class WorkerFilesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.workers = options["path"], int(options.get("workers", 2))

    def partitions(self):
        return [Part(i, self.workers) for i in range(self.workers)]

    def read(self, partition):
        import queue
        import threading

        mine = sorted(os.listdir(self.path))[partition.index :: partition.of]
        ready: queue.Queue = queue.Queue(maxsize=1000)

        def fill() -> None:
            try:
                for name in mine:
                    with open(os.path.join(self.path, name), encoding="utf-8") as f:
                        for line in f:
                            ready.put((name, line.rstrip("\n"), partition.index))
                ready.put(None)
            except Exception as e:  # handed to the reading thread
                ready.put(e)

        threading.Thread(target=fill, daemon=True).start()
        while (item := ready.get()) is not None:
            if isinstance(item, Exception):
                raise item
            yield item


class ResumableFiles(DataSource):
    """``resumable_files``: option path; a stream of (file, line) whose offset is the bytes read of every file.

    A last line without its line feed is still being written: it waits for the
    trigger that finds it complete.
    """

    @classmethod
    def name(cls) -> str:
        return "resumable_files"

    def schema(self) -> str:
        return "file string, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ResumableReader(self.options)


def _whole_lines(path: str, size: int, block: int = 1 << 16) -> int:
    """Bytes up to the last line feed within the first ``size`` of a file, found from its end."""
    with open(path, "rb") as f:
        while size > 0:
            lo = max(0, size - block)
            f.seek(lo)
            at = f.read(size - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            size = lo
    return 0


class ResumableReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.known: dict[str, tuple[int, int]] = {}  # size and whole lines of each file when it was last looked at

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name in sorted(os.listdir(self.path)):
            path = os.path.join(self.path, name)
            size = os.path.getsize(path)
            if self.known.get(name, (-1,))[0] != size:
                self.known[name] = (size, _whole_lines(path, size))
        return {name: lines for name, (_, lines) in sorted(self.known.items()) if lines}

    def partitions(self, start: dict, end: dict):
        return [Span(n, start.get(n, 0), k) for n, k in end.items() if k > start.get(n, 0)]

    def read(self, partition):
        with open(os.path.join(self.path, partition.file), "rb") as f:
            f.seek(partition.start)
            left = partition.end - partition.start
            while left > 0:
                line = f.readline()
                left -= len(line)
                yield partition.file, line.decode("utf-8").rstrip("\r\n")

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay, and the engine logs offsets."""


def register(spark: SparkSession) -> None:
    for source in (SqliteSource, DealtLines, WorkerFiles, ResumableFiles):
        spark.dataSource.register(source)


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str):
    """A topic as (key, value, ts) text; needs Spark's Kafka connector on the class path."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts"))
