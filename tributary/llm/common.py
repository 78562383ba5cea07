"""Helpers shared by the operators: durable intermediate tables and table reading."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop as drop_saved
from ..storage import run_dir

#: A word: a maximal run of characters other than space, tab, line feed,
#: vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch while intermediate tables are made.
BATCH_ROWS = 2000
#: Tasks a core that write a small table; rows of a task where their number is known.
TASKS, TASK_ROWS = 2, 200_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of fewer rows while an action runs: a task's memory is then a few MB, long texts or not."""
    old = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(old or BATCH_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old) if old else spark.conf.unset(_BATCH)


def saved(df: DataFrame, tag: str, few: bool | int = False, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage durably: lost executors never force the upstream plan to
    run again, and what was computed once (random-looking partition numbers
    included) stays as it is.  Parquet keeps real sizes for the planner, so a
    later join broadcasts only what is measured to be small.  Tables that are
    much smaller than the texts (``few``) are written by fewer tasks, as every
    file costs the store a few calls: ``TASKS`` a core, more as partitions grow,
    and no more than a known number of rows (``few`` itself) calls for.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if few:
        most = max(TASKS * spark.sparkContext.defaultParallelism, partitions(spark) // 8)
        df = df.coalesce(most if few is True else min(most, 1 + few // TASK_ROWS))
    with small_batches(spark):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """``run`` over record batches; when a task ends its worker, which stays, gives its memory back."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text, modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keep_matching(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs``, all columns, joined on doc_id with the only column of ``ids`` (left_semi or left_anti).

    Rows travel as one struct, so no column name of ``docs`` can clash.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(ids.toDF("id"), F.col("row.doc_id").eqNullSafe(F.col("id")), how).select("row.*")


def plain_ids(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` (doc_id) has an id, as a number, and none repeats."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("id is null or rows > 1").isEmpty()


def keyed(docs: DataFrame, tag: str) -> DataFrame:
    """(key, row): rows, as structs, under a number of their own; saved, so that it stays."""
    return saved(docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*docs.columns).alias("row")), tag)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
