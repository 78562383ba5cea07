"""Event-time windows over bounded input: every window is emitted, open ones too."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import records


def tumbling(df: DataFrame, keys: list[str], ts: str, length: str, *aggregates: Column, start: str | None = None) -> DataFrame:
    """Aggregates per key and window; ``start`` shifts the alignment."""
    w = F.window(ts, length, length, start) if start else F.window(ts, length)
    return df.groupBy(*keys, w.alias("window")).agg(*aggregates).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[_name(df, a) for a in aggregates])


def sliding(df: DataFrame, keys: list[str], ts: str, length: str, step: str, *aggregates: Column) -> DataFrame:
    """Aggregates per key and overlapping window; partial aggregation precedes the shuffle."""
    return df.groupBy(*keys, F.window(ts, length, step).alias("window")).agg(*aggregates).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[_name(df, a) for a in aggregates])


def _name(df: DataFrame, c: Column) -> str:
    return df.groupBy().agg(c).columns[0]


def ohlcv(df: DataFrame, symbol: str, ts: str, price: str, volume: str, order: list[str], length: str) -> DataFrame:
    """Open, high, low, close and volume; the later of two rows at one time is the later price."""
    at = F.struct(*order)
    return tumbling(df, [symbol], ts, length, F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"))


def window_id(start: Column, length_seconds: int, align: str = "1970-01-01 00:00:00") -> Column:
    """Number of the window, counted from ``align``."""
    return F.floor((F.unix_timestamp(start.cast("timestamp")) - F.unix_timestamp(F.lit(align))) / length_seconds).cast("long")


def outliers(df: DataFrame, keys: list[str], ts: str, value: str, length: str, step: str, sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` population deviations from the mean of a window they are in.

    Statistics are aggregated by key and window, with partial sums before the
    shuffle, and joined back, so a window that most rows share is no task's own.
    """
    names = [f"_{k}" for k in keys]
    stats = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.window(ts, length, step).alias("_window")).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    seen = df.withColumn("window", F.window(ts, length, step))
    same = F.col("window.start") == F.col("_window.start")
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    far = (F.col("deviation") > 0) & (F.abs(F.col(value) - F.col("mean")) > sigmas * F.col("deviation"))
    return seen.join(stats.where("deviation > 0"), same).where(far).withColumn("window_start", F.col("window.start")).drop("window", "_window", *names)


def sessions(df: DataFrame, key: str, ts: str, gap: str, *aggregates: Column) -> DataFrame:
    """Sessions per key: a gap of more than ``gap`` separates them; ``session_end`` is the last event."""
    out = df.groupBy(key, F.session_window(ts, gap).alias("_s")).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("events"), *aggregates)
    return out.drop("_s")


def fold_window(df: DataFrame, key: str, ts: str, order: list[str], builder: Callable[[], Any], folder: Callable[[Any, dict], Any], merger: Callable[[Any, Any], Any], finish: Callable[[Any, float, float, Any], dict], schema: str, length: float | None = None, gap: float | None = None, split: float = 3600) -> DataFrame:
    """Opaque fold per key and window: tumbling ones of ``length`` seconds, or sessions that ``gap`` seconds end.

    ``builder()`` makes a state, ``folder(state, row)`` adds a row, in ``order``,
    ``merger(state, later state)`` joins two, ``finish(key, start, end, state)``
    gives the row of a window; a session ends with its last row.  A key's rows
    are folded by stretches of ``split`` seconds, each a task's own, and the
    states are merged in order: neither rows nor memory of a hot key meet in one
    task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    kind = df.schema[key].dataType.simpleString()
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = df.withColumns({"_t": at, "_w": F.floor(at / length) * float(length) if length else F.lit(0.0), "_b": F.floor(at / split)})

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = None, None  # part: start, end, state
        for b in batches:
            out = []
            for row in records(b):
                here = (row[key], row["_w"], row["_b"])
                if part and (here != name or gap is not None and row["_t"] - part[1] > gap):
                    out.append((*name[:2], *part[:2], pickle.dumps(part[2])))
                    part = None
                name = here
                part = part or [row["_t"], row["_t"], builder()]
                part[1], part[2] = row["_t"], folder(part[2], row)
            yield batch(out, b.schema)
        if part:
            yield batch([(*name[:2], *part[:2], pickle.dumps(part[2]))], b.schema)

    def batch(out: list[tuple], seen: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [seen.field(key).type, pa.float64(), pa.float64(), pa.float64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "w", "first", "last", "state"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part = None, None

        def close() -> dict:
            start, end = (name[1], name[1] + length) if length else part[:2]
            return finish(name[0], start, end, part[2])

        for b in batches:
            out = []
            for row in b.to_pylist():
                here, state = (row["key"], row["w"]), pickle.loads(row["state"])  # noqa: S301
                if part and (here != name or gap is not None and row["first"] - part[1] > gap):
                    out.append(close())
                    part = None
                part = [part[0], row["last"], merger(part[2], state)] if part else [row["first"], row["last"], state]
                name = here
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if part:
            yield pa.RecordBatch.from_pylist([close()], schema=arrow)

    parts = rows.repartition(key, "_w", "_b").sortWithinPartitions(key, "_w", "_b", *order).mapInArrow(stretches, f"key {kind}, w double, first double, last double, state binary")
    return parts.repartition("key", "w").sortWithinPartitions("key", "w", "first").mapInArrow(merged, schema)
