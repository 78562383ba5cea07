"""Keyed joins: latest value per side, several sides, static lookups, windows and time ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(best.alias("_last")).select(key, "_last.*")


def join_complete(sides: list[tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """Inner join of the latest row per key of every side (side, its order columns)."""
    return reduce(lambda a, b: a.join(b, key), [latest(df, key, order) for df, order in sides])


def enrich(stream: DataFrame, lookup: DataFrame, on: Column | list[str]) -> DataFrame:
    """Inner join with a lookup table; unmatched rows are dropped.

    No hint: the planner broadcasts the lookup if its measured size allows it
    and falls back to a shuffled join, split where a key is hot.
    """
    return stream.join(lookup, on, "inner")


def join_window(left: DataFrame, right: DataFrame, key: str, ts: str, length: str) -> DataFrame:
    """Pairs of the same key and tumbling window."""
    w = F.window(ts, length)
    a = left.withColumn("window", w)
    b = right.withColumn("window", w).withColumnRenamed(ts, f"right_{ts}")
    return a.join(b, [key, "window"])


def join_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, timeout: str) -> DataFrame:
    """Pairs of a key whose right time follows the left one within ``timeout``.

    Times are cut into buckets of the timeout's length and joined on key and
    bucket, so a hot key spreads over its buckets.
    """
    bucket = lambda c: F.window(c, timeout).start
    a = left.withColumn("_bucket", F.explode(F.array(bucket(left_ts), bucket(left_ts) + F.expr(f"interval {timeout}"))))
    b = right.withColumn("_bucket", bucket(right_ts))
    ok = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {timeout}"))
    return a.join(b, [key, "_bucket"]).where(ok).drop("_bucket")
