"""Aggregations that end with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_stage_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum per key, then of all keys: one row."""
    return df.groupBy(key).agg(F.sum(value).alias("subtotal")).agg(F.sum("subtotal").alias("total"))


def statistics(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """count, min, max, sum, first, last, mean and population deviation per key."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"),
        F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"),
    )


def apdex(latency: Column, satisfied: float = 500, tolerated: float = 2000) -> Column:
    """Share of satisfied requests plus half of the tolerated ones."""
    return (F.sum(F.when(latency <= satisfied, 1.0).when(latency <= tolerated, 0.5).otherwise(0.0))) / F.count(latency)


def leaderboard(df: DataFrame, keys: list[str], passed: Column, latency: Column) -> DataFrame:
    """Trials, passes, success rate in percent and mean latency over known, non-zero latencies."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.sum(passed.cast("int")).alias("passes"), F.avg(F.when(latency != 0, latency)).alias("latency"))
    return out.withColumn("rate", F.round(100 * F.col("passes") / F.col("trials")).cast("int"))


def top_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys of the largest maximum; ties by key."""
    return df.groupBy(key).agg(F.max(value).alias("score")).orderBy(F.desc("score"), F.asc(key)).limit(k)


def collected(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Ordered list of a value per key."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: x["_v"]).alias("items"))


def running(df: DataFrame, key: str, order: list[str], **columns: tuple[str, str]) -> DataFrame:
    """Running aggregates per key in order: name=(function, column)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: getattr(F, f)(c).over(w) for name, (f, c) in columns.items()})


def moving_average(df: DataFrame, key: str, order: list[str], value: str, size: int = 3) -> DataFrame:
    """Mean of the last ``size`` values per key, fewer at the start."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    return df.withColumn("average", F.avg(value).over(w))


def batches(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Number the batches of ``size`` rows that each key's rows fill in order; the last may be short."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def latest_setting(df: DataFrame, key: str, order: list[str], setting: Column, default: float) -> DataFrame:
    """Add ``setting``: the latest non-null setting at or before each row of the key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("setting", F.coalesce(F.last(setting, ignorenulls=True).over(w), F.lit(default)))
