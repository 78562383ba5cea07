"""Projections, filters, routing and re-keying."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; unknown counts as false."""
    return df.where(F.coalesce(predicate, F.lit(False)))


def filter_map(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop rows where it is null."""
    return df.withColumn(name, value).where(F.col(name).isNotNull())


def flat_map(df: DataFrame, name: str, items: Column) -> DataFrame:
    """One row per element of an array; empty and null arrays give none."""
    return df.withColumn(name, F.explode(items))


def key_on(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys are strings, so that 1 and "1" meet."""
    return df.withColumn(name, key.cast("string"))


def key_rm(df: DataFrame, name: str = "key") -> DataFrame:
    return df.drop(name)


def branch(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(trues, falses); every row is in one of them."""
    p = F.coalesce(predicate, F.lit(False))
    return df.where(p), df.where(~p)


def route(df: DataFrame, field: Column, names: list[str], otherwise: str, name: str = "route") -> DataFrame:
    """Mark each row with the route its field names; unknown and missing go to ``otherwise``."""
    return df.withColumn(name, F.when(field.isin(names), field).otherwise(F.lit(otherwise)))


def dead_letter(df: DataFrame, raw: Column, required: str) -> DataFrame:
    """Add ``error``: why a raw JSON line cannot be used, or null."""
    from ..functions.scalar import is_json

    missing = F.get_json_object(raw, f"$.{required}").isNull()
    return df.withColumn("error", F.when(~is_json(raw) | raw.isNull(), F.lit("invalid json")).when(missing, F.lit(f"missing {required}")))


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all, by column name; missing columns are null."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def redistribute(df: DataFrame, partitions: int) -> DataFrame:
    """Spread rows evenly over partitions."""
    return df.repartition(partitions)


def inspect(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Observe metrics while rows pass; the plan stays as it is."""
    return df.observe(name, *[c.alias(k) for k, c in metrics.items()])


def fan_out(df: DataFrame, routes: Mapping[str, Column], write: Callable[[str, DataFrame], None]) -> None:
    """Write the rows of each route; the parent is computed once."""
    df = df.persist()
    try:
        for name, predicate in routes.items():
            write(name, keep(df, predicate))
    finally:
        df.unpersist()


def with_ingest_time(df: DataFrame, name: str = "ingested") -> DataFrame:
    """System clock: the time at which the batch or micro-batch runs."""
    return df.withColumn(name, F.current_timestamp())
