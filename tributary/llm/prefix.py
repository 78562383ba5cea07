"""Distributed running sums over a total order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved


def ranged_prefix(df: DataFrame, order: list[Column], sums: dict[str, str], within: str | None, tag: str) -> DataFrame:
    """Add exclusive running sums of columns in ``order``.

    ``sums`` maps each new column to the column it sums; ``within`` restarts
    the sums at each value of that column, which must lead ``order``.  Rows are
    range-partitioned by ``order``; each range is summed by a window of its
    own, and a table with one row per range (and value of ``within``) carries
    the offsets.  A value that holds most rows spans many ranges, so no task
    grows with it.  Ties of the whole order are interchangeable rows.
    """
    parts = saved(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), f"{tag}-ranged", True)
    group = ["_pid"] + ([within] if within else [])
    totals = parts.groupBy(*group).agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    before = (Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(totals.select(*group, *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums]), f"{tag}-offsets", True)
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_loc_{k}") for k, c in sums.items()])
    o = offsets.select(*[F.col(c).alias(f"_o{c}") for c in group], *[f"_off_{k}" for k in sums])
    same = F.col("_pid") == F.col("_o_pid")
    if within:
        same &= F.col(within).eqNullSafe(F.col(f"_o{within}"))
    return local.join(o, same).select(*[F.col(c) for c in df.columns], *[(F.col(f"_loc_{k}") + F.col(f"_off_{k}")).alias(k) for k in sums])
