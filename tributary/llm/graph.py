"""Connected components by contraction; nothing but counts comes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved, tidy

#: Links that one task contracts.
PART = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) by union-find over these links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(nodes)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def contracted(links: DataFrame, parts: int) -> DataFrame:
    """(node, component) of the links of each of ``parts`` tasks by themselves, ``PART`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            found = forest(*(np.concatenate([h.column(k).to_numpy() for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) > 2 * PART:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return links.select("a", "b").coalesce(parts).mapInArrow(tidy(run), "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b), written before -> node, component: the smallest node reachable.  Unlinked nodes have no row.

    Every task first contracts its own links, ``PART`` of them, to stars.  Where
    there were several tasks, rounds follow: each maps every node to the first of
    its neighbours and itself and contracts the links, until none is left.  The
    first two rounds order nodes by themselves, which settles stars; later ones
    by a hash that differs each round, so that an expected share of the nodes
    goes whatever their labels, and a component of n nodes takes O(log n) rounds.
    Components are then named by their smallest node.  Hubs with many links are
    pre-aggregated and their joins split by adaptive execution.
    """
    n = 1 + links.count()  # no table here has more rows than twice that
    parts = -(-n // PART)
    stars = saved(contracted(links, parts), "cc-stars", n)
    if parts == 1:
        return stars
    both = lambda d: d.select("a", "b").union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = saved(stars.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).distinct(), "cc-links", n)
    found = saved(stars.select("node", F.col("node").alias("component")).distinct(), "cc-found", n)
    rounds = 0
    while left.head(1):
        ranked = lambda c, k=rounds: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x")) if k >= 2 else F.col(c)
        first = F.least(ranked("a"), "m")["x"] if rounds >= 2 else F.least("a", "m")
        hook = saved(both(left).groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("n"), first.alias("m")), "cc-hook", n)
        ha, hb = hook.select(F.col("n").alias("a"), F.col("m").alias("x")), hook.select(F.col("n").alias("b"), F.col("m").alias("y"))
        fresh = left.join(ha, "a").join(hb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        fresh = saved(fresh, "cc-links", n)
        named = saved(found.join(hook, found.component == hook.n, "left").select("node", F.coalesce("m", "component").alias("component")), "cc-found", n)
        drop_saved(left, found, hook)
        left, found = fresh, named
        rounds += 1
    drop_saved(left, stars)
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    named = saved(found.join(names, "component").select("node", F.col("least").alias("component")), "cc-found", n)
    drop_saved(found)
    return named
