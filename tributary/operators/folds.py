"""Sequential folds per key, for state that depends on its own earlier decisions.

``keyed_fold`` brings a key's rows to one task in order and passes state from
row to row, across Arrow batches; memory holds one state per task, however
many rows a key has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, written

Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def records(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; numbers without nulls are converted a column at a time."""
    plain = lambda c: c.null_count == 0 and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
    values = [c.to_numpy().tolist() if plain(c) else c.to_pylist() for c in b.columns]
    return (dict(zip(b.schema.names, row, strict=True)) for row in zip(*values, strict=True))


def keyed_fold(df: DataFrame, key: str | None, order: list[str], step: Step, schema: str, end: Callable[[Any, Any], list[dict]] | None = None, uses: list[str] | None = None) -> DataFrame:
    """``step(state, row) -> (state, rows out)``; state starts as None and None forgets it.

    ``end(key, state)`` emits for keys whose input is over.  ``uses`` names the
    columns that the step reads beside key and order, so that no others are
    shuffled.  Without a key all rows are one group and go to one task: for folds
    that are global by nature.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    if uses is not None:
        df = df.select(*dict.fromkeys([*([key] if key else []), *order, *uses]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, began = None, None, False
        for b in batches:
            out: list[dict] = []
            for row in records(b):
                k = row[key] if key else None
                if began and k != at:
                    if end:
                        out.extend(end(at, state))
                    state = None
                at, began = k, True
                state, rows = step(state, row)
                out.extend(rows)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if began and end:
            yield pa.RecordBatch.from_pylist(end(at, state), schema=arrow)

    dealt = df.repartition(key) if key else df.repartition(1)
    return dealt.sortWithinPartitions(*([key] if key else []), *order).mapInArrow(run, schema)


def fold_final(df: DataFrame, key: str, order: list[str], builder: Callable[[], Any], folder: Callable[[Any, dict], Any], finish: Callable[[Any, Any], dict], schema: str, uses: list[str] | None = None) -> DataFrame:
    """One row per key, when its input is over: ``finish(key, state)`` of the state that ``folder`` made of its rows in order."""
    return keyed_fold(df, key, order, lambda state, row: (folder(builder() if state is None else state, row), []), schema, lambda k, state: [finish(k, state)], uses)


class Logic:
    """Keyed state with a clock: what a key's rows, its timer and the end of input do.

    Every method returns (rows out, state); a state of None discards the key.
    ``notify_at`` names the time, in seconds, at which ``on_notify`` is due.
    """

    def on_item(self, state: Any, row: dict) -> tuple[list[dict], Any]:
        raise NotImplementedError

    def notify_at(self, state: Any) -> float | None:
        return None

    def on_notify(self, state: Any, at: float) -> tuple[list[dict], Any]:
        return [], state

    def on_eof(self, state: Any) -> list[dict]:
        return []


def timed_fold(df: DataFrame, key: str, ts: str, order: list[str], logic: Logic, schema: str, uses: list[str] | None = None) -> DataFrame:
    """``logic`` over each key's rows in order: timers that are due before a row's time ``ts`` go first, then the row; at the end what is left."""

    def step(state, row):
        out = []
        while state is not None and (due := logic.notify_at(state)) is not None and due < row[ts]:
            got, state = logic.on_notify(state, due)
            out.extend(got)
            if state is not None and logic.notify_at(state) == due:
                raise ValueError("a timer asks for the same time again")
        got, state = logic.on_item(state, row)
        return state, out + got

    return keyed_fold(df, key, order, step, schema, lambda k, state: [] if state is None else logic.on_eof(state), uses)


class Carts(Logic):
    """Abandoned carts: items that no checkout follows within ``timeout`` seconds of the first, or until the end."""

    def __init__(self, ts: str, kind: str, item: str, key: str, timeout: float):
        self.ts, self.kind, self.item, self.key, self.timeout = ts, kind, item, key, timeout

    def on_item(self, state, row):
        if row[self.kind] == "checkout":
            return [], None
        if row[self.kind] == "add":
            first, items = state[1:] if state else (row[self.ts], [])
            return [], (row[self.key], first, [*items, str(row[self.item])])
        return [], state

    def notify_at(self, state):
        return state[1] + self.timeout

    def on_notify(self, state, at):
        return self.on_eof(state), None

    def on_eof(self, state):
        return [{self.key: state[0], "first_ts": state[1], "items": state[2]}]


def dedup_step(seconds: float, ts: str, carry: list[str]) -> Step:
    """Emit a row unless it is within ``seconds`` of the last emitted one."""

    def step(last, row):
        if last is not None and row[ts] <= last + seconds:
            return last, []
        return row[ts], [{c: row[c] for c in carry}]

    return step


def bucket_step(capacity: float, rate: float, ts: str, carry: list[str], cost: str | None = None, label: str | None = None) -> Step:
    """Token bucket: refill by elapsed time, spend the cost (1 by default).

    Without ``label`` refused rows are dropped; with it every row is emitted
    with the decision.  A negative cost refills the bucket and is allowed.
    """

    def step(state, row):
        tokens, last = state or (capacity, row[ts])
        tokens = min(capacity, tokens + max(0.0, row[ts] - last) * rate)
        price = 1.0 if cost is None else row[cost]
        if price < 0:
            tokens, allowed = capacity, True
        else:
            allowed = tokens >= price
            tokens -= price if allowed else 0
        out = {c: row[c] for c in carry}
        if label:
            out[label] = allowed
        return (tokens, row[ts]), [out] if allowed or label else []

    return step


def fraud_step(ts: str, kind: str, amount: str, key: str, needed: int = 3, least: float = 1000, within: float = 300) -> Step:
    """Alert on ``needed`` large transactions within ``within`` seconds of a login."""

    def step(state, row):
        what = row[kind]
        if what == "login":
            return (row[ts], 0), []
        if state is None:
            return None, []
        login, n = state
        if what == "logout" or row[ts] - login > within:
            return None, []
        if what != "transaction" or row[amount] < least:
            return state, []
        if n + 1 < needed:
            return (login, n + 1), []
        return None, [{key: row[key], "login_ts": login, "alert_ts": row[ts]}]

    return step


def top_step(product: str, inc: str, seq: str, k: int) -> Step:
    """Emit the running top k of the sums whenever it changes."""

    def step(state, row):
        sums, last = state or ({}, None)
        if row.get("_start"):  # what was summed before this stretch of rows
            sums[row[product]] = row[inc]
            return (sums, shown(sums)), []
        sums[row[product]] = sums.get(row[product], 0) + row[inc]
        text = shown(sums)
        return (sums, text), [] if text == last else [{"seq": row[seq], "top": text}]

    def shown(sums):
        return ",".join(f"{p}:{n}" for p, n in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:k])

    return step


def running_top(df: DataFrame, product: str, inc: str, seq: str, k: int) -> DataFrame:
    """seq, top: the running top k of the sums by product, in order of ``seq``, whenever it changes.

    Rows are cut into ranges of ``seq``; every range begins with the sums of all
    before it, one row per product, and is folded by a task of its own.
    """
    cut = written(df.select(product, inc, seq).repartitionByRange(seq).withColumn("_part", F.spark_partition_id()), "top-ranges")
    parts = cut.agg(F.max("_part")).first()[0] or 0
    sums = cut.groupBy("_part", product).agg(F.sum(inc).alias(inc)).withColumn("_part", F.explode(F.sequence(F.col("_part") + 1, F.lit(parts + 1))))
    starts = sums.where(F.col("_part") <= parts).groupBy("_part", product).agg(F.sum(inc).alias(inc)).withColumns({seq: F.lit(None).cast(cut.schema[seq].dataType), "_start": F.lit(True)})
    rows = cut.withColumn("_start", F.lit(False)).unionByName(starts)
    return keyed_fold(rows.withColumn("_late", ~F.col("_start")), "_part", ["_late", seq], top_step(product, inc, seq, k), f"seq {cut.schema[seq].dataType.simpleString()}, top string")


def union_step(u: str, v: str, seq: str) -> Step:
    """Union-find over edges: what each edge does and the size of the component after it."""

    def step(state, row):
        parent, size = state or ({}, {})

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        a, b = find(row[u]), find(row[v])
        what = "already_connected"
        if a != b:
            what = "merged"
            if size.get(a, 1) < size.get(b, 1):
                a, b = b, a
            parent[b] = a
            size[a] = size.get(a, 1) + size.get(b, 1)
        out = {"seq": row[seq], "u": row[u], "v": row[v], "status": what}
        return (parent, size), [{**out, "new_component_size" if what == "merged" else "component_size": size.get(a, 1)}]

    return step


def dedup_window(df: DataFrame, key: str, ts: str, order: list[str], seconds: float, carry: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return keyed_fold(df, key, order, dedup_step(seconds, ts, carry), schema, uses=[ts, *carry])


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Final components: node, component (its smallest node), by contraction with checkpoints.

    Nodes hook to the first of their neighbours, in two rounds by label (which
    settles stars) and then in an order that differs each round, until no link is
    left: O(log n) rounds are expected whatever the labels.
    """
    e = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct()
    found = written(e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("component", F.col("node")), "cc-found")
    left = written(e.where("a <> b"), "cc-links")
    rounds = 0
    while not left.isEmpty():
        ranked = lambda c, k=rounds: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("x")) if k >= 2 else F.col(c)
        first = F.least(ranked("a"), "m")["x"] if rounds >= 2 else F.least("a", "m")
        both = left.union(left.select("b", "a").toDF("a", "b"))
        hook = written(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("n"), first.alias("m")), "cc-hook")
        x, y = hook.toDF("a", "x"), hook.toDF("b", "y")
        fresh = written(left.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
        named = written(found.join(hook, found.component == hook.n, "left").select("node", F.coalesce("m", "component").alias("component")), "cc-found")
        drop(left, found, hook)
        left, found = fresh, named
        rounds += 1
    drop(left)
    names = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(names, "component").select("node", F.col("least").alias("component")) if rounds > 2 else found


def join_step(side: str, sides: list[str], value: str, key: str, clear: bool = False) -> Step:
    """Join of several sides merged into one stream: keep the last value of each, emit when all are there.

    ``clear`` forgets the key once it has been emitted; without it later values
    are joined with the last ones of the other sides.
    """

    def step(state, row):
        state = {**(state or {}), row[side]: row[value]}
        if all(s in state for s in sides):
            return None if clear else state, [{key: row[key], **{s: state[s] for s in sides}}]
        return state, []

    return step


def collect_step(value: str, size: int, key: str) -> Step:
    """Batches of ``size`` values; what is left at the end comes from ``collect_end``."""

    def step(state, row):
        held = [*(state or []), row[value]]
        return ([], [{key: row[key], "items": held}]) if len(held) == size else (held, [])

    return step


def collect_end(key: str) -> Callable[[Any, Any], list[dict]]:
    return lambda k, held: [{key: k, "items": held}] if held else []
