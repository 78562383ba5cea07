"""Structured Streaming counterparts: windows, joins and keyed state with recovery.

Watermarks are global to a query, so delays must cover the lag between keys.
Windows run in update mode: append would hold back those that are still open
when the input ends.  State lives in the checkpoint; a query that is started
again with the same checkpoint and source path goes on where it stopped.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", **options: Any) -> DataFrame:
    """A directory that is watched for new files."""
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def windowed(stream: DataFrame, keys: list[str], ts: str, delay: str, length: str, *aggregates: Column, step: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows with a watermark."""
    w = F.window(ts, length, step) if step else F.window(ts, length)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(*keys, w).agg(*aggregates)


def session_windows(stream: DataFrame, key: str, ts: str, delay: str, gap: str, *aggregates: Column) -> DataFrame:
    """Sessions per key; the engine gives them in append mode (closed ones) or complete mode (all), not in update mode."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap)).agg(F.max(ts).alias("session_end"), *aggregates)


def join_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, delay: str, timeout: str) -> DataFrame:
    """Stream-stream join with a time range, so both sides' state is bounded."""
    a = left.withWatermark(left_ts, delay)
    b = right.withWatermark(right_ts, delay).withColumnRenamed(key, f"_{key}")
    ok = (F.col(key) == F.col(f"_{key}")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {timeout}"))
    return a.join(b, ok).drop(f"_{key}")


def records(rows: Iterator[pd.DataFrame], order: list[str]) -> Iterator[dict]:
    """A key's rows of one micro-batch in order, with None for what is missing; memory is those rows."""
    pdf = pd.concat(list(rows)).sort_values(order, kind="stable")
    for row in pdf.itertuples(index=False, name=None):
        yield {c: None if v is None or v is pd.NaT or v != v else v for c, v in zip(pdf.columns, row, strict=True)}


class Fold(StatefulProcessor):
    """``step(state, row) -> (state, rows out)`` per key in order; state is pickled into one value."""

    def __init__(self, step: Callable, order: list[str], columns: list[str], state: str = "data binary"):
        self.step, self.order, self.columns, self.schema = step, order, columns, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pickle

        state = pickle.loads(self.state.get()[0]) if self.state.exists() else None
        out: list[dict] = []
        for row in records(rows, self.order):
            state, got = self.step(state, row)
            out.extend(got)
        if state is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Timed(StatefulProcessor):
    """A ``Logic`` (operators.folds) per key: its rows in order of event time, its timer as the watermark passes."""

    def __init__(self, logic, ts: str, order: list[str], columns: list[str]):
        self.logic, self.ts, self.order, self.columns = logic, ts, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "data binary")
        self.timer = handle.getValueState("timer", "at long")

    def _keep(self, state: Any) -> None:
        import pickle

        due = None if state is None else self.logic.notify_at(state)
        at = None if due is None else int(due * 1000)
        old = self.timer.get()[0] if self.timer.exists() else None
        if old != at:
            if old is not None:
                self.handle.deleteTimer(old)
                self.timer.clear()
            if at is not None:
                self.handle.registerTimer(at)
                self.timer.update((at,))
        if state is None:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(state),))

    def _held(self) -> Any:
        import pickle

        return pickle.loads(self.state.get()[0]) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._held(), []
        for row in records(rows, self.order):
            while state is not None and (due := self.logic.notify_at(state)) is not None and due < row[self.ts]:
                got, state = self.logic.on_notify(state, due)
                out.extend(got)
            got, state = self.logic.on_item(state, row)
            out.extend(got)
        self._keep(state)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, out = self._held(), []
        self.timer.clear()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if state is not None and (due := self.logic.notify_at(state)) is not None and int(due * 1000) <= now:
            out, state = self.logic.on_notify(state, due)
        self._keep(state)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Collect(StatefulProcessor):
    """Batches per key: emitted at ``size`` rows or, by processing time, ``timeout_ms`` after the first."""

    def __init__(self, value: str, size: int, timeout_ms: int):
        self.value, self.size, self.timeout_ms = value, size, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "v string")
        self.timer = handle.getValueState("timer", "at long")

    def _emit(self, key, items: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])], "items": [",".join(items)], "n": [len(items)]})

    def handleInputRows(self, key, rows, timerValues):
        items = [x[0] for x in self.held.get()] if self.held.exists() else []
        for pdf in rows:
            for v in pdf[self.value].astype(str):
                items.append(v)
                if len(items) == self.size:
                    yield self._emit(key, items)
                    items = []
        self._keep(items, timerValues)

    def _keep(self, items: list[str], timerValues) -> None:
        if self.timer.exists() and not items:
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if items:
            self.held.put([(x,) for x in items])
            if not self.timer.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
                self.handle.registerTimer(at)
                self.timer.update((at,))
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        items = [x[0] for x in self.held.get()] if self.held.exists() else []
        self.held.clear()
        self.timer.clear()
        if items:
            yield self._emit(key, items)

    def close(self) -> None:
        pass


def folded(stream: DataFrame, key: str, step: Callable, order: list[str], schema: str) -> DataFrame:
    """A sequential fold as a stateful operator; rows of a micro-batch are ordered, later batches follow."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Fold(step, order, names), outputStructType=schema, outputMode="Update", timeMode="None")


def collected(stream: DataFrame, key: str, value: str, size: int, timeout_ms: int) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=Collect(value, size, timeout_ms), outputStructType="key string, items string, n long", outputMode="Update", timeMode="ProcessingTime")


def timed(stream: DataFrame, key: str, logic, ts: str, event_time: str, delay: str, order: list[str], schema: str) -> DataFrame:
    """``logic`` as a stateful operator; ``ts`` are seconds, ``event_time`` the timestamp of the watermark that fires timers."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    marked = stream.withWatermark(event_time, delay)
    return marked.groupBy(key).transformWithStateInPandas(statefulProcessor=Timed(logic, ts, order, names), outputStructType=schema, outputMode="Update", timeMode="EventTime")


def at_end(spark: SparkSession, checkpoint: str, logic, schema: str) -> DataFrame:
    """What ``logic`` emits for the state that a stopped stream has left: the end of its input."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    held = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint).select("value.data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for b in batches:
            yield pa.RecordBatch.from_pylist([row for x in b.column(0).to_pylist() for row in logic.on_eof(pickle.loads(x))], schema=arrow)

    return held.mapInArrow(run, schema)


def split_late(writers: dict, key_ts: str, delay_seconds: float, log: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that splits rows behind the watermark from the others.

    The watermark is the largest time of earlier batches less the delay; rows go
    to the "on_time" and "late" of ``writers``.  Each batch's watermark is kept
    in the file ``log``, beside the stream's checkpoint: a restart goes on from
    there, and a batch that is run again is split as before.
    """

    def marks() -> dict[int, float]:
        if not os.path.exists(log):
            return {}
        with open(log) as f:
            return {int(b): float(m) for b, m in json.load(f).items()}

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            known = marks()
            mark = known.get(batch)
            late = F.lit(False) if mark is None else F.coalesce(F.col(key_ts).cast("timestamp") < F.timestamp_micros(F.lit(int(mark * 1e6))), F.lit(False))
            writers["on_time"](df.where(~late), batch)
            writers["late"](df.where(late), batch)
            top = df.agg(F.max(F.unix_micros(F.col(key_ts).cast("timestamp")))).first()[0]
            after = max([x for x in (mark, None if top is None else top / 1e6 - delay_seconds) if x is not None], default=None)
            if after is not None:  # the watermark of the next batch
                with open(f"{log}.part", "w") as f:
                    json.dump({**{b: m for b, m in known.items() if b >= batch}, batch + 1: after}, f)
                os.replace(f"{log}.part", log)
        finally:
            df.unpersist()

    return write


def run_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update", timeout: int = 120) -> None:
    """Process what is there, then stop; state and offsets stay in the checkpoint.

    State is kept in RocksDB, which folds and timers need, whatever the session's setting.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKSDB)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        try:
            if not q.awaitTermination(timeout):
                raise TimeoutError("the stream did not finish")
        finally:
            q.stop()
    finally:
        conf.set(_STORE, before) if before else conf.unset(_STORE)
