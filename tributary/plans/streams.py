"""Queries of the streaming counterparts: tables become a directory of files, and a stream over it is run until it has read them.

Every stream is stopped and started again half way, so results also show that
state, offsets and watermarks outlive a run.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import iso_z, offset_text
from ..operators import folds
from ..storage import mounted
from ..streaming import twins
from .base import Z, events, query
from .registry import _BUCKET, _CART, _SEQ, _SESSIONS

_COLUMNS = "event_id long, user_id long, event_type string, value double, ts timestamp, t double"


def _halves(spark, sf_dir, columns: list[str]) -> tuple[str, list[DataFrame]]:
    """(a watched folder, what goes there in each run), in order of time."""
    e = events(spark, sf_dir).withColumns({"ts": F.col("ts").cast("timestamp"), "t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6}).select(*columns)
    middle = e.agg(F.percentile_approx("ts", 0.5).alias("m")).first()["m"]
    return mounted(spark, "stream"), [e.where(F.col("ts") <= F.lit(middle)), e.where(F.col("ts") > F.lit(middle))]


def _run(spark, sf_dir, make, columns=("event_id", "user_id", "event_type", "value", "ts", "t"), mode: str = "update") -> tuple[DataFrame, str]:
    """(rows that the stream wrote, with ``batch``; its checkpoint) after two runs."""
    folder, halves = _halves(spark, sf_dir, list(columns))
    out, ck, schema = mounted(spark, "stream-out"), mounted(spark, "stream-ck"), None
    kinds = ", ".join(c for c in _COLUMNS.split(", ") if c.split()[0] in columns)
    for part in halves:
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = make(twins.file_stream(spark, folder, kinds, "parquet"))
        schema = stream.schema
        twins.run_once(stream, ck, lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out), mode, timeout=600)
    schema = spark.createDataFrame([], schema).withColumn("batch", F.lit(0)).schema
    return spark.read.schema(schema).parquet(out), ck


def _latest(df: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


@query("""select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') || '+00:00' as window_start, count(*) as n
 from events group by event_type, time_bucket(interval '1 hour', ts)""")
def stream_tumbling(spark, sf_dir):
    """Tumbling windows with a watermark; open ones are emitted too."""
    found, _ = _run(spark, sf_dir, lambda s: twins.windowed(s, ["event_type"], "ts", "1 day", "1 hour", F.count(F.lit(1)).alias("n")))
    out = _latest(found.select("event_type", F.col("window.start").alias("start"), "n", "batch"), "event_type", "start")
    return out.select("event_type", offset_text(F.col("start")).alias("window_start"), "n")


@query(f"""{_SESSIONS} select user_id, strftime(min(ts), {Z}) as session_start, strftime(max(ts), {Z}) as session_end, count(*) as n from s group by user_id, sid""")
def stream_sessions(spark, sf_dir):
    """Sessions; one that goes on in a later run replaces what was emitted of it."""
    found, _ = _run(spark, sf_dir, lambda s: twins.session_windows(s, "user_id", "ts", "30 days", "6 hours", F.count(F.lit(1)).alias("n"), F.min("ts").alias("start")), mode="complete")
    last = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return last.select("user_id", iso_z(F.col("start")).alias("session_start"), iso_z(F.col("session_end")).alias("session_end"), "n")


@query("""select a.user_id, a.event_id as login_id, b.event_id as purchase_id from events a join events b
 on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval '12 hours' where a.event_type = 'signup' and b.event_type = 'purchase'""")
def stream_join(spark, sf_dir):
    """Stream-stream join within 12 hours."""

    def make(s):
        a = s.where("event_type = 'signup'").select("user_id", F.col("ts").alias("login_ts"), F.col("event_id").alias("login_id"))
        b = s.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("purchase_id"))
        return twins.join_within(a, b, "user_id", "login_ts", "buy_ts", "1 day", "12 hours")

    return _run(spark, sf_dir, make, mode="append")[0].select("user_id", "login_id", "purchase_id")


@query(_BUCKET.format(seq=_SEQ, cost="1.0::double", cap=2, rate="(1.0 / 28800)::double", out="select event_id, user_id from r where ok"))
def stream_fold(spark, sf_dir):
    """A sequential fold (token bucket) whose state goes on after a restart."""
    step = folds.bucket_step(2.0, 1.0 / 28800, "t", ["event_id", "user_id"])
    return _run(spark, sf_dir, lambda s: twins.folded(s, "user_id", step, ["t", "event_id"], "event_id long, user_id long"))[0].drop("batch")


@query(f"""with recursive e as materialized (select *, {_CART} as kind, max(rn) over (partition by user_id) as last from {_SEQ}), r as (
 select user_id, rn, last, case when kind = 'add' then t end as first, case when kind = 'add' then cast(event_id as varchar) end as items, null::double as gone, null::varchar as lost from e where rn = 1
 union all select user_id, rn, last, case when kind = 'checkout' then null when kind = 'add' then coalesce(kept, t) else kept end,
 case when kind = 'checkout' then null when kind = 'add' then concat_ws(',', case when kept is not null then items end, cast(event_id as varchar)) when kept is not null then items end,
 case when kept is null then first end, case when kept is null and first is not null then items end
 from (select e.*, r.first, r.items, case when e.t <= r.first + 86400 then r.first end as kept from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
 select user_id, gone as first_ts, lost as items from r where gone is not null union all select user_id, first, items from r where rn = last and first is not null""")
def stream_timers(spark, sf_dir):
    """Abandoned carts by event-time timers; what is pending at the end of input comes from the state that is left."""
    logic, schema = folds.Carts("t", "kind", "event_id", "user_id", 86400), "user_id long, first_ts double, items array<string>"
    kind = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "purchase", "checkout").otherwise("other")
    found, ck = _run(spark, sf_dir, lambda s: twins.timed(s.withColumn("kind", kind), "user_id", logic, "t", "ts", "1 day", ["t", "event_id"], schema))
    out = found.drop("batch").unionByName(twins.at_end(spark, ck, logic, schema))
    return out.select("user_id", "first_ts", F.array_join("items", ",").alias("items"))


@query("""with m as (select max(epoch_us(ts)) as top from (select * from events order by ts limit (select (count(*) + 1) // 2 from events)))
 select case when epoch_us(ts) < top - 86400000000 then 'late' else 'on_time' end as side, count(*) as n from events, m where event_id % 10 = 0 group by 1""")
def stream_late(spark, sf_dir):
    """Rows behind the watermark of an earlier run, which is read again after a restart."""
    folder = mounted(spark, "late")
    os.makedirs(folder)
    e = events(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    place = e.withColumn("place", F.row_number().over(Window.orderBy("ts")))  # a test's split in half, as in the SQL
    half = (e.count() + 1) // 2
    to = {k: (lambda df, batch, k=k: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/{k}")) for k in ("on_time", "late")}
    for batch, rows in enumerate((place.where(F.col("place") <= half).drop("place"), e.where("event_id % 10 = 0"))):
        twins.split_late(to, "ts", 86400, f"{folder}/watermark")(rows, batch)
    sides = [spark.read.parquet(f"{folder}/{k}").where("batch = 1").select(F.lit(k).alias("side")) for k in to]
    return sides[0].union(sides[1]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
