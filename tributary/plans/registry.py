"""One query per operator, with the SQL that gives the same rows.

Queries read whole tables; computed floats are rounded alike on both sides and
ties are broken explicitly.  ``SQL`` is for DuckDB over views of the same files.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import capitalise, fixed2, is_json, iso_z, json_field, last_part, offset_text, parse_iso, route_hash, rstrip, strip
from ..operators import aggregates as A
from ..operators import folds, inference, joins, shape
from ..operators import windows as W
from .base import ORACLES, QUERIES, Z, events, query, seconds, table

__all__ = ["ORACLES", "QUERIES"]

# ---- event-time windows ----


@query(f"""select event_type, strftime(time_bucket(interval '1 hour', ts), {Z}) as window_start, round(arg_min(value, (ts, event_id)), 4) as open,
 round(max(value), 4) as high, round(min(value), 4) as low, round(arg_max(value, (ts, event_id)), 4) as close, round(sum(value), 4) as volume
 from events group by event_type, time_bucket(interval '1 hour', ts)""")
def tumbling_ohlc(spark, sf_dir):
    bars = W.ohlcv(events(spark, sf_dir), "event_type", "ts", "value", "value", ["ts", "event_id"], "1 hour")
    return bars.select("event_type", iso_z(F.col("window_start")).alias("window_start"), *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("""select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') || '+00:00' as window_start, count(*) as n
 from events group by event_type, time_bucket(interval '1 hour', ts)""")
def tumbling_count(spark, sf_dir):
    out = W.tumbling(events(spark, sf_dir), ["event_type"], "ts", "1 hour", F.count(F.lit(1)).alias("n"))
    return out.select("event_type", offset_text(F.col("window_start")).alias("window_start"), "n")


@query(f"""select event_type as service, strftime(time_bucket(interval '6 hours', ts), {Z}) as window_start,
 round(sum(case when value <= 20 then 1.0 when value <= 80 then 0.5 else 0.0 end) / count(value), 8) as apdex
 from events group by event_type, time_bucket(interval '6 hours', ts)""")
def apdex_windows(spark, sf_dir):
    out = W.tumbling(events(spark, sf_dir), ["event_type"], "ts", "6 hours", A.apdex(F.col("value"), 20, 80).alias("apdex"))
    return out.select(F.col("event_type").alias("service"), iso_z(F.col("window_start")).alias("window_start"), F.round("apdex", 8).alias("apdex"))


@query(f"""select p_brand as category, strftime(time_bucket(interval '1 day', l_shipdate), {Z}) as window_start, round(sum(l_quantity * p_retailprice), 2) as revenue
 from lineitem join part on l_partkey = p_partkey group by p_brand, time_bucket(interval '1 day', l_shipdate)""")
def revenue_windows(spark, sf_dir):
    lookup = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    sales = joins.enrich(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate"), lookup, F.col("l_partkey") == F.col("p_partkey"))
    out = W.tumbling(sales, ["p_brand"], "l_shipdate", "1 day", F.sum(F.col("l_quantity") * F.col("p_retailprice")).alias("revenue"))
    return out.select(F.col("p_brand").alias("category"), iso_z(F.col("window_start")).alias("window_start"), F.round("revenue", 2).alias("revenue"))


_SLIDES = "(select *, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as w from events)"


@query(f"""select event_type, strftime(w, {Z}) as window_start, count(*) as n, round(avg(value), 8) as mean, round(stddev_pop(value), 4) as deviation
 from {_SLIDES} group by event_type, w""")
def sliding_stats(spark, sf_dir):
    out = W.sliding(events(spark, sf_dir), ["event_type"], "ts", "2 hours", "1 hour", F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return out.select("event_type", iso_z(F.col("window_start")).alias("window_start"), "n", F.round("mean", 8).alias("mean"), F.round("deviation", 4).alias("deviation"))


@query(f"""with s as (select *, unnest([time_bucket(interval '12 hours', ts), time_bucket(interval '12 hours', ts) - interval '12 hours']) as w from events),
 m as (select *, avg(value) over x as mean, stddev_pop(value) over x as deviation from s window x as (partition by event_type, w))
 select event_type, strftime(w, {Z}) as window_start, event_id, round(value, 4) as value from m where deviation > 0 and abs(value - mean) > 2 * deviation""")
def sliding_outliers(spark, sf_dir):
    out = W.outliers(events(spark, sf_dir), ["event_type"], "ts", "value", "24 hours", "12 hours", 2.0)
    return out.select("event_type", iso_z(F.col("window_start")).alias("window_start"), "event_id", F.round("value", 4).alias("value"))


_SESSIONS = """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '6 hours' then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from g)"""


@query(f"{_SESSIONS} select user_id, strftime(min(ts), {Z}) as session_start, strftime(max(ts), {Z}) as session_end, count(*) as events from s group by user_id, sid")
def sessions(spark, sf_dir):
    out = W.sessions(events(spark, sf_dir), "user_id", "ts", "6 hours")
    return out.select("user_id", iso_z(F.col("session_start")).alias("session_start"), iso_z(F.col("session_end")).alias("session_end"), "events")


@query(f"{_SESSIONS} select user_id, strftime(min(ts), {Z}) as session_start, string_agg(event_type, ',' order by ts, event_id) as activity from s group by user_id, sid")
def session_activity(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    out = W.sessions(events(spark, sf_dir), "user_id", "ts", "6 hours", F.array_join(F.transform(rows, lambda x: x["event_type"]), ",").alias("activity"))
    return out.select("user_id", iso_z(F.col("session_start")).alias("session_start"), "activity")


@query(f"""select user_id, strftime(time_bucket(interval '1 day', ts), {Z}) as window_start, string_agg(event_type, ',' order by ts, event_id) as activity
 from events group by user_id, time_bucket(interval '1 day', ts)""")
def collect_window(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    out = W.tumbling(events(spark, sf_dir), ["user_id"], "ts", "1 day", F.array_join(F.transform(rows, lambda x: x["event_type"]), ",").alias("activity"))
    return out.select("user_id", iso_z(F.col("window_start")).alias("window_start"), "activity")


@query("""select user_id, cast(floor(epoch(time_bucket(interval '1 day', ts)) / 86400) as bigint) as window_id, max(event_id) as last_event
 from events group by user_id, time_bucket(interval '1 day', ts)""")
def reduce_window(spark, sf_dir):
    out = W.tumbling(events(spark, sf_dir), ["user_id"], "ts", "1 day", F.max("event_id").alias("last_event"))
    return out.select("user_id", W.window_id(F.col("window_start"), 86400).alias("window_id"), "last_event")


@query(f"""select cast(a.user_id as varchar) as key, strftime(time_bucket(interval '1 hour', a.ts), {Z}) as window_start, a.event_id as view_id, b.event_id as click_id
 from events a join events b on a.user_id = b.user_id and time_bucket(interval '1 hour', a.ts) = time_bucket(interval '1 hour', b.ts)
 where a.event_type = 'view' and b.event_type = 'click'""")
def join_window(spark, sf_dir):
    e = shape.key_on(events(spark, sf_dir), F.col("user_id"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("key", "ts", F.col("event_id").alias(name))
    out = joins.join_window(side("view", "view_id"), side("click", "click_id"), "key", "ts", "1 hour")
    return out.select("key", iso_z(F.col("window.start")).alias("window_start"), "view_id", "click_id")


# ---- shape and routing ----

_K = "try_cast(json_extract_string(props, '$.k') as bigint)"


@query(f"select event_id, {_K} as k, cast(user_id as varchar) as key from events where {_K} > 50")
def filter_map_json(spark, sf_dir):
    e = shape.filter_map(events(spark, sf_dir), "k", json_field(F.col("props"), "k", "bigint"))
    return shape.key_on(shape.keep(e, F.col("k") > 50), F.col("user_id")).select("event_id", "k", "key")


@query(f"""select event_id, case when try_cast(props as json) is null then 'invalid json' when json_extract_string(props, '$.k') is null then 'missing k' end as error from events""")
def dead_letter(spark, sf_dir):
    return shape.dead_letter(events(spark, sf_dir), F.col("props"), "k").select("event_id", "error")


@query("select case when event_type in ('click', 'view', 'error') then event_type else 'dead_letter' end as route, count(*) as n from events group by 1")
def route_counts(spark, sf_dir):
    return shape.route(events(spark, sf_dir), F.col("event_type"), ["click", "view", "error"], "dead_letter").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'high' as side, event_id, round(value * 1.8 + 32, 4) as fahrenheit from events where value > 50
 union all by name select 'low' as side, event_id, null as fahrenheit from events where not coalesce(value > 50, false)""")
def branch_merge(spark, sf_dir):
    high, low = shape.branch(events(spark, sf_dir), F.col("value") > 50)
    high = high.select(F.lit("high").alias("side"), "event_id", F.round(F.col("value") * 1.8 + 32, 4).alias("fahrenheit"))
    return shape.merge(high, low.select(F.lit("low").alias("side"), "event_id"))


@query(r"select word, count(*) as n from (select unnest(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as word from documents) group by word")
def flat_map_words(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return shape.flat_map(table(spark, sf_dir, "documents").select("text"), "word", words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, user_id, sum(value > 50)::bigint as high, round(sum(value), 4) as total from events group by event_type, user_id")
def redistributed_sum(spark, sf_dir):
    e = shape.redistribute(events(spark, sf_dir).select("event_type", "user_id", "value"), 16)
    return e.groupBy("event_type", "user_id").agg(F.sum((F.col("value") > 50).cast("int")).alias("high"), F.round(F.sum("value"), 4).alias("total"))


@query("""select event_id, upper(event_type) as kind, upper(event_type[1]) || event_type[2:] as title, printf('%.2f', round(value, 2)) as shown,
 strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, list_extract(string_split('a/' || event_type, '/'), -1) as tail from events""")
def scalar_functions(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", F.upper("event_type").alias("kind"), capitalise(F.col("event_type")).alias("title"), fixed2(F.col("value")).alias("shown"), iso_z(F.col("ts")).alias("at"), last_part(F.concat(F.lit("a/"), "event_type")).alias("tail"))


@query("""select distinct o_orderstatus, o_orderpriority from orders where o_orderstatus in ('F', 'O') and contains(lower(o_orderpriority), 'high')""")
def site_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where(F.col("o_orderstatus").isin("F", "O") & F.lower("o_orderpriority").contains("high")).select("o_orderstatus", "o_orderpriority").distinct()


@query("select o_orderkey, round(o_totalprice, 2) as price from orders order by o_totalprice desc, o_orderkey limit 25")
def sort_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("select cast(h % 4 as int) as part, count(*) as n, count(distinct user_id) as users from (select user_id, ('0x' || md5(cast(user_id as varchar))[1:8])::bigint as h from events) group by 1")
def routed_parts(spark, sf_dir):
    """Stable hash routing to 4 parts."""
    return events(spark, sf_dir).groupBy(route_hash(F.col("user_id"), 4).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""select cast(user_id as varchar) as kept, event_id, round(value * 2, 4) as doubled, upper(event_type) as kind from events where value * 2 > 50""")
def map_and_rekey(spark, sf_dir):
    """Rows and values mapped, keyed, filtered by value; the key taken off again and put on under another name."""
    e = shape.map_columns(events(spark, sf_dir), doubled=F.round(F.col("value") * 2, 4), kind=F.upper("event_type"))
    e = shape.keep(shape.key_on(e, F.col("user_id")), F.col("value") * 2 > 50)
    return shape.key_on(shape.key_rm(e), F.col("user_id"), "kept").select("kept", "event_id", "doubled", "kind")


@query("""select event_id, trim(s, ' ' || chr(9) || chr(10)) as stripped, rtrim(s, chr(10)) as chopped, string_split(s, ' ')[2] as part
 from (select event_id, ' ' || event_type || ' x ' || chr(10) as s from events)""")
def strip_and_split(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", F.concat(F.lit(" "), "event_type", F.lit(" x \n")).alias("s"))
    return e.select("event_id", strip(F.col("s")).alias("stripped"), rstrip(F.col("s")).alias("chopped"), F.split("s", " ")[1].alias("part"))


@query("""select event_id, cast(epoch_us(ts) // 1000000 as bigint) as at, true as malformed from events""")
def iso_times(spark, sf_dir):
    """ISO texts with Z parsed; malformed ones are null."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events(spark, sf_dir).select("event_id", F.unix_seconds(parse_iso(text)).alias("at"), parse_iso(F.concat(F.lit("x"), text)).isNull().alias("malformed"))


@query("select count(*) as n, true as stamped from events")
def ingest_time(spark, sf_dir):
    """The system clock: every row of a batch carries the time at which it runs."""
    e = shape.with_ingest_time(events(spark, sf_dir))
    return e.agg(F.count(F.lit(1)).alias("n"), ((F.min("ingested") == F.max("ingested")) & (F.abs(F.unix_seconds(F.max("ingested")) - F.unix_seconds(F.current_timestamp())) < 60)).alias("stamped"))


# ---- joins ----

_LATEST = "(select cast({k} as varchar) as key, arg_max({v}, {o}) as {n} from {t} {w} group by 1)"


@query(f"""select key, impression, click from {_LATEST.format(k='user_id', v='event_id', o='(ts, event_id)', n='impression', t='events', w="where event_type = 'view'")}
 join {_LATEST.format(k='user_id', v='event_id', o='(ts, event_id)', n='click', t='events', w="where event_type = 'click'")} using (key)""")
def join_latest(spark, sf_dir):
    e = shape.key_on(events(spark, sf_dir), F.col("user_id"))
    side = lambda kind, name: (e.where(F.col("event_type") == kind).select("key", "ts", F.col("event_id").alias(name)), ["ts", name])
    a, b = side("view", "impression"), side("click", "click")
    return joins.join_complete([(a[0], a[1]), (b[0].withColumnRenamed("ts", "click_ts"), ["click_ts", "click"])], "key").select("key", "impression", "click")


@query("""select cast(c_custkey as varchar) as key, c_name, round(spent, 2) as spent, n_name from customer
 join (select cast(o_custkey as varchar) as k, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as spent from orders group by 1) on k = cast(c_custkey as varchar)
 join nation on n_nationkey = c_nationkey""")
def join_three_ways(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("spent"))
    out = joins.join_complete([(c, ["c_name"]), (o, ["o_orderdate", "o_orderkey"])], "key")
    return joins.enrich(out, table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("key", "c_name", F.round("spent", 2).alias("spent"), "n_name")


@query("select s_suppkey, s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def lookup_enrichment(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    out = joins.enrich(joins.enrich(s, n, F.col("s_nationkey") == F.col("n_nationkey")), r, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("s_suppkey", "s_name", "n_name", "r_name")


@query("""select a.user_id, a.event_id as login_id, b.event_id as purchase_id from events a join events b
 on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval '12 hours' where a.event_type = 'signup' and b.event_type = 'purchase'""")
def join_timeout(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("login_ts"), F.col("event_id").alias("login_id"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("purchase_id"))
    return joins.join_within(a, b, "user_id", "login_ts", "buy_ts", "12 hours").select("user_id", "login_id", "purchase_id")


# ---- aggregates and closed-form state ----


@query("select event_type, round(sum(value), 4) as total from events group by event_type")
def sum_by_key(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@query("select cast(sum(s) as bigint) as total from (select sum(cast(floor(value) as bigint)) as s from events group by user_id)")
def two_stage_sum(spark, sf_dir):
    return A.two_stage_sum(events(spark, sf_dir).select("user_id", F.floor("value").cast("decimal(38,0)").alias("v")), "user_id", "v").select(F.col("total").cast("long").alias("total"))


@query("""select user_id, count(value) as n, round(min(value), 4) as low, round(max(value), 4) as high, round(sum(value), 4) as total, round(arg_min(value, (ts, event_id)), 4) as first,
 round(arg_max(value, (ts, event_id)), 4) as last, round(avg(value), 8) as mean, round(stddev_pop(value), 4) as deviation from events group by user_id""")
def key_statistics(spark, sf_dir):
    out = A.statistics(events(spark, sf_dir), ["user_id"], "value", ["ts", "event_id"])
    return out.select("user_id", "n", *[F.round(c, 8 if c == "mean" else 4).alias(c) for c in ("low", "high", "total", "first", "last", "mean", "deviation")])


@query("""select l_returnflag, l_linestatus, count(*) as trials, sum(cast(l_discount > 0.05 as int))::bigint as passes, round(avg(nullif(l_tax, 0)), 4) as latency,
 cast(round(100.0 * sum(cast(l_discount > 0.05 as int)) / count(*)) as int) as rate from lineitem group by l_returnflag, l_linestatus""")
def leaderboard_site(spark, sf_dir):
    out = A.leaderboard(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05, F.col("l_tax"))
    return out.select("l_returnflag", "l_linestatus", "trials", "passes", F.round("latency", 4).alias("latency"), "rate")


@query("select user_id, string_agg(event_type, ',' order by ts, event_id) as items from events group by user_id")
def list_by_key(spark, sf_dir):
    return A.collected(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", F.array_join("items", ",").alias("items"))


@query("""select event_id, user_id, round(max(value) over w, 4) as highest, round(sum(value) over w, 4) as total, count(value) over w as n from events
 window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def running_state(spark, sf_dir):
    out = A.running(events(spark, sf_dir), "user_id", ["ts", "event_id"], highest=("max", "value"), total=("sum", "value"), n=("count", "value"))
    return out.select("event_id", "user_id", F.round("highest", 4).alias("highest"), F.round("total", 4).alias("total"), "n")


@query("select event_id, user_id, round(avg(value) over (partition by user_id order by ts, event_id rows 2 preceding), 4) as average from events")
def moving_average(spark, sf_dir):
    out = A.moving_average(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value")
    return out.select("event_id", "user_id", F.round("average", 4).alias("average"))


@query("""select user_id, cast(floor((rn - 1) / 10) as bigint) as batch, count(*) as n, string_agg(cast(event_id as varchar), ',' order by ts, event_id) as ids
 from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events where value >= 0) group by 1, 2""")
def collect_batches(spark, sf_dir):
    e = A.batches(events(spark, sf_dir).where("value >= 0"), "user_id", ["ts", "event_id"], 10)
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return e.groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(rows, lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query(f"""select event_id, user_id, round(value, 4) as value, setting from (select *, coalesce(last_value(case when event_type = 'signup' then {_K}::double end ignore nulls)
 over (partition by user_id order by ts, event_id rows unbounded preceding), 100.0) as setting from events) where event_type <> 'signup' and value > setting""")
def dynamic_threshold(spark, sf_dir):
    setting = F.when(F.col("event_type") == "signup", json_field(F.col("props"), "k", "double"))
    e = A.latest_setting(events(spark, sf_dir), "user_id", ["ts", "event_id"], setting, 100.0)
    return e.where("event_type <> 'signup' and value > setting").select("event_id", "user_id", F.round("value", 4).alias("value"), "setting")


@query("select user_id, round(max(value), 4) as score from events group by user_id order by max(value) desc, user_id limit 10")
def top_k_final(spark, sf_dir):
    return A.top_k(events(spark, sf_dir), "user_id", "value", 10).select("user_id", F.round("score", 4).alias("score"))


# ---- sequential folds ----

_SEQ = "(select *, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events)"


def _folded(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", seconds().alias("t"), json_field(F.col("props"), "k", "double").alias("k"))


@query(f"""with recursive e as materialized {_SEQ}, r as (select user_id, rn, event_id, t as kept, true as emit from e where rn = 1
 union all select e.user_id, e.rn, e.event_id, case when e.t > r.kept + 21600 then e.t else r.kept end, e.t > r.kept + 21600 from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)
 select event_id, user_id from r where emit""")
def dedup_window(spark, sf_dir):
    return folds.dedup_window(_folded(spark, sf_dir), "user_id", "t", ["t", "event_id"], 21600, ["event_id", "user_id"])


_BUCKET = """with recursive e as materialized (select *, {cost} as cost from {seq}), r as (
 select user_id, rn, event_id, t, cost <= {cap} as ok, case when cost < 0 then {cap}::double when cost <= {cap} then {cap} - cost else {cap}::double end as tokens from e where rn = 1
 union all select user_id, rn, event_id, t, cost < 0 or have >= cost, case when cost < 0 then {cap}::double when have >= cost then have - cost else have end
 from (select e.*, least({cap}::double, r.tokens + (e.t - r.t) * {rate}) as have from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
 {out}"""


@query(_BUCKET.format(seq=_SEQ, cost="1.0::double", cap=2, rate="(1.0 / 28800)::double", out="select event_id, user_id from r where ok"))
def token_bucket_drop(spark, sf_dir):
    step = folds.bucket_step(2.0, 1.0 / 28800, "t", ["event_id", "user_id"])
    return folds.keyed_fold(_folded(spark, sf_dir), "user_id", ["t", "event_id"], step, "event_id long, user_id long", uses=[])


@query(_BUCKET.format(seq=_SEQ, cost=f"case when event_type = 'error' then -1.0 else {_K} / 10.0 end::double", cap=10, rate="(1.0 / 8192)::double", out="select event_id, user_id, ok as allowed from r"))
def token_bucket_label(spark, sf_dir):
    e = _folded(spark, sf_dir).withColumn("cost", F.when(F.col("event_type") == "error", -1.0).otherwise(F.col("k") / 10.0))
    step = folds.bucket_step(10.0, 1.0 / 8192, "t", ["event_id", "user_id"], "cost", "allowed")
    return folds.keyed_fold(e, "user_id", ["t", "event_id"], step, "event_id long, user_id long, allowed boolean", uses=["cost"])


_KIND = "case event_type when 'signup' then 'login' when 'error' then 'logout' else 'transaction' end"


@query(f"""with recursive e as materialized (select *, {_KIND} as kind from {_SEQ}), r as (
 select user_id, rn, case when kind = 'login' then t end as login, 0 as n, null::double as alert_login, null::double as alert_ts from e where rn = 1
 union all select user_id, rn, case when kind = 'login' then t when login is null or kind = 'logout' or t - login > 86400 then null when kind = 'transaction' and value >= 20 and n = 2 then null else login end,
 case when kind = 'login' or login is null or kind = 'logout' or t - login > 86400 then 0 when kind = 'transaction' and value >= 20 then (n + 1) % 3 else n end,
 case when hit then login end, case when hit then t end
 from (select e.*, r.login, r.n, coalesce(kind = 'transaction' and r.login is not null and e.t - r.login <= 86400 and value >= 20 and r.n = 2, false) as hit from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
 select user_id, alert_login as login_ts, alert_ts from r where alert_ts is not null""")
def fraud_alerts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "login").when(F.col("event_type") == "error", "logout").otherwise("transaction")
    e = _folded(spark, sf_dir).withColumn("kind", kind)
    step = folds.fraud_step("t", "kind", "value", "user_id", 3, 20, 86400)
    return folds.keyed_fold(e, "user_id", ["t", "event_id"], step, "user_id long, login_ts double, alert_ts double", uses=["kind", "value"])


_CART = "case event_type when 'click' then 'add' when 'purchase' then 'checkout' else 'other' end"


@query(f"""with recursive e as materialized (select *, {_CART} as kind, max(rn) over (partition by user_id) as last from {_SEQ}), r as (
 select user_id, rn, last, case when kind = 'add' then t end as first, case when kind = 'add' then cast(event_id as varchar) end as items, null::double as gone, null::varchar as lost from e where rn = 1
 union all select user_id, rn, last, case when kind = 'checkout' then null when kind = 'add' then coalesce(kept, t) else kept end,
 case when kind = 'checkout' then null when kind = 'add' then concat_ws(',', case when kept is not null then items end, cast(event_id as varchar)) when kept is not null then items end,
 case when kept is null then first end, case when kept is null and first is not null then items end
 from (select e.*, r.first, r.items, case when e.t <= r.first + 86400 then r.first end as kept from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
 select user_id, gone as first_ts, lost as items from r where gone is not null union all select user_id, first, items from r where rn = last and first is not null""")
def abandoned_carts(spark, sf_dir):
    """Carts without a purchase within a day of their first item, or at the end of input, by a timer per user."""
    kind = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "purchase", "checkout").otherwise("other")
    e = _folded(spark, sf_dir).withColumn("kind", kind)
    out = folds.timed_fold(e, "user_id", "t", ["t", "event_id"], folds.Carts("t", "kind", "event_id", "user_id", 86400), "user_id long, first_ts double, items array<string>", ["kind"])
    return out.select("user_id", "first_ts", F.array_join("items", ",").alias("items"))


@query(f"select user_id, cast(sum(case when rn % 2 = 1 then floor(value) else -floor(value) end) as bigint) as balance, count(*) as n from {_SEQ} group by user_id")
def fold_final(spark, sf_dir):
    """An opaque fold in order: values are added and taken away in turn."""

    def add(state, row):
        total, n = state
        return (total + (1 if n % 2 == 0 else -1) * math.floor(row["value"]), n + 1)

    return folds.fold_final(_folded(spark, sf_dir), "user_id", ["t", "event_id"], lambda: (0, 0), add, lambda k, s: {"user_id": k, "balance": s[0], "n": s[1]}, "user_id long, balance long, n long", ["value"])


@query(f"""select event_type, strftime(time_bucket(interval '1 day', ts), {Z}) as window_start, round(max(value) - min(value), 4) as spread, arg_max(event_id, (ts, event_id)) as last
 from events group by event_type, time_bucket(interval '1 day', ts)""")
def fold_window(spark, sf_dir):
    """An opaque fold per tumbling window: builder, folder, and a merger of the stretches that a window is folded by."""
    out = W.fold_window(
        events(spark, sf_dir).select("event_type", "ts", "event_id", "value"), "event_type", "ts", ["ts", "event_id"], lambda: (math.inf, -math.inf, None),
        lambda s, r: (min(s[0], r["value"]), max(s[1], r["value"]), r["event_id"]), lambda s, t: (min(s[0], t[0]), max(s[1], t[1]), t[2]),
        lambda k, start, end, s: {"event_type": k, "start": start, "spread": s[1] - s[0], "last": s[2]}, "event_type string, start double, spread double, last long", length=86400,
    )
    return out.select("event_type", iso_z(F.timestamp_seconds("start")).alias("window_start"), F.round("spread", 4).alias("spread"), "last")


@query(f"{_SESSIONS} select user_id, strftime(min(ts), {Z}) as session_start, strftime(max(ts), {Z}) as session_end, string_agg(event_type, ',' order by ts, event_id) as activity from s group by user_id, sid")
def fold_session(spark, sf_dir):
    """An opaque fold per session; stretches of an hour are merged where no gap parts them."""
    out = W.fold_window(
        events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", ["ts", "event_id"], list, lambda s, r: [*s, r["event_type"]], lambda s, t: s + t,
        lambda k, start, end, s: {"user_id": k, "first": start, "last": end, "activity": ",".join(s)}, "user_id long, first double, last double, activity string", gap=6 * 3600,
    )
    return out.select("user_id", iso_z(F.timestamp_seconds("first")).alias("session_start"), iso_z(F.timestamp_seconds("last")).alias("session_end"), "activity")


@query(f"""with recursive e as materialized (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('view', 'click')),
 r as (select user_id, rn, case when event_type = 'view' then event_id end as v, case when event_type = 'click' then event_id end as c, false as done, event_id from e where rn = 1
 union all select user_id, rn, case when event_type = 'view' then event_id else v end, case when event_type = 'click' then event_id else c end,
 case when event_type = 'view' then c is not null else v is not null end, event_id
 from (select e.*, case when not r.done then r.v end as v, case when not r.done then r.c end as c from r join e on e.user_id = r.user_id and e.rn = r.rn + 1))
 select cast(user_id as varchar) as key, cast(v as varchar) as view, cast(c as varchar) as click from r where done""")
def join_and_clear(spark, sf_dir):
    """A join of one merged stream that emits when both sides are there and then forgets them."""
    e = shape.key_on(events(spark, sf_dir).where("event_type in ('view', 'click')"), F.col("user_id")).withColumn("v", F.col("event_id").cast("string"))
    step = folds.join_step("event_type", ["view", "click"], "v", "key", clear=True)
    return folds.keyed_fold(e, "key", ["ts", "event_id"], step, "key string, view string, click string", uses=["event_type", "v"])


@query("""with s as (select e.event_id, t.event_type, sum(case when e.event_type = t.event_type then floor(e.value) end) over (partition by t.event_type order by e.event_id) as n
 from events e cross join (select distinct event_type from events) t),
 k as (select *, row_number() over (partition by event_id order by n desc, event_type) as place from s where n is not null),
 p as (select event_id as seq, string_agg(event_type || ':' || cast(n as bigint), ',' order by place) as top from k where place <= 3 group by event_id)
 select seq, top from (select *, lag(top) over (order by seq) as old from p) where old is null or top <> old""")
def running_top_k(spark, sf_dir):
    """The running top 3 of event types by summed value, whenever it changes."""
    e = events(spark, sf_dir).select("event_id", "event_type", F.floor("value").cast("long").alias("inc"))
    return folds.running_top(e, "event_type", "inc", "event_id", 3)


def _edges(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("S"), "s_suppkey").alias("u"), F.concat(F.lit("N"), "s_nationkey").alias("v"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10**9).cast("long").alias("seq"), F.concat(F.lit("N"), "n_nationkey").alias("u"), F.concat(F.lit("R"), "n_regionkey").alias("v"))
    return s.unionByName(n)


@query("""with c as (select n_nationkey as n, n_regionkey as r, (select count(*) from supplier where s_nationkey = n_nationkey) as k from nation),
 z as (select r, sum(k + 1) + 1 as size from c group by r),
 e as (select s_suppkey as seq, 'S' || s_suppkey as u, 'N' || s_nationkey as v, 'merged","new_' as what, 1 + count(*) over (partition by s_nationkey order by s_suppkey) as n from supplier
 union all select 1000000000 + n, 'N' || n, 'R' || r, 'merged","new_', 1 + sum(k + 1) over (partition by r order by n) from c
 union all select 2000000000 + s_suppkey, 'S' || s_suppkey, 'R' || r, 'already_connected","', size from supplier join c on s_nationkey = n join z using (r))
 select seq, '{"u":"' || u || '","v":"' || v || '","status":"' || what || 'component_size":' || cast(n as bigint) || '}' as line from e""")
def union_find(spark, sf_dir):
    """What each edge does to the components so far; one ordered stream, global by nature."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    again = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    again = again.select((F.col("s_suppkey") + 2 * 10**9).cast("long").alias("seq"), F.concat(F.lit("S"), "s_suppkey").alias("u"), F.concat(F.lit("R"), "n_regionkey").alias("v"))
    edges = _edges(spark, sf_dir).unionByName(again)
    out = folds.keyed_fold(edges, None, ["seq"], folds.union_step("u", "v", "seq"), "seq long, u string, v string, status string, new_component_size int, component_size int")
    return out.select("seq", F.to_json(F.struct("u", "v", "status", "new_component_size", "component_size")).alias("line"))


@query("""with e as (select 'S' || s_suppkey as u, 'N' || s_nationkey as v from supplier union all select 'N' || n_nationkey, 'R' || n_regionkey from nation),
 m as (select u as node, v as up from e union all select v, null from e), r as (select n_nationkey, n_regionkey from nation),
 own as (select distinct node, case node[1] when 'R' then node when 'N' then 'R' || (select n_regionkey from r where 'N' || n_nationkey = node)
 else 'R' || (select n_regionkey from r, supplier where n_nationkey = s_nationkey and 'S' || s_suppkey = node) end as root from m)
 select node, min(node) over (partition by root) as component from own""")
def components_final(spark, sf_dir):
    return folds.components(_edges(spark, sf_dir))


# ---- inference ----


@query(r"""with w as (select doc_id, ('0x' || md5(word)[1:8])::bigint as h from (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as word from documents)),
 v as (select doc_id, h // 2 % 384 as d, sum(case when h % 2 = 1 then 1 else -1 end) as n from w group by 1, 2),
 t as (select doc_id, sum(n * n) as s, arg_min(d, (-abs(n), d)) as top from v group by 1)
 select doc_id, 384 as dimensions, case when coalesce(s, 0) = 0 then 0.0::double else 1.0::double end as norm, cast(case when coalesce(s, 0) = 0 then 0 else top end as int) as strongest from documents left join t using (doc_id)""")
def embeddings(spark, sf_dir):
    """A deterministic stand-in embedder: shape, norm and strongest dimension."""
    out = inference.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    size = F.transform("embedding", lambda x: F.abs(x))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.select("doc_id", F.size("embedding").alias("dimensions"), F.round(norm, 3).alias("norm"), (F.array_position(size, F.array_max(size)) - 1).cast("int").alias("strongest"))


@query("""select 'lines' as kind, count(*) as n, sum(case when try_cast(props as json) is not null then 1 else 0 end)::bigint as valid from events""")
def inspect_counts(spark, sf_dir):
    """An observed pass over the rows (the tap changes nothing)."""
    e = shape.inspect(events(spark, sf_dir), "tap", rows=F.count(F.lit(1)))
    return e.agg(F.lit("lines").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(is_json(F.col("props")).cast("int")).alias("valid"))


from . import exchange, streams  # noqa: E402, F401  they add their queries to the registry
