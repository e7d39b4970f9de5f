"""Streaming and incremental jobs over events; each stream runs to the end of what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.catalog.filter_queries import NOW, now
from tidewire.catalog.registry import query
from tidewire.plans.maintenance import BatchLog, KeyedStore
from tidewire.session import checkpoint_dir
from tidewire.streaming import jobs as X
from tidewire.tables import SCHEMAS

c = F.col


def stream(t, name="events"):
    """The table as a stream of files, be it one file or a folder of part files."""
    files = t.spark.readStream.schema(SCHEMAS[name])
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.path}/{name}.parquet")
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return files.parquet(f"{t.path}/{name}.parquet")
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(t.path)


def place(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def finish(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("x01_ingest_new", "select event_id, value from events")
def x01(t):
    log = BatchLog(t.spark, place(t, "x01"))
    for run in range(2):  # the second run reads everything again and must add nothing
        finish(X.ingest_new(stream(t), place(t, f"x01-ckpt-{run}"), log, ["event_id"], run))
    return log.read().select("event_id", "value")


@query("x01_pending_inputs", """
select 'f' || event_id as path from events where event_type = 'view' or value > 50""")
def x01b(t):
    inv = t.events.select(F.concat(F.lit("f"), c("event_id").cast("string")).alias("path"), F.floor("value").alias("size_bytes"), c("ts").alias("mtime"), "event_type", "value")
    led = inv.filter("event_type <> 'view'").select("path", F.when(c("value") > 50, c("size_bytes") + 1).otherwise(c("size_bytes")).alias("size_bytes"), "mtime", F.lit("h1").alias("config_hash"), F.lit("6").alias("parser_version"))
    return X.pending_inputs(inv, led, "h1", "6").select("path")


STABLE = """
with o as (select event_id, user_id as path, ts, event_type as sig from events),
l as (select *, lag(sig) over w as before, row_number() over w as n from o window w as (partition by path order by ts, event_id)),
s as (select *, last_value(case when n = 1 or sig is distinct from before then ts end ignore nulls) over (partition by path order by ts, event_id) as since from l)
select event_id, case when n = 1 then 'wait_new' when sig is distinct from before then 'wait_changed' when epoch_us(ts) - epoch_us(since) < 20000 * 1000000::bigint then 'wait_too_soon' else 'ready' end as decision from s"""


@query("x02_stability", STABLE)
def x02(t):
    d = t.events.select("event_id", c("user_id").alias("path"), "ts", c("event_type").alias("sig"))
    return X.stability_decisions(d, "path", "ts", ["sig"], 20000.0, tie="event_id").select("event_id", "decision")


@query("x02_stability_stream", STABLE.replace("select event_id, case", "select path, ts, case"))
def x02s(t):
    state, sink = KeyedStore(t.spark, place(t, "x02"), ["path"]), BatchLog(t.spark, place(t, "x02"))
    s = stream(t).select("event_id", c("user_id").alias("path"), "ts", c("event_type").alias("sig"))
    finish(X.stream_stability(s, place(t, "x02-ckpt"), state, sink, "path", "ts", ["sig"], 20000.0, "event_id"))
    return sink.latest(["path", "ts", "event_id"]).select("path", "ts", "decision")


@query("x03_idempotent_append", "select min(event_id) as event_id, user_id, event_type from events where event_type <> 'view' group by user_id, event_type")
def x03(t):
    stored = t.events.filter("event_type = 'view'").select("event_id", "user_id", "event_type")
    d = X.idempotent_append(t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id")), stored, ["user_id", "event_type"])
    return d.select("event_id", "user_id", "event_type")


@query("x04_split_late", f"""
select event_id, case when ts > timestamp '{NOW}' + interval 5 minute then 'future' when ts <= timestamp '{NOW}' - interval 20 day then 'stale' else 'ok' end as lateness from events""")
def x04(t):
    return X.split_late(t.events, "ts", now(), 300, 20 * 86400).select("event_id", "lateness")


INCR = """
with i as (select *, value - lag(value) over w as d, lag(value) over w as p from events window w as (partition by user_id order by ts, event_id)),
r as (select *, case when value < p then value else d end as x from i where p is not null)
"""


@query("x05_stream_rate", INCR + """
, w as (select user_id, x, unnest([0, 1, 2, 3]) as k, date_trunc('day', ts) + interval 6 hour * (hour(ts) // 6) as base from r)
select user_id, base - interval 6 hour * k as window_start, round(sum(x) / 86400, 9) as rate from w group by 1, 2""")
def x05(t):
    state, sink = KeyedStore(t.spark, place(t, "x05"), ["user_id"]), BatchLog(t.spark, place(t, "x05"))
    finish(X.stream_rate_increments(stream(t), place(t, "x05-ckpt"), state, sink, ["user_id"], "ts", "value", "event_id"))
    d = X.window_rate(sink.latest(["user_id", "ts", "event_id"]), ["user_id"], "ts", "1 day", "6 hours")
    return d.select("user_id", "window_start", F.round("rate", 9).alias("rate"))


@query("x06_stream_avg", """
select date_trunc('day', ts) as window_start, event_type, round(avg(value), 6) as avg_value, count(*) as n from events group by 1, 2""")
def x06(t):
    log = BatchLog(t.spark, place(t, "x06"))
    finish(X.stream_sums(stream(t), place(t, "x06-ckpt"), log, ["event_type"], "ts", "value", "1 day"))
    return X.merged_avg(log.read(), ["event_type"]).select("window_start", "event_type", F.round("avg_value", 6).alias("avg_value"), "n")


@query("x07_stream_latest", "select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id from events group by 1, 2")
def x07(t):
    state = KeyedStore(t.spark, place(t, "x07"), ["user_id", "event_type"])
    finish(X.stream_latest(stream(t), place(t, "x07-ckpt"), state, ["user_id", "event_type"], "ts", "event_id"))
    return state.read().select("user_id", "event_type", "event_id")


@query("x08_alerts", """
with e as (select event_id, user_id, ts, value < 30 as bad, lag(value < 30) over w as was, lag(ts) over w as pts from events window w as (partition by user_id order by ts, event_id)),
b as (select *, bad and (not coalesce(was, false) or coalesce((epoch_us(ts) - epoch_us(pts)) > 86400000000, false)) as begins, coalesce((epoch_us(ts) - epoch_us(pts)) > 86400000000, false) as gap from e),
s as (select *, last_value(case when begins and gap then pts when begins then ts end ignore nulls) over (partition by user_id order by ts, event_id) as start from b)
select event_id, case when not bad then 'normal' when epoch_us(ts) - epoch_us(start) >= 36000000000 then 'firing' else 'pending' end as state, case when bad then start end as since from s""")
def x08(t):
    return X.alerts(t.events, ["user_id"], "ts", "value", 30, 36000, no_data=86400, tie="event_id").select("event_id", "state", "since")


@query("x09_stream_relabel", "select event_id, event_type as metric from events where event_type in ('view', 'click')")
def x09(t):
    sink = BatchLog(t.spark, place(t, "x09"))
    s = X.stream_relabel(stream(t).select("event_id", c("event_type").alias("metric")), "vi.*|cl.*")
    finish(X.ingest_new(s, place(t, "x09-ckpt"), sink, ["event_id"]))
    return sink.read().select("event_id", "metric")


@query("x10_ingest_health", """
select count(*) filter (where o_orderstatus = 'O') as pending, greatest((epoch_us(timestamp '2002-01-01') - epoch_us(min(o_orderdate) filter (where o_orderstatus = 'O'))) / 1e6::double, 0) as oldest_pending_seconds,
 count(*) filter (where o_orderstatus = 'P') as retry_pending, max(o_orderdate) filter (where o_orderstatus = 'F') as last_success from orders""")
def x10(t):
    return X.ingest_health(t.orders, "o_orderstatus", "o_orderdate", F.lit("2002-01-01").cast("timestamp"), ["O"], ["P"], ["F"], "o_orderpriority")[0]


@query("x10_quarantine_reasons", "select coalesce(nullif(o_orderpriority, '5-LOW'), 'unknown') as reason, count(*) as n from orders where o_orderstatus = 'P' group by 1")
def x10b(t):
    d = t.orders.select(F.when(c("o_orderstatus") == "P", "quarantined").otherwise("parsed").alias("s"), "o_orderdate", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("reason"))
    return X.ingest_health(d, "s", "o_orderdate", now(), [], [], ["parsed"], "reason")[1]


@query("x11_stream_counter_delta", """
with s as (select event_id, user_id, ts, case when event_type <> 'error' then value end as v from events),
p as (select *, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as pv from s)
select event_id, case when pv is null or v is null then 0.0 else round(greatest(v - pv, 0), 6) end::double as delta from p""")
def x11(t):
    state, sink = KeyedStore(t.spark, place(t, "x11"), ["user_id"]), BatchLog(t.spark, place(t, "x11"))
    s = stream(t).select("event_id", "user_id", "ts", F.when(c("event_type") != "error", c("value")).alias("v"))
    finish(X.stream_counter_delta(s, place(t, "x11-ckpt"), state, sink, ["user_id"], "ts", "v", "event_id"))
    return sink.latest(["user_id", "ts", "event_id"]).select("event_id", F.round("delta", 6).alias("delta"))


@query("x12_open_intervals", """
with e as (select event_id, user_id, ts, case event_type when 'signup' then 'start' when 'purchase' then 'stop' end as k from events where event_type in ('signup', 'purchase')),
n as (select *, lead(k) over w as nk, lead(ts) over w as nt from e window w as (partition by user_id order by ts, event_id))
select user_id, event_id as start_id, ts as started_at, case when nk = 'stop' then nt end as ended_at, case nk when 'stop' then 'closed' when 'start' then 'violation' else 'open' end as status from n where k = 'start'""")
def x12(t):
    return X.open_intervals(t.events, ["user_id"], "ts", c("event_type") == "signup", c("event_type") == "purchase", "event_id")
