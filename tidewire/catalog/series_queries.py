"""Time-series operators over events as metric samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.filter_queries import now, samples
from tidewire.catalog.join_queries import VEC, usr, vec
from tidewire.catalog.registry import query
from tidewire.operators import timeseries as T
from tidewire.operators.blocked import Order, scan

DAY = 86400.0


def r6(c):
    return F.round(c, 6)


def counters(t):
    """Counter samples: the running sum of values per (user, type), reset every day."""
    d = t.events.withColumn("day", F.to_date("ts"))
    d = scan(d, ["user_id", "event_type", "day"], Order("ts", ("event_id",)), running={"c": "value"})
    return d.select(F.col("event_type").alias("metric"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), "ts", F.round("c", 6).alias("value"))


COUNTER = """
with c as (select user_id, event_type, ts, round(sum(value) over (partition by user_id, event_type, ts::date order by ts, event_id), 6) as v from events),
w as (select * from c where ts > timestamp '2024-01-18 00:00:00' and ts <= timestamp '2024-01-25 00:00:00'),
d as (select *, lag(v) over (partition by user_id, event_type order by ts) as p from w),
inc as (select event_type, user_id, sum(case when v < p then v else v - p end) as x, count(*) as n, min(epoch_us(ts)) as t0, max(epoch_us(ts)) as t1, arg_min(v, ts) as v0 from d group by all having count(*) >= 2)
"""


@query("t01_instant", VEC + "select event_type as metric, user_id::varchar as usr, v as value from i")
def t01(t):
    return usr(T.instant(samples(t), now(), DAY), "metric", "value")


@query("t02_range_eval", """
with g as (select timestamp '2024-01-20 00:00:00' + interval 1 hour * k as step from range(49) r(k))
select event_type as metric, user_id::varchar as usr, step as ts, arg_max(value, e.ts) as value from g join events e on e.ts <= step and e.ts > step - interval 2 hour group by all""")
def t02(t):
    lit = lambda s: F.lit(s).cast("timestamp")
    return usr(T.range_eval(samples(t), lit("2024-01-20"), lit("2024-01-22"), 3600, 7200), "metric", "ts", "value")


@query("t03_rate", COUNTER + "select event_type as metric, user_id::varchar as usr, round(x / 604800, 12) as value from inc")
def t03(t):
    return usr(T.rate(counters(t), 7 * DAY, now()), "metric", F.round("value", 12).alias("value"))


@query("t03_rate_extrapolated", COUNTER + """
, e as (select *, (t1 - t0) / 1e6::double as span, (t1 - t0) / 1e6::double / (n - 1) as gap, 604800 - (epoch_us(timestamp '2024-01-25') - t0) / 1e6::double as lead0, (epoch_us(timestamp '2024-01-25') - t1) / 1e6::double as trail0 from inc),
f as (select *, least(case when lead0 >= 1.1 * gap then gap / 2 else lead0 end, coalesce(case when x > 0 and v0 >= 0 then span * v0 / x end, 1e18)) as lead, case when trail0 >= 1.1 * gap then gap / 2 else trail0 end as trail from e)
select event_type as metric, user_id::varchar as usr, round(x * (span + lead + trail) / span / 604800, 10) as value from f""")
def t03x(t):
    return usr(T.rate(counters(t), 7 * DAY, now(), extrapolate=True), "metric", F.round("value", 10).alias("value"))


@query("t04_increase", COUNTER + "select event_type as metric, user_id::varchar as usr, round(x, 6) as value from inc")
def t04(t):
    return usr(T.increase(counters(t), 7 * DAY, now()), "metric", r6("value").alias("value"))


_WIN = "where ts > timestamp '2024-01-18 00:00:00' and ts <= timestamp '2024-01-25 00:00:00'"


@query("t05_avg_over_time", f"select event_type as metric, user_id::varchar as usr, round(avg(value), 6) as value from events {_WIN} group by 1, 2")
def t05(t):
    return usr(T.over_time(samples(t), "avg", 7 * DAY, now()), "metric", r6("value").alias("value"))


@query("t06_last_over_time", f"select event_type as metric, user_id::varchar as usr, arg_max(value, ts) as value from events {_WIN} group by 1, 2")
def t06(t):
    return usr(T.over_time(samples(t), "last", 7 * DAY, now()), "metric", "value")


@query("t17_quantile_over_time", f"select event_type as metric, user_id::varchar as usr, round(quantile_cont(value, 0.95), 6) as value from events {_WIN} group by 1, 2")
def t17(t):
    return usr(T.quantile_over_time(samples(t), 0.95, 7 * DAY, now()), "metric", r6("value").alias("value"))


def end_times(t):
    """When the 'error' sample of each user was taken, as an epoch-valued vector."""
    s = T.select_series(samples(t), "error").withColumn("value", F.unix_micros("ts") / F.lit(1e6))
    return T.instant(s, now(), DAY).select("labels", "value")


_FRESH = """
with i as (select event_type, user_id, arg_max(value, ts) as v, max(epoch_us(ts)) as t from events where ts > timestamp '2024-01-24 00:00:00' and ts <= timestamp '2024-01-25 00:00:00' group by all),
live as (select user_id, v from i where event_type = 'view' and v > 0 and user_id in (select user_id from i where event_type = 'click' and v > 0)),
fresh as (select user_id from i where event_type = 'error' and (epoch_us(timestamp '2024-01-25') - t) / 1e6 < 45000)
"""


@query("t07_fresh_gate", _FRESH + "select user_id::varchar as usr, v as value from live where user_id in (select user_id from fresh)")
def t07(t):
    return usr(T.fresh_gate(vec(t, "view"), vec(t, "click"), end_times(t), now(), 45000, ["user"]), "value")


@query("t08_stale_count", _FRESH + """
select left(user_id::varchar, 1) as usr, count(*)::double as value from live where user_id not in (select user_id from fresh) group by 1""")
def t08(t):
    first = lambda v: T.label_replace(v, "group", "$1", "user", "(.).*")
    d = T.stale_count(first(vec(t, "view")), vec(t, "click"), end_times(t), now(), 45000, ["user"], ["user", "group"], ["group"])
    return d.select(T.label("group").alias("usr"), "value")


@query("t09_identity", VEC + "select distinct user_id::varchar as usr, 'fixed' as site, 1.0::double as value from i where event_type = 'view'")
def t09(t):
    v = T.rename_labels(vec(t, "view"), {"client": "user"}, {"site": "fixed"})
    d = T.identity_series(v, ["client", "site"])
    return d.select(T.label("client").alias("usr"), T.label("site").alias("site"), "value")


@query("t10_alias", "select event_id, 'renamed' as metric from events where event_type = 'view'")
def t10(t):
    return T.alias_series(T.select_series(samples(t), "view"), "renamed").select("event_id", "metric")


@query("t11_retry_pct", VEC + """
select a.user_id::varchar as usr, round(100 * a.v / greatest(a.v + b.v, 1), 6) as value from i a join i b on a.user_id = b.user_id where a.event_type = 'error' and b.event_type = 'view' and a.v + b.v > 0""")
def t11(t):
    r = vec(t, "error")
    attempts = T.vec_op(vec(t, "view"), r, "+")
    return usr(T.retry_pct(r, attempts, ["user"]), r6("value").alias("value"))


@query("t12_per_100", VEC + "select a.user_id::varchar as usr, round(100 * a.v / greatest(b.v, 1), 6) as value from i a join i b on a.user_id = b.user_id where a.event_type = 'error' and b.event_type = 'purchase'")
def t12(t):
    return usr(T.per_100(vec(t, "error"), vec(t, "purchase")), r6("value").alias("value"))


@query("t13_ready_ratio", VEC + """
select event_type as metric, round(sum(case when v >= 30 then 1 else 0 end) / greatest(count(*), 1)::double, 6) as ratio, (count(*) - sum(case when v >= 30 then 1 else 0 end))::double as not_ready from i group by 1""")
def t13(t):
    from tidewire.functions.predicates import compare_bool
    v = T.instant(samples(t), now(), DAY).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("kind"), F.col("metric")))).select("labels", "value")
    b = compare_bool(v, ">=", 30)
    a, c = T.ready_ratio(b, ["kind"]), T.not_ready(b, ["kind"])
    k = T.label("kind").alias("metric")
    return a.select(k, r6("value").alias("ratio")).join(c.select(k, F.col("value").alias("not_ready")), "metric")


@query("t13_replication_lag", """
select round((epoch_us(timestamp '2024-01-25') - max(epoch_us(ts))) / 1e6::double, 3) as value from events where event_type = 'error' and ts <= timestamp '2024-01-25' and ts > timestamp '2024-01-24'""")
def t13b(t):
    absent = T.select_series(samples(t), "absent").select("labels", "value")
    return T.replication_lag([absent, end_times(t)], now()).select(F.round("value", 3).alias("value"))


@query("t14_scale", VEC + "select user_id::varchar as usr, round(v * 0.001, 9) as value from i where event_type = 'view'")
def t14(t):
    return usr(T.scale(vec(t, "view"), 0.001), F.round("value", 9).alias("value"))


@query("t16_series_inventory", """
select 'absent' as metric, 'declared_not_seen' as finding union all select distinct event_type, 'seen_not_declared' from events where event_type not in ('view', 'click', 'error')""")
def t16(t):
    declared = t.spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in ("view", "click", "error", "absent")])).alias("metric"))
    return T.series_inventory(samples(t), declared)


@query("a13_series_agg", VEC + """
select left(user_id::varchar, 1) as grp, round(sum(v), 6) as s, round(avg(v), 6) as m, round(stddev_pop(v), 6) as sd, max(v) as hi, count(*)::double as n from i group by 1""")
def a13(t):
    v = T.label_replace(T.instant(samples(t), now(), DAY).select("labels", "value"), "grp", "$1", "user", "(.).*")
    out = None
    for how, name in [("sum", "s"), ("avg", "m"), ("stddev", "sd"), ("max", "hi"), ("count", "n")]:
        d = T.series_agg(v, how, ["grp"]).select(T.label("grp").alias("grp"), (r6("value") if name in ("s", "m", "sd") else F.col("value")).alias(name))
        out = d if out is None else out.join(d, "grp")
    return out


@query("f14_label_replace", """
select event_id, case when regexp_full_match(user_id::varchar, '(\\d)(\\d)') then 'u' || right(user_id::varchar, 1) || left(user_id::varchar, 1) else '' end as swapped from events""")
def f14(t):
    v = samples(t)
    return T.label_replace(v, "swapped", "u$2$1", "user", r"(\d)(\d)").select("event_id", T.label("swapped").alias("swapped"))


@query("k05_topk_series", VEC + "select left(user_id::varchar, 1) as grp, arg_min(user_id::varchar, (-v, user_id::varchar)) as usr, max(v) as value from i where event_type = 'view' group by 1")
def k05(t):
    v = T.label_replace(vec(t, "view"), "grp", "$1", "user", "(.).*")
    d = T.topk_by(v, ["grp"], 1)
    return d.select(T.label("grp").alias("grp"), T.label("user").alias("usr"), "value")


@query("a05_quantile_series", VEC + "select left(user_id::varchar, 1) as grp, round(quantile_cont(v, 0.95), 6) as value from i group by 1")
def a05(t):
    v = T.label_replace(T.instant(samples(t), now(), DAY).select("labels", "value"), "grp", "$1", "user", "(.).*")
    return T.quantile_by(v, 0.95, ["grp"]).select(T.label("grp").alias("grp"), r6("value").alias("value"))
