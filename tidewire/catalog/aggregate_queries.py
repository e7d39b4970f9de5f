"""Aggregates over the input and derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.filter_queries import SEVERITY_SQL, severity_cols
from tidewire.catalog.join_queries import NEAREST, view_click
from tidewire.catalog.registry import query
from tidewire.functions.predicates import trusted
from tidewire.operators import aggregates as A
from tidewire.operators import setops as U
from tidewire.operators.blocked import Order
from tidewire.session import checkpointed


def rounded(df, places=6, skip=()):
    """Round every double so that both engines print the same digits."""
    return df.select(*[F.round(c, places).alias(c) if k == "double" and c not in skip else F.col(c) for c, k in df.dtypes])


@query("a01_basic", """
select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as total, round(avg(l_quantity), 4) as mean, min(l_quantity) as low, max(l_quantity) as high
from lineitem group by 1, 2""")
def a01(t):
    g = A.basic(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity")
    return g.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("a02_filtered", """
select l_suppkey, count(*) filter (where l_returnflag = 'A') as n_a, round(coalesce(sum(l_extendedprice) filter (where l_linestatus = 'O'), 0), 2) as open_price,
  max(l_shipdate) filter (where l_quantity > 40) as last_big from lineitem group by 1""")
def a02(t):
    c = F.col
    return A.agg_if(t.lineitem, ["l_suppkey"], n_a=A.count_where(c("l_returnflag") == "A"),
                    open_price=F.round(F.coalesce(A.sum_where(c("l_linestatus") == "O", c("l_extendedprice")), F.lit(0.0)), 2),
                    last_big=F.max(F.when(c("l_quantity") > 40, c("l_shipdate"))))


@query("a03_count_distinct", """
select l_returnflag, count(distinct l_orderkey) as orders, count(distinct l_partkey) filter (where l_quantity >= 25) as big_parts from lineitem group by 1""")
def a03(t):
    a = A.count_distinct(t.lineitem, ["l_returnflag"], "l_orderkey", out="orders")
    return a.join(A.count_distinct(t.lineitem, ["l_returnflag"], "l_partkey", F.col("l_quantity") >= 25, "big_parts"), "l_returnflag")


@query("a04_pctl_cont", """
select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 3) as p05, round(quantile_cont(l_extendedprice, 0.5), 3) as p50, round(quantile_cont(l_extendedprice, 0.95), 3) as p95
from lineitem group by 1""")
def a04(t):
    return rounded(A.pctl_cont(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), 3)


@query("a04_pctl_cont_small_groups", """
select o_custkey, round(quantile_cont(o_totalprice, 0.5), 3) as p50, round(quantile_cont(o_totalprice, 0.9), 3) as p90 from orders group by 1""")
def a04s(t):
    return rounded(A.pctl_cont(t.orders, ["o_custkey"], "o_totalprice", {"p50": 0.5, "p90": 0.9}), 3)


@query("a05_quantile_by", "select event_type, round(quantile_cont(value, 0.95), 4) as q95 from events group by 1")
def a05(t):
    return rounded(A.pctl_cont(t.events, ["event_type"], "value", {"q95": 0.95}), 4)


_RANK = """
with s as (select event_type, user_id, value, row_number() over (partition by event_type, user_id order by value) as rn, count(*) over (partition by event_type, user_id) as n from events)
select event_type, user_id, max(value) filter (where rn = {a}) as p50, max(value) filter (where rn = {b}) as p95 from s group by all"""


@query("a06_pctl_nearest_rank", _RANK.format(a="greatest(1, ceil(n * 0.5::double))", b="greatest(1, ceil(n * 0.95::double))"))
def a06(t):
    return A.pctl_nearest_rank(t.events, ["event_type", "user_id"], "value", {"p50": 0.5, "p95": 0.95})


@query("a07_pctl_floor_index", _RANK.format(a="floor(n * 0.5::double) + 1", b="floor(n * 0.95::double) + 1"))
def a07(t):
    return A.pctl_floor_index(t.events, ["event_type", "user_id"], "value", {"p50": 0.5, "p95": 0.95})


@query("a08_stddev_samp", "select user_id, round(stddev_samp(value), 5) as sd from events group by 1")
def a08(t):
    return rounded(A.stddev_sample(t.events, ["user_id"], "value"), 5)


@query("a08_stddev_pop", "select user_id, round(stddev_pop(value), 5) as sd from events group by 1")
def a08p(t):
    return rounded(A.stddev_population(t.events, ["user_id"], "value"), 5)


@query("a09_mean_ci", """
with g as (select event_type, count(*) as n, avg(value) as m, stddev_pop(value) as sd from events group by 1)
select event_type, n, round(m, 5) as mean, round(sd, 5) as sd, round(sd / sqrt(n), 5) as sem, round(m - 1.96 * sd / sqrt(n), 5) as ci_low, round(m + 1.96 * sd / sqrt(n), 5) as ci_high from g""")
def a09(t):
    return rounded(A.mean_ci(t.events, ["event_type"], "value", A.Z95_SHORT, population=True), 5)


_DESC = """
with g as (select user_id, count(value) as n, avg(value) as m, {sd} as sd, {var} as vr, min(value) as low, max(value) as high, {q} from events group by 1)
select user_id, n, round(m, 6) as mean, round(sd, 6) as sd, round(vr, 6) as variance, round(low, 6) as low, round(high, 6) as high, {qr},
 round(high - low, 6) as range, round(p75 - p25, 6) as iqr, round(sd / sqrt(n), 6) as sem, round(m - {z} * sd / sqrt(n), 6) as ci_low, round(m + {z} * sd / sqrt(n), 6) as ci_high from g"""


def _desc_sql(z, qs, zero):
    return _DESC.format(z=z, sd="coalesce(stddev_samp(value), 0)" if zero else "stddev_samp(value)", var="coalesce(var_samp(value), 0)" if zero else "var_samp(value)",
                        q=", ".join(f"quantile_cont(value, 0.{q}) as p{q}" for q in qs), qr=", ".join(f"round(p{q}, 6) as p{q}" for q in qs))


def _desc(t, flavour):
    d = A.describe_metric(t.events, ["user_id"], "value", flavour)
    return d if flavour == "study" else rounded(d)


@query("a10_describe_study", _desc_sql("1.959963984540054", ["05", "25", "50", "75", "95"], False))
def a10(t):
    return _desc(t, "study")


@query("a10_describe_rf", _desc_sql("1.96", ["25", "50", "75", "90", "95"], True))
def a10r(t):
    return _desc(t, "rf")


@query("a11_weighted_mean", "select l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) as weighted_mean from lineitem group by 1")
def a11(t):
    return rounded(A.weighted_mean(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity"), 3)


@query("a12_safe_ratio", """
with g as (select l_partkey, count(*) filter (where l_returnflag = 'A') as a, count(*) filter (where l_linestatus = 'O' and l_linenumber = 1) as b from lineitem group by 1)
select l_partkey, round(a::double / nullif(b, 0), 6) as ratio, round(a / greatest(b, 1.0::double), 6) as clamped from g""")
def a12(t):
    c = F.col
    g = t.lineitem.groupBy("l_partkey").agg(A.count_where(c("l_returnflag") == "A").alias("a"),
                                            A.count_where((c("l_linestatus") == "O") & (c("l_linenumber") == 1)).alias("b"))
    return g.select("l_partkey", F.round(A.safe_ratio(c("a"), c("b")), 6).alias("ratio"), F.round(A.safe_ratio(c("a"), c("b"), "clamp"), 6).alias("clamped"))


@query("a14_any_true", "select l_orderkey, bool_or(l_quantity > 45) as seen from lineitem group by 1")
def a14(t):
    return A.any_true(t.lineitem, ["l_orderkey"], F.col("l_quantity") > 45)


@query("a15_string_list", "select user_id, string_agg(distinct event_type, ', ' order by event_type) as items from events group by 1")
def a15(t):
    return A.string_list(t.events, ["user_id"], "event_type")


@query("a15_ordered_lines", """
select c_nationkey, string_agg(c_name, chr(10) order by c_acctbal, c_custkey) filter (where c_mktsegment = 'MACHINERY') as items from customer group by 1""")
def a15b(t):
    return A.ordered_lines(t.customer, ["c_nationkey"], F.col("c_name"), ["c_acctbal", "c_custkey"], F.col("c_mktsegment") == "MACHINERY", "items")


@query("a15_ordered_parts", """
with n as (select c_nationkey, c_name, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as i from customer where c_mktsegment <> 'MACHINERY')
select c_nationkey, ((i - 1) // 7)::bigint as part, min(i) as first_item, count(*) as n_items, string_agg(c_name, chr(10) order by i) as items from n group by 1, 2""")
def a15p(t):
    return A.ordered_parts(t.customer, ["c_nationkey"], F.col("c_name"), Order("c_acctbal", ("c_custkey",)), F.col("c_mktsegment") != "MACHINERY", size=7)


@query("a15_distinct_parts", """
with d as (select distinct event_type, user_id from events where user_id is not null), n as (select *, row_number() over (partition by event_type order by user_id) as i from d)
select event_type, ((i - 1) // 16)::bigint as part, min(i) as first_item, count(*) as n_items, string_agg(user_id::varchar, ', ' order by i) as items from n group by 1, 2""")
def a15d(t):
    return A.distinct_parts(t.events, ["event_type"], "user_id", size=16)


@query("a16_set_sorted", """
select l_suppkey, array_to_string(list_sort(list(distinct case when l_linenumber > 1 then l_linenumber end) filter (where l_linenumber > 1)), ',') as items from lineitem group by 1""")
def a16(t):
    s = A.set_sorted(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.transform(s, lambda x: x.cast("string")), ",").alias("items"))


@query("a17_pivot_roles", ctes("streams") + """
select server_key, max(packet_count) filter (where device_role = 'control') as control_packet_count, max(packet_count) filter (where device_role = 'test') as test_packet_count,
 max(loss_ratio) filter (where device_role = 'control') as control_loss_ratio, max(loss_ratio) filter (where device_role = 'test') as test_loss_ratio from streams group by 1""")
def a17(t):
    return A.pivot_roles(frame(t, "streams"), ["server_key"], "device_role", ["control", "test"], ["packet_count", "loss_ratio"])


@query("a18_control_test_delta", ctes("streams") + """
, p as (select max(loss_ratio) filter (where device_role = 'control') as cl, max(loss_ratio) filter (where device_role = 'test') as tl,
  sum(packet_count) filter (where device_role = 'control') as cp, sum(packet_count) filter (where device_role = 'test') as tp from streams)
select 'loss %' as metric, cl * 100 as control_value, tl * 100 as test_value, tl * 100 - cl * 100 as delta from p
union all select 'packets', cp::double, tp::double, (tp - cp)::double from p""")
def a18(t):
    g = frame(t, "streams").groupBy("device_role").agg(F.max("loss_ratio").alias("loss"), F.sum("packet_count").alias("packets"))
    wide = A.pivot_roles(g, [], "device_role", ["control", "test"], ["loss", "packets"])
    return A.control_test_delta(wide, [("loss %", "loss", 100.0), ("packets", "packets", 1.0)])


@query("a19_hierarchy_rollup", """
with o as (select l_orderkey, count(*) as streams, min(l_shipdate) as first_time, max(l_shipdate) as last_time from lineitem group by 1),
c as (select o_custkey, count(*) as captures, sum(streams) as streams, min(first_time) as first_time, max(last_time) as last_time from orders left join o on l_orderkey = o_orderkey group by 1),
n as (select c_nationkey, count(*) as studies, sum(captures) as captures, sum(streams) as streams, min(first_time) as first_time, max(last_time) as last_time from customer left join c on o_custkey = c_custkey group by 1)
select r_name, count(*) as projects, sum(studies)::bigint as studies, sum(captures)::bigint as captures, sum(streams)::bigint as streams, min(first_time) as first_time, max(last_time) as last_time
from nation join region on n_regionkey = r_regionkey left join n on c_nationkey = n_nationkey group by 1""")
def a19(t):
    c, times = F.col, dict(mins=["first_time"], maxs=["last_time"])
    lines = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), c("l_shipdate").alias("first_time"), c("l_shipdate").alias("last_time"))
    per_order = A.staged_rollup(lines, ["o_orderkey"], [], members="streams", **times)
    per_cust = A.staged_rollup(t.orders.join(per_order, "o_orderkey", "left"), ["o_custkey"], ["streams"], members="captures", **times)
    cust = t.customer.join(per_cust, c("o_custkey") == c("c_custkey"), "left")
    per_nation = A.staged_rollup(cust, ["c_nationkey"], ["captures", "streams"], members="studies", **times)
    nat = t.nation.join(per_nation, c("c_nationkey") == c("n_nationkey"), "left").join(t.region, c("n_regionkey") == c("r_regionkey"))
    return A.staged_rollup(nat, ["r_name"], ["studies", "captures", "streams"], members="projects", **times)


@query("a20_scope_panel", """
with s as (select unnest(['AUTOMOBILE', 'MACHINERY', 'AIRPLANES']) as scope)
select scope, coalesce(n, 0) as n, coalesce(m, 0) as m, bal from s left join (select c_mktsegment as g, count(*) as n, round(avg(c_acctbal), 3) as bal from customer group by 1) a on a.g = scope
left join (select c_mktsegment as g, count(*) as m from customer join orders on o_custkey = c_custkey group by 1) b on b.g = scope""")
def a20(t):
    key = F.col("c_mktsegment").alias("scope")
    a = t.customer.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 3).alias("bal"))
    b = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(key).agg(F.count(F.lit(1)).alias("m"))
    return A.scope_panel(t.spark, ["AUTOMOBILE", "MACHINERY", "AIRPLANES"], [a, b], ["n", "m"])


@query("a21_mode_first", """
with g as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by all)
select user_id, arg_min(event_type, (-n, f)) as mode from g group by 1""")
def a21(t):
    return A.mode_first(t.events, ["user_id"], "event_type", "event_id")


@query("a22_count_unique", "select event_type, count(distinct user_id) as unique_count from events group by 1")
def a22(t):
    return A.count_unique_by(t.events, ["event_type"], "user_id")


@query("a23_adoption", """
select event_type, round(count(distinct user_id) filter (where value > 60) / greatest(count(distinct user_id), 1)::double, 6) as adoption_ratio from events group by 1""")
def a23(t):
    return rounded(A.adoption_ratio(t.events, ["event_type"], "user_id", F.col("value") > 60))


@query("a24_histogram", """
with b as (select least(greatest(floor((value - 5) / 95.0::double * 25), 0), 24)::int as bin, count(*) as n from events group by 1)
select i::int as bin, round(5 + i * 3.8, 6)::double as x0, round(5 + (i + 1) * 3.8, 6)::double as x1, coalesce(n, 0) as n from range(25) r(i) left join b on bin = i""")
def a24(t):
    return rounded(A.histogram(t.events, "value", 5, 100, 25))


@query("a25_histogram_quantile", """
with b as (select event_type, le, count(*) filter (where value <= le) as c from events, (select unnest([5.0, 10.0, 25.0, 50.0, 100.0]::double[]) as le) group by all),
t as (select event_type, count(*) as n, count(*) * 0.9::double as r from events group by 1),
w as (select *, lag(c, 1, 0) over (partition by event_type order by le) as pc, lag(le, 1, 0) over (partition by event_type order by le) as pl from b)
select t.event_type, round(coalesce(min(pl + (le - pl) * (r - pc) / (c - pc)) filter (where c >= r and pc < r), 100), 6) as quantile from t join w on w.event_type = t.event_type group by 1""")
def a25(t):
    bounds = F.array(*[F.lit(str(b)) for b in (5.0, 10.0, 25.0, 50.0, 100.0)], F.lit("+Inf"))
    spread = t.events.select("event_type", "value", F.explode(bounds).alias("le"))
    num = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    b = spread.groupBy("event_type", "le").agg(A.count_where(F.col("value") <= num).cast("double").alias("value"))
    return rounded(A.histogram_quantile(b, ["event_type"], 0.9))


@query("a26_tolerance_sweep", NEAREST + """
, w as (select unnest([1, 60, 600, 1800, 3600])::int as window_seconds),
m as (select window_seconds, click_id, abs(delta) as d, count(*) over (partition by window_seconds, click_id) as k from near join w on abs(delta) <= window_seconds)
select w.window_seconds, count(m.d) as matched_points, count(m.d) filter (where d > 0.8 * m.window_seconds) as near_edge_points, count(m.d) filter (where k > 1) as ambiguous_points
from w left join m on m.window_seconds = w.window_seconds group by 1""")
def a26(t):
    return A.tolerance_sweep(checkpointed(view_click(t)), [600, 60, 3600, 1800, 1], "nearest_delta", "nearest_id")


@query("a26_sweep_summary", NEAREST + """
select count(*) as point_count, round(min(abs(delta)), 3) as abs_min, round(quantile_cont(abs(delta), 0.5), 2) as abs_median, round(quantile_cont(abs(delta), 0.9), 2) as abs_p90,
 round(quantile_cont(delta, 0.5), 2) as signed_median from near""")
def a26b(t):
    d = A.sweep_summary(checkpointed(view_click(t)), "nearest_delta")
    return d.select("point_count", F.round("abs_min", 3).alias("abs_min"), *[F.round(c, 2).alias(c) for c in ("abs_median", "abs_p90", "signed_median")])


RUNS_SQL = """
with r as (select c_custkey as run_id, c_nationkey as study_id, c_custkey % 7 + 1 as win from customer),
k as (select o_custkey as run_id, count(*) as candidate_count, count(*) filter (where o_orderstatus = 'P') as pending_count, count(*) filter (where o_orderstatus = 'F') as completed_count from orders group by 1),
m as (select o_custkey as run_id, o_totalprice / 1000 as v from orders where o_orderstatus = 'F'),
s as (select run_id, avg(v) as mean_delta, stddev_samp(v) as stddev_delta, min(v) as min_delta, max(v) as max_delta, quantile_cont(v, 0.95) as p95_delta from m group by 1),
x as (select run_id, count(*) as outlier_count from m where v > 400 group by 1),
cmp as (select r.*, coalesce(candidate_count, 0) as candidate_count, coalesce(pending_count, 0) as pending_count, coalesce(completed_count, 0) as completed_count, mean_delta, stddev_delta, p95_delta, min_delta, max_delta,
  coalesce(outlier_count, 0) as outlier_count from r left join k on k.run_id = r.run_id left join s on s.run_id = r.run_id left join x on x.run_id = r.run_id)
"""


def compared_runs(t):
    c = F.col
    r = t.customer.select(c("c_custkey").alias("run_id"), c("c_nationkey").alias("study_id"), (c("c_custkey") % 7 + 1).alias("win"))
    o = t.orders.withColumnRenamed("o_custkey", "run_id")
    k = o.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidate_count"), A.count_where(c("o_orderstatus") == "P").alias("pending_count"),
                                A.count_where(c("o_orderstatus") == "F").alias("completed_count"))
    from tidewire.operators.joins import rollup_left
    runs = rollup_left(r, k, ["run_id"], ["candidate_count", "pending_count", "completed_count"])
    m = o.filter(c("o_orderstatus") == "F").select("run_id", (c("o_totalprice") / 1000).alias("v"))
    return A.run_comparison(runs, m, m.filter(c("v") > 400), "run_id", "v")


@query("a27_run_comparison", RUNS_SQL + """
select run_id, study_id, win, candidate_count, pending_count, completed_count, round(mean_delta, 8) as mean_delta, round(stddev_delta, 8) as stddev_delta, round(p95_delta, 8) as p95_delta,
 round(min_delta, 8) as min_delta, round(max_delta, 8) as max_delta, outlier_count,
 case when completed_count + pending_count > 0 then round(100.0::double * completed_count / (completed_count + pending_count), 1) end as completion_percent from cmp""")
def a27(t):
    return rounded(compared_runs(t), 8)


@query("a27_comparison_trend", RUNS_SQL + """
, g as (select study_id, count(distinct win) as window_count, arg_min((candidate_count, outlier_count), (win, run_id)) as lo, arg_min((candidate_count, outlier_count), (-win, run_id)) as hi from cmp group by 1)
select study_id, window_count, case when window_count >= 2 then case when hi[1] > lo[1] then 'increased' when hi[1] < lo[1] then 'decreased' else 'held steady' end end as candidate_direction,
 case when window_count >= 2 then case when hi[2] > lo[2] then 'increased' when hi[2] < lo[2] then 'decreased' else 'held steady' end end as outlier_direction from g""")
def a27b(t):
    return A.comparison_trend(compared_runs(t), ["study_id"], "win", "run_id")


@query("a29_triage", ctes("streams") + SEVERITY_SQL + """
select count(*) filter (where coalesce(review_status, 'unreviewed') = 'unreviewed') as unreviewed, count(*) filter (where review_status = 'accepted') as accepted,
 count(*) filter (where review_status = 'needs_review') as needs_review, count(*) filter (where review_status = 'excluded') as excluded, count(*) filter (where dscp_mismatch) as dscp_mismatch,
 count(*) filter (where reasons like '%Loss%') as loss_warnings, count(*) filter (where reasons like '%Jitter%' or reasons like '%Timing%') as timing_warnings,
 count(*) filter (where severity = 'critical') as critical from lev""")
def a29(t):
    s = severity_cols()
    d = frame(t, "streams").select("review_status", "dscp_mismatch", s["severity"].alias("severity"), s["reasons"].alias("reasons"))
    w, c = A.count_where, F.col
    has = lambda *p: F.exists(c("reasons"), lambda r: F.lit(False) if not p else r.rlike("^(?:" + "|".join(p) + ")"))
    return d.agg(w(F.coalesce("review_status", F.lit("unreviewed")) == "unreviewed").alias("unreviewed"),
                 *[w(c("review_status") == r).alias(r) for r in ("accepted", "needs_review", "excluded")], w(c("dscp_mismatch")).alias("dscp_mismatch"),
                 w(has("Loss")).alias("loss_warnings"), w(has("Jitter", "Timing")).alias("timing_warnings"), w(c("severity") == "critical").alias("critical"))


@query("a30_rejection_reasons", ctes("streams") + """
, r as (select capture_id, packet_count, unnest(case when server_key % 3 = 0 then ['']::varchar[] when server_key % 3 = 1 then ['too_few_packets', 'duration_too_short'] else [null]::varchar[] end) as reason
  from streams where measurement_mode = 'rtp_candidate_rejected')
select coalesce(nullif(reason, ''), 'unspecified') as reason, count(distinct capture_id) as captures, count(*) as streams, sum(packet_count)::bigint as packets from r group by 1""")
def a30(t):
    k = F.col("server_key") % 3
    reasons = F.when(k == 0, F.array(F.lit(""))).when(k == 1, F.array(F.lit("too_few_packets"), F.lit("duration_too_short"))).otherwise(F.array().cast("array<string>"))
    d = frame(t, "streams").filter(F.col("measurement_mode") == "rtp_candidate_rejected").select("capture_id", "packet_count", reasons.alias("reasons"))
    return A.explode_reasons(d, "reasons").groupBy("reason").agg(F.count_distinct("capture_id").alias("captures"), F.count(F.lit(1)).alias("streams"), F.sum("packet_count").alias("packets"))


@query("a31_distribution", """
select l_linenumber, l_returnflag, count(*) as attempts, count(*) filter (where o_orderstatus = 'P') as missed, count(*) filter (where o_orderpriority = '1-URGENT') as failed
from lineitem join orders on l_orderkey = o_orderkey where l_linestatus = 'O' group by 1, 2""")
def a31(t):
    c = F.col
    d = t.lineitem.filter(c("l_linestatus") == "O").join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return A.agg_if(d, ["l_linenumber", "l_returnflag"], attempts=F.count(F.lit(1)), missed=A.count_where(c("o_orderstatus") == "P"), failed=A.count_where(c("o_orderpriority") == "1-URGENT"))


@query("a32_neighbor_stats", """
with n as (select l_suppkey, -40 - l_quantity::int as rssi, case when l_linenumber < 7 then l_linenumber * 4 + 32 end as ch from lineitem)
select l_suppkey, count(*) as neighbor_count, max(rssi) as strongest_dbm, min(rssi) as weakest_dbm, round(avg(rssi), 5) as mean_dbm, count(*) filter (where rssi >= -65) as ge_neg65, count(*) filter (where rssi >= -75) as ge_neg75,
 count(*) filter (where rssi >= -80) as ge_neg80, count(*) filter (where rssi >= -85) as ge_neg85, count(distinct ch) as unique_channels, array_to_string(list_sort(list(distinct ch) filter (where ch is not null)), ',') as channel_list from n group by 1""")
def a32(t):
    d = t.lineitem.select("l_suppkey", (-40 - F.col("l_quantity").cast("int")).alias("rssi"), F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 4 + 32).alias("ch"))
    return rounded(A.neighbor_stats(d, ["l_suppkey"], "rssi", "ch", [-65, -75, -80, -85]), 5)


@query("a33_state_counts", """
select coalesce(capture_point, 'unknown') as state, count(*) as n, max(parsed_at) filter (where capture_point = 'cpF') as last_success from (""" + ctes("captures") + """ select * from captures) group by 1""")
def a33(t):
    return A.state_counts(frame(t, "captures"), "capture_point", "parsed_at", ["cpF"])


@query("a34_compare_counters", """
with a as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by all), b as (select o_orderstatus, case when o_totalprice > 490000 then '0-HOT' else o_orderpriority end as o_orderpriority, count(*) as n from orders group by all)
select coalesce(a.o_orderstatus, b.o_orderstatus) as o_orderstatus, coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority, coalesce(a.n, 0) as left_count, coalesce(b.n, 0) as right_count, coalesce(a.n, 0) - coalesce(b.n, 0) as difference
from a full join b on a.o_orderstatus = b.o_orderstatus and a.o_orderpriority = b.o_orderpriority where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def a34(t):
    b = t.orders.withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 490000, "0-HOT").otherwise(F.col("o_orderpriority")))
    return A.compare_counters(t.orders, b, ["o_orderstatus", "o_orderpriority"])


@query("a36_rf_report", """
with s as (select l_suppkey, count(*) as nb from lineitem group by 1), j as (select 'site' || (s_nationkey % 5) as site, nb, s_nationkey from s join supplier on s_suppkey = l_suppkey)
select site, count(*) as n, round(avg(nb), 5) as mean, round(coalesce(stddev_samp(nb), 0), 5) as sd, round(quantile_cont(nb, 0.9), 4) as p90, count(*) filter (where s_nationkey < 8) as dfs_radios, count(*) filter (where s_nationkey = 3) as cac_running from j group by 1""")
def a36(t):
    s = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).cast("double").alias("nb"))
    j = s.join(t.supplier, "s_suppkey").withColumn("site", F.concat(F.lit("site"), (F.col("s_nationkey") % 5).cast("string")))
    d = A.describe_metric(j, ["site"], "nb", "rf").select("site", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), F.round("p90", 4).alias("p90"))
    return d.join(A.agg_if(j, ["site"], dfs_radios=A.count_where(F.col("s_nationkey") < 8), cac_running=A.count_where(F.col("s_nationkey") == 3)), "site")


@query("a37_parse_summary", ctes("captures", "streams") + """
select c.study_id, count(distinct c.capture_id) as captures, count(s.stream_id) as streams, count(*) filter (where measurement_mode = 'rtp' and packet_count >= 20) as trusted,
 count(*) filter (where dscp_mismatch) as mismatch, count(*) filter (where coalesce(lost_packets, 0) > 0 or coalesce(loss_ratio, 0) > 0) as lossy
from captures c left join streams s on s.capture_id = c.capture_id group by 1""")
def a37(t):
    c = F.col
    per = A.agg_if(frame(t, "streams"), ["capture_id"], streams=F.count(F.lit(1)), trusted=A.count_where(trusted(c("measurement_mode"), c("packet_count"))),
                   mismatch=A.count_where(c("dscp_mismatch")), lossy=A.count_where((F.coalesce("lost_packets", F.lit(0)) > 0) | (F.coalesce("loss_ratio", F.lit(0.0)) > 0)))
    d = frame(t, "captures").select("study_id", "capture_id").join(per, "capture_id", "left")
    return d.groupBy("study_id").agg(F.count(F.lit(1)).alias("captures"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("streams", "trusted", "mismatch", "lossy")])


@query("u01_union_all", "select o_orderkey as id, 'order' as kind, o_orderdate as at from orders union all select l_orderkey, 'line', l_shipdate from lineitem")
def u01(t):
    c = F.col
    return U.union_all(t.orders.select(c("o_orderkey").alias("id"), F.lit("order").alias("kind"), c("o_orderdate").alias("at")),
                       t.lineitem.select(c("l_orderkey").alias("id"), F.lit("line").alias("kind"), c("l_shipdate").alias("at")))


@query("u02_union_distinct", "select s_nationkey as site from supplier union select c_nationkey from customer")
def u02(t):
    return U.union_distinct(t.supplier.select(F.col("s_nationkey").alias("site")), t.customer.select(F.col("c_nationkey").alias("site")))


@query("u03_except_all", """
select 'left' as side, * from (select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R' except all select l_orderkey, l_linenumber from lineitem where l_linestatus = 'O')
union all select 'right' as side, * from (select l_orderkey, l_linenumber from lineitem where l_linestatus = 'O' except all select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R')""")
def u03(t):
    cols = ["l_orderkey", "l_linenumber"]
    return U.except_all(t.lineitem.filter("l_returnflag <> 'R'").select(*cols), t.lineitem.filter("l_linestatus = 'O'").select(*cols))


@query("u05_combine_snapshots", """
with a as (select *, 'a' as s from orders where o_orderstatus <> 'P'), b as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice, case when o_custkey % 2 = 0 then o_orderdate + interval 1 day else o_orderdate - interval 1 day end as o_orderdate, o_orderpriority, 'b' as s from orders where o_orderstatus <> 'F')
select o_orderkey, o_custkey, o_totalprice, o_orderdate from (select *, row_number() over (partition by o_orderkey order by o_orderdate desc, s desc) as rn from (select * from a union all select * from b)) where rn = 1""")
def u05(t):
    c = F.col
    day = F.expr("INTERVAL 1 DAY")
    a = t.orders.filter("o_orderstatus <> 'P'")
    b = t.orders.filter("o_orderstatus <> 'F'").withColumns({"o_totalprice": c("o_totalprice") + 1,
                                                             "o_orderdate": F.when(c("o_custkey") % 2 == 0, c("o_orderdate") + day).otherwise(c("o_orderdate") - day)})
    return U.combine_snapshots([(a, "a"), (b, "b")], ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query("w17_downsample", """
with s as (select event_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events)
select event_id from s where i in (select floor(k * n / 400::double)::bigint from range(400) r(k), (select max(n) as n from s))""")
def w17(t):
    return A.downsample(t.events, Order("ts", ("event_id",)), 400).select("event_id")
