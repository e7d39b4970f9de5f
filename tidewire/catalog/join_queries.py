"""Joins over the input and derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.filter_queries import samples
from tidewire.catalog.registry import query
from tidewire.functions.predicates import match_quality
from tidewire.functions.scalars import local_date
from tidewire.operators import joins as J
from tidewire.operators import nearest as N
from tidewire.operators import timeseries as T
from tidewire.operators.aggregates import count_where
from tidewire.operators.quantiles import with_percentiles
from tidewire.session import checkpointed


def r6(c, n=6):
    return F.round(c, n)


@query("j01_inner_chain", """
select n_name, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def j01(t):
    d = J.inner(t.lineitem, t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    d = J.inner(J.inner(d, t.customer, F.col("o_custkey") == F.col("c_custkey")), t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_extendedprice"), 2).alias("price"))


@query("j02_rollup_left", """
select c_custkey, coalesce(n, 0) as order_count, coalesce(p, 0)::double as total from customer left join
(select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as p from orders group by 1) on o_custkey = c_custkey""")
def j02(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("order_count"), r6(F.sum("o_totalprice"), 2).alias("total"))
    return J.rollup_left(t.customer.select("c_custkey"), o, ["c_custkey"], ["order_count", "total"])


@query("j03_lateral_agg", """
select c_custkey, x.n, x.big, x.last_date from customer, lateral (select count(*) as n, count(*) filter (where o_totalprice > 200000) as big, max(o_orderdate) as last_date from orders where o_custkey = c_custkey) x""")
def j03(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    aggs = [F.count(F.lit(1)).alias("n"), count_where(F.col("o_totalprice") > 200000).alias("big"), F.max("o_orderdate").alias("last_date")]
    return J.lateral_agg(t.customer.select("c_custkey"), o, ["c_custkey"], aggs, ["n", "big"])


@query("j04_latest_child", """
select c_custkey, o_orderkey as latest_order, o_totalprice as latest_price from customer left join
(select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) on o_custkey = c_custkey and rn = 1""")
def j04(t):
    o = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return J.latest_child(t.customer.select("c_custkey"), o, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")],
                          {"latest_order": "o_orderkey", "latest_price": "o_totalprice"})


NEAREST = """
with v as (select * from events where event_type = 'view'), c as (select * from events where event_type = 'click'),
near as (select v.event_id, v.user_id, v.ts, x.event_id as click_id, x.ts as click_ts, (epoch_us(x.ts) - epoch_us(v.ts)) / 1000000.0::double as delta from v,
 lateral (select c.event_id, c.ts from c where c.user_id = v.user_id and c.ts::date = v.ts::date
   order by abs(epoch_us(c.ts) - epoch_us(v.ts)), c.ts, c.event_id limit 1) x)
"""


def view_click(t, **opts):
    v = t.events.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    c = t.events.filter(F.col("event_type") == "click").select(F.col("event_id").alias("click"), F.col("ts").alias("cts"), "user_id")
    return N.nearest_join(v, c, ["user_id"], point_ts="ts", event_ts="cts", event_id="click", **opts)


@query("j05_nearest_join", NEAREST + "select event_id, user_id, click_id, click_ts, delta from near")
def j05(t):
    return view_click(t).select("event_id", "user_id", F.col("nearest_id").alias("click_id"), F.col("nearest_ts").alias("click_ts"),
                                F.col("nearest_delta").alias("delta"))


@query("j05_nearest_window", NEAREST + "select event_id, click_id, delta from near where abs(delta) <= 3600")
def j05w(t):
    return view_click(t, window=3600).select("event_id", F.col("nearest_id").alias("click_id"), F.col("nearest_delta").alias("delta"))


@query("j05_run_alignment", NEAREST + """
select user_id, count(*) as points, count(*) filter (where abs(delta) <= 3600) as within_window, count(*) filter (where abs(delta) <= 5) as close,
  round(min(abs(delta)), 2) as min_delta, round(quantile_cont(abs(delta), 0.5), 2) as p50_delta, round(quantile_cont(abs(delta), 0.9), 2) as p90_delta from near group by 1""")
def j05a(t):
    near = checkpointed(view_click(t))
    q = match_quality(F.col("nearest_delta"), F.lit(3600.0))
    g = near.groupBy("user_id").agg(F.count(F.lit(1)).alias("points"), F.count(q).alias("within_window"),
                                    count_where(q.isin("exact_1s", "close_5s")).alias("close"), r6(F.min("nearest_abs_delta"), 2).alias("min_delta"))
    g = with_percentiles(g, near, ["user_id"], {"p50_delta": ("nearest_abs_delta", 0.5, "cont"), "p90_delta": ("nearest_abs_delta", 0.9, "cont")})
    return g.withColumns({"p50_delta": r6("p50_delta", 2), "p90_delta": r6("p90_delta", 2)})


@query("j06_nearest_fallback", """
with v as (select *, cast(json_extract(props, '$.k') as bigint) % 4 as ch from events where event_type = 'view'),
c as (select *, cast(json_extract(props, '$.k') as bigint) % 4 as ch from events where event_type = 'error'),
s as (select v.event_id, x.value, (epoch_us(x.ts) - epoch_us(v.ts)) / 1000000.0::double as d from v, lateral (select c.ts, c.value from c where c.user_id = v.user_id and c.ch = v.ch
   order by abs(epoch_us(c.ts) - epoch_us(v.ts)), c.ts, c.event_id limit 1) x where abs(epoch_us(x.ts) - epoch_us(v.ts)) <= 86400000000),
a as (select v.event_id, x.value, (epoch_us(x.ts) - epoch_us(v.ts)) / 1000000.0::double as d from v, lateral (select c.ts, c.value from c where c.user_id = v.user_id
   order by abs(epoch_us(c.ts) - epoch_us(v.ts)), c.ts, c.event_id limit 1) x where abs(epoch_us(x.ts) - epoch_us(v.ts)) <= 86400000000)
select v.event_id, case when v.value > 40 then v.value else coalesce(s.value, a.value) end as matched_value,
  case when v.value > 40 then 0.0::double else coalesce(s.d, a.d) end as matched_delta,
  case when v.value > 40 then 'own' when s.event_id is not null then 'same' when a.event_id is not null then 'any' else 'none' end as match_source
from v left join s on s.event_id = v.event_id left join a on a.event_id = v.event_id""")
def j06(t):
    ch = (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("ch")
    v = t.events.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts", ch, F.when(F.col("value") > 40, F.col("value")).alias("own"))
    c = t.events.filter(F.col("event_type") == "error").select(F.col("event_id").alias("eid"), F.col("ts").alias("ets"), "user_id", ch, "value")
    d = N.nearest_with_fallback(v, c, ["user_id"], "ch", point_ts="ts", event_ts="ets", event_id="eid", value="value", own="own", window=86400.0)
    return d.select("event_id", "matched_value", "matched_delta", "match_source")


@query("j07_min_gap", """
select v.user_id, min(abs(epoch_us(c.ts) - epoch_us(v.ts))) / 1000000.0::double as min_gap_seconds from events v join events c on v.user_id = c.user_id
where v.event_type = 'view' and c.event_type = 'click' group by 1""")
def j07(t):
    v = t.events.filter(F.col("event_type") == "view").select("user_id", "ts")
    c = t.events.filter(F.col("event_type") == "click").select("user_id", F.col("ts").alias("cts"), F.col("event_id").alias("cid"))
    return N.min_gap(v, c, ["user_id"], left_ts="ts", right_ts="cts", right_id="cid")


@query("j08_nullsafe", ctes("streams") + """
, g as (select coalesce(review_status, '') as review_status, count(*) as total from streams group by 1)
select s.measurement_mode, g.review_status as status, g.total, count(*) as n from streams s join g on coalesce(s.review_status, '') = g.review_status group by all""")
def j08(t):
    s = frame(t, "streams")
    g = s.groupBy("review_status").agg(F.count(F.lit(1)).alias("total"))
    d = J.join_nullsafe(s.select("measurement_mode", "review_status"), g, ["review_status"])
    return d.groupBy("measurement_mode", F.coalesce("review_status", F.lit("")).alias("status"), "total").agg(F.count(F.lit(1)).alias("n"))


@query("j09_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50)")
def j09(t):
    return J.semi(t.orders, t.lineitem.filter(F.col("l_quantity") == 50), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey")


@query("j10_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def j10(t):
    return J.anti(t.customer, t.orders.filter(F.col("o_orderstatus") == "F"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("j11_single_rows", "select (select count(*) from orders) as captures, (select count(*) from lineitem) as streams, (select max(l_shipdate) from lineitem) as last_time")
def j11(t):
    return J.single_rows(t.orders.agg(F.count(F.lit(1)).alias("captures")),
                         t.lineitem.agg(F.count(F.lit(1)).alias("streams"), F.max("l_shipdate").alias("last_time")))


@query("j12_contains_join", """
with d as (select s_suppkey, s_name, lpad(lower(to_hex(s_suppkey * 7919 + 65535)), 12, '0') as mac from supplier),
p as (select page_id, '/in/' || page_id || '/' || case when page_id % 3 > 0 then lpad(lower(to_hex((page_id % 80) * 7919 + 65535)), 12, '0') else 'none' end || '-zz.pcap' as path, url from pages),
x as (select page_id, regexp_replace(lower(path || ' ' || url), '[^0-9a-f]', '', 'g') as h from p)
select x.page_id, (select s_name from d where contains(x.h, d.mac) order by s_suppkey limit 1) as device from x""")
def j12(t):
    mac = "lpad(lower(hex({} * 7919 + 65535)), 12, '0')"
    d = t.supplier.withColumn("mac", F.expr(mac.format("s_suppkey")))
    token = F.when(F.col("page_id") % 3 > 0, F.expr(mac.format("(page_id % 80)"))).otherwise("none")
    p = t.pages.select("page_id", F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit("/"), token, F.lit("-zz.pcap")).alias("path"), "url")
    return J.contains_join(p, d, ["path", "url"], "mac", ["page_id"], "s_suppkey", {"device": "s_name"}).select("page_id", "device")


VEC = """
with i as (select event_type, user_id, arg_max(value, ts) as v from events where ts > timestamp '2024-01-24 00:00:00' and ts <= timestamp '2024-01-25 00:00:00' group by all)
"""


def vec(t, metric):
    from tidewire.catalog.filter_queries import now
    return T.select_series(T.instant(samples(t), now(), 86400), metric).select("labels", "value")


def usr(d, *more):
    return d.select(T.label("user").alias("usr"), *more)


@query("j13_vec_op", VEC + "select a.user_id::varchar as usr, round(a.v * b.v, 6) as value from i a join i b on a.user_id = b.user_id where a.event_type = 'view' and b.event_type = 'click'")
def j13(t):
    return usr(T.vec_op(vec(t, "view"), vec(t, "click"), "*", ["user"]), r6("value").alias("value"))


@query("j14_vec_enrich", VEC + """
select a.event_type || a.user_id as k, c_mktsegment as segment, round(a.v * 1, 6) as value from i a join customer on c_custkey = a.user_id""")
def j14(t):
    from tidewire.catalog.filter_queries import now
    many = T.instant(samples(t), now(), 86400).withColumn("labels", F.map_concat("labels", F.create_map(F.lit("kind"), F.col("metric"))))
    one = t.customer.select(F.create_map(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("segment"), F.col("c_mktsegment")).alias("labels"), F.lit(1.0).alias("value"))
    d = T.vec_enrich(many, one, ["user"], ["segment"])
    return d.select(F.concat(T.label("kind"), T.label("user")).alias("k"), T.label("segment").alias("segment"), r6("value").alias("value"))


@query("j15_vec_and", VEC + "select user_id::varchar as usr, v as value from i where event_type = 'view' and user_id in (select user_id from i where event_type = 'click' and v > 10)")
def j15(t):
    return usr(T.vec_and(vec(t, "view"), T.compare(vec(t, "click"), ">", 10), ["user"]), "value")


@query("j16_vec_unless", VEC + "select user_id::varchar as usr, v as value from i where event_type = 'view' and user_id not in (select user_id from i where event_type = 'click')")
def j16(t):
    return usr(T.vec_unless(vec(t, "view"), vec(t, "click"), ["user"]), "value")


@query("j17_vec_or", VEC + """
select user_id::varchar as usr, v as value from i where event_type = 'view' union all
select user_id::varchar, v from i where event_type = 'click' and user_id not in (select user_id from i where event_type = 'view')""")
def j17(t):
    return usr(T.vec_or(vec(t, "view"), vec(t, "click")), "value")


@query("j18_or_default", VEC + "select coalesce(sum(v), 0)::double as value from i where event_type = 'absent'")
def j18(t):
    return T.or_default(T.series_agg(vec(t, "absent"), "sum", []), 0).select("value")


@query("j19_coalesced_lookup", """
with cfg as (select p_brand || ':' || p_size as key, max(p_retailprice) as v from part group by 1 union all select p_brand, min(p_retailprice) from part group by 1)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, coalesce(a.v, b.v) as target from lineitem join part on l_partkey = p_partkey
left join cfg a on a.key = p_brand || ':' || l_linenumber left join cfg b on b.key = p_brand""")
def j19(t):
    exact = t.part.groupBy(F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string")).alias("key")).agg(F.max("p_retailprice").alias("v"))
    coarse = t.part.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_retailprice").alias("v"))
    facts = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.concat("p_brand", F.lit(":"), F.col("l_linenumber").cast("string")).alias("k1"), F.col("p_brand").alias("k2"))
    return J.coalesced_lookup(facts, exact.unionByName(coarse), ["k1", "k2"], "v", "target").drop("k1", "k2")


@query("j20_multi_key_lookup", """
with e as (select s_suppkey, s_name, unnest([s_suppkey::varchar, 'ip' || s_nationkey, s_name]) as key from supplier),
ix as (select key, arg_max(s_name, s_suppkey) as dev from e group by 1)
select c_custkey, coalesce(a.dev, b.dev) as device from customer left join ix a on a.key = c_custkey::varchar left join ix b on b.key = 'ip' || (c_nationkey + 3)""")
def j20(t):
    d = t.supplier.withColumns({"uuid": F.col("s_suppkey").cast("string"), "ip": F.concat(F.lit("ip"), F.col("s_nationkey").cast("string"))})
    f = t.customer.select("c_custkey", F.concat(F.lit("ip"), (F.col("c_nationkey") + 3).cast("string")).alias("probe_ip"))
    return J.multi_key_lookup(f, d, ["uuid", "ip", "s_name"], ["c_custkey", "probe_ip"], "s_suppkey", {"device": "s_name"}).select("c_custkey", "device")


@query("j21_shared_key", "select doc_id, md5(text) as h, n from (select *, count(*) over (partition by md5(text)) as n from documents) where n > 1")
def j21(t):
    d = t.documents.select("doc_id", F.md5("text").alias("h"))
    return d.join(d.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1), "h")


@query("j22_range_join", """
with w as (select user_id, min(ts) as lo, min(ts) + interval 7200 second as hi from events where event_type = 'error' group by 1)
select e.event_id, w.user_id as window_user from events e join w on e.user_id = w.user_id and e.ts between w.lo and w.hi""")
def j22(t):
    e = t.events.select("event_id", "user_id", (F.unix_micros("ts") / 1e6).alias("t"))
    w = t.events.filter(F.col("event_type") == "error").groupBy("user_id").agg((F.min(F.unix_micros("ts")) / 1e6).alias("lo")).withColumn("hi", F.col("lo") + 7200)
    return J.range_filter_join(e, w, "t", "lo", "hi", 3600, ["user_id"]).select("event_id", F.col("user_id").alias("window_user"))


@query("j22_cidr", ctes("streams") + "select stream_id, packet_count, src_ip from streams where src_ip like '10.0.2.%' or src_ip like '10.0.3.%' or src_ip like '10.0.5.%'")
def j22b(t):
    from tidewire.functions.scalars import cidr_bounds
    return J.in_any_cidr(frame(t, "streams"), "src_ip", [cidr_bounds("10.0.2.0/23"), cidr_bounds("10.0.5.0/24")]).select("stream_id", "packet_count", "src_ip")


@query("j23_restore_preserved", ctes("streams") + """
, p as (select stream_id, packet_count, case when review_status is null then null else capture_id end as capture_id from streams)
select * from p where capture_id is null or capture_id in (select o_orderkey from orders where o_orderstatus = 'F')""")
def j23(t):
    p = frame(t, "streams").select("stream_id", "packet_count", F.when(F.col("review_status").isNotNull(), F.col("capture_id")).alias("capture_id"))
    parents = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("capture_id"))
    return J.restore_preserved(p, parents, "capture_id").select("stream_id", "packet_count", "capture_id")


@query("u04_common_dates", "select distinct ts::date as day from events where event_type = 'view' intersect select distinct ts::date from events where event_type = 'click'")
def u04(t):
    from tidewire.operators.setops import common_dates
    d = t.events.select("event_type", local_date(F.col("ts"), "UTC").alias("day"))
    return common_dates(d.filter("event_type = 'view'"), d.filter("event_type = 'click'"), "day")
