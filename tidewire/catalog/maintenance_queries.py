"""Table-maintenance jobs over the input and derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.catalog.aggregate_queries import rounded
from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.registry import query
from tidewire.plans import maintenance as M
from tidewire.session import checkpoint_dir

c = F.col


def scratch(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


_UP = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 as o_totalprice, o_orderdate, o_orderpriority from orders where o_orderstatus = 'P' union all select -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderpriority = '5-LOW'"


@query("m01_upsert", f"""
with u as ({_UP})
select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderkey not in (select o_orderkey from u) union all select o_orderkey, o_totalprice, o_orderstatus from u""")
def m01(t):
    o = t.orders
    store = M.Store(t.spark, scratch(t, "orders"))
    store.write(o)
    u = o.filter("o_orderstatus = 'P'").withColumn("o_totalprice", c("o_totalprice") + 1).unionByName(o.filter("o_orderpriority = '5-LOW'").withColumn("o_orderkey", -c("o_orderkey") - 1))
    store.write(M.upsert(store.read(), u, ["o_orderkey"]))
    return store.read().select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("m02_reload_run", """
select l_orderkey, l_returnflag, l_quantity from lineitem where l_returnflag <> 'A' union all select l_orderkey, 'A', 99.0::double from lineitem where l_returnflag = 'N'
union all select l_orderkey, 'A', -1.0::double from lineitem where l_linestatus = 'O' and l_returnflag = 'A' and (l_linenumber = 1 or l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F'))""")
def m02(t):
    d = t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity", F.when(c("l_linenumber") > 1, c("l_orderkey")).alias("parent"), "l_linestatus")
    fresh = d.filter("l_returnflag = 'N'").withColumns({"l_returnflag": F.lit("A"), "l_quantity": F.lit(99.0)})
    manual = d.filter("l_linestatus = 'O' and l_returnflag = 'A'").withColumn("l_quantity", F.lit(-1.0))
    parents = t.orders.filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("parent"))
    return M.reload_run(d, "l_returnflag", "A", fresh, manual, parents, "parent").select("l_orderkey", "l_returnflag", "l_quantity")


_STATS = """
select 'orders' as table_name, count(*) as rows, min(o_orderdate) as first_time, max(o_orderdate) as last_time, 'ok' as status from orders where o_orderstatus = 'F'
union all select 'lines', count(*), min(l_shipdate), max(l_shipdate), 'ok' from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')
union all select 'none', 0, null, null, 'empty'"""


def scope_tables(t):
    o = t.orders.filter("o_orderstatus = 'F'")
    l = t.lineitem.join(o.select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return {"orders": (o, "o_orderdate"), "lines": (l, "l_shipdate"), "none": (o.filter("o_totalprice < 0"), "o_orderdate")}


@query("m03_snapshot", _STATS)
def m03(t):
    return M.snapshot(scope_tables(t), scratch(t, "archive"), "s1")


@query("m04_clear_scope", """
select 'orders' as table_name, count(*) as removed from orders where o_orderstatus = 'F' union all select 'lines', count(*) from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')""")
def m04(t):
    scope = t.orders.filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("scope_id"))
    return M.clear_scope({"orders": t.orders, "lines": t.lineitem}, scope, {"orders": "o_orderkey", "lines": "l_orderkey"})[1]


@query("m04_cleared_rows", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def m04b(t):
    scope = t.orders.filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("scope_id"))
    kept = M.clear_scope({"lines": t.lineitem}, scope, {"lines": "l_orderkey"})[0]["lines"]
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("m05_restore", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F'")
def m05(t):
    root = scratch(t, "archive")
    M.snapshot({"orders": scope_tables(t)["orders"]}, root, "s1")
    store = M.Store(t.spark, scratch(t, "live"))
    store.write(t.orders)
    M.restore(t.spark, root, ["orders"], "s1", {"orders": store})
    return store.read().select("o_orderkey", "o_totalprice")


@query("m06_combine_snapshots", """
with x as (select o_orderkey, o_totalprice, o_orderdate, 'a' as s from orders where o_orderstatus <> 'O' union all select o_orderkey, o_totalprice * 2, o_orderdate + interval 1 day, 'b' from orders where o_orderstatus = 'O' or o_orderpriority = '1-URGENT')
select o_orderkey, arg_max(o_totalprice, o_orderdate) as o_totalprice from x group by 1""")
def m06(t):
    a = {"orders": t.orders.filter("o_orderstatus <> 'O'")}
    b = {"orders": t.orders.filter("o_orderstatus = 'O' or o_orderpriority = '1-URGENT'").withColumns({"o_totalprice": c("o_totalprice") * 2, "o_orderdate": c("o_orderdate") + F.expr("INTERVAL 1 DAY")})}
    return M.combine_tables([(a, "a"), (b, "b")], {"orders": ["o_orderkey"]}, {"orders": "o_orderdate"})["orders"].select("o_orderkey", "o_totalprice")


ENTRY = """
with cd as (select o_orderkey as id, 'r' || (o_custkey % 9) as test_run_id, case when o_custkey % 2 = 0 then 'AA' else 'aa' end || (o_custkey % 40) as bssid, o_orderdate as survey_time, o_orderkey % 3 = 0 as badge_selected,
  case when o_orderkey % 5 > 0 then (o_orderkey % 50)::double end as badge_score, -(o_orderkey % 70)::double as badge_rssi_dbm, case o_orderkey % 3 when 0 then '5GHz' when 1 then '2.4GHz' else '6GHz' end as band, o_orderkey % 11 as badge_event_id, (o_orderkey % 2)::int as badge_candidate_index,
  case when o_orderstatus = 'F' then 'complete' else 'pending' end as manual_entry_status from orders),
en as (select 'r' || (l_partkey % 9) as run, 'aa' || (l_suppkey % 40) as bssid, l_shipdate as survey_time, -(l_quantity)::double as survey_rssi_dbm, max(l_shipdate) as x, l_orderkey * 10 + l_linenumber as entered_at from lineitem group by all),
ee as (select run, bssid, survey_time, arg_max(survey_rssi_dbm, entered_at * 100 - survey_rssi_dbm) as rssi from en group by 1, 2, 3),
bc as (select * from (select *, row_number() over (partition by test_run_id, lower(bssid), survey_time order by badge_selected desc, badge_score desc nulls last, badge_rssi_dbm desc, id) as rn from cd) where rn = 1),
mk as (select bc.*, ee.rssi, case band when '5GHz' then -8.0 when '2.4GHz' then -5.0 end::double as off from bc join ee on ee.run = bc.test_run_id and ee.bssid = lower(bc.bssid) and ee.survey_time = bc.survey_time)
"""


def entry_tables(t):
    k, u = c("o_orderkey"), c("o_custkey")
    cand = t.orders.select(
        k.alias("id"), F.concat(F.lit("r"), (u % 9).cast("string")).alias("test_run_id"), F.concat(F.when(u % 2 == 0, "AA").otherwise("aa"), (u % 40).cast("string")).alias("bssid"), c("o_orderdate").alias("survey_time"),
        (k % 3 == 0).alias("badge_selected"), F.when(k % 5 > 0, (k % 50).cast("double")).alias("badge_score"), (-(k % 70)).cast("double").alias("badge_rssi_dbm"), F.when(k % 3 == 0, "5GHz").when(k % 3 == 1, "2.4GHz").otherwise("6GHz").alias("band"),
        (k % 11).alias("badge_event_id"), (k % 2).cast("int").alias("badge_candidate_index"), F.when(c("o_orderstatus") == "F", "complete").otherwise("pending").alias("manual_entry_status"))
    entries = t.lineitem.select(F.concat(F.lit("r"), (c("l_partkey") % 9).cast("string")).alias("test_run_id"), F.concat(F.lit("aa"), (c("l_suppkey") % 40).cast("string")).alias("bssid"), c("l_shipdate").alias("survey_time"), (-c("l_quantity")).alias("survey_rssi_dbm"), F.lit(None).cast("double").alias("survey_snr_db"),
                                ((c("l_orderkey") * 10 + c("l_linenumber")) * 100 + c("l_quantity")).alias("entered_at"))
    matches = t.spark.createDataFrame([], "candidate_match_id bigint, test_run_id string, bssid string, survey_time timestamp, badge_event_id bigint, badge_candidate_index int, band string, badge_rssi_dbm double, survey_rssi_dbm double, "
                                      "vendor_offset_db double, calibrated_delta_db double, manual_entry_status string")
    return cand, entries, matches


@query("m07_apply_entries", ENTRY + """
select id as candidate_match_id, bssid, survey_time, rssi as survey_rssi_dbm, badge_rssi_dbm - (rssi + off) as calibrated_delta_db, case when off is null then 'missing_vendor_offset' else 'complete' end as manual_entry_status from mk""")
def m07(t):
    cand, entries, matches = entry_tables(t)
    return M.apply_entries(entries, cand, matches)[1].select("candidate_match_id", "bssid", "survey_time", "survey_rssi_dbm", "calibrated_delta_db", "manual_entry_status")


@query("m07_candidate_status", ENTRY + """
select cd.id, case when mk.id is null then cd.manual_entry_status when mk.off is null then 'missing_vendor_offset' else 'complete' end as manual_entry_status from cd left join mk on mk.test_run_id = cd.test_run_id and lower(mk.bssid) = lower(cd.bssid) and mk.survey_time = cd.survey_time""")
def m07b(t):
    cand, entries, matches = entry_tables(t)
    return M.apply_entries(entries, cand, matches)[0].select("id", "manual_entry_status")


@query("m08_reset_entries", ENTRY + """
select id, case when exists (select 1 from en where en.run = cd.test_run_id and en.bssid = lower(cd.bssid) and en.survey_time = cd.survey_time) then 'pending' else manual_entry_status end as manual_entry_status from cd""")
def m08(t):
    cand, entries, matches = entry_tables(t)
    return M.reset_entries(entries, cand, matches)[0].select("id", "manual_entry_status")


OBSERVED = """
, ob as (select o_orderkey as id, 'r' || (o_custkey % 9) as test_run_id, 'AA' || (o_custkey % 40) as bssid, o_orderdate as survey_time, -1.0::double as rssi_dbm from orders where o_orderpriority = '2-HIGH')
"""


def observations(t):
    u = c("o_custkey")
    return t.orders.filter(c("o_orderpriority") == "2-HIGH").select(
        c("o_orderkey").alias("id"), F.concat(F.lit("r"), (u % 9).cast("string")).alias("test_run_id"), F.concat(F.lit("AA"), (u % 40).cast("string")).alias("bssid"), c("o_orderdate").alias("survey_time"), F.lit(-1.0).alias("rssi_dbm"))


@query("m07_observations", ENTRY + OBSERVED + """
select id, test_run_id, survey_time, rssi_dbm from ob where not exists (select 1 from mk where mk.test_run_id = ob.test_run_id and lower(mk.bssid) = lower(ob.bssid) and mk.survey_time = ob.survey_time)
union all select id, test_run_id, survey_time, rssi from mk""")
def m07o(t):
    cand, entries, _ = entry_tables(t)
    return M.apply_observations(entries, cand, observations(t)).select("id", "test_run_id", "survey_time", "rssi_dbm")


@query("m08_observations", ENTRY + OBSERVED + """
select id from ob where o_left(id) or not exists (select 1 from en where en.run = ob.test_run_id and en.bssid = lower(ob.bssid) and en.survey_time = ob.survey_time)""".replace("o_left(id)", "id % 3 = 0"))
def m08o(t):
    _, entries, _ = entry_tables(t)
    obs = observations(t)
    refer = obs.filter(c("id") % 3 == 0).select(c("id").alias("observation_id"))
    return M.reset_observations(entries, obs, refer, "id", "observation_id").select("id")


RECON = """
with cd as (select o_orderkey as id, 'r' || (o_custkey % 9) as test_run_id, 'aa' || (o_custkey % 40) as bssid, date_trunc('month', o_orderdate) as survey_time, o_orderkey % 3 = 0 as sel, case when o_orderkey % 5 > 0 then (o_orderkey % 50)::double end as score, -(o_orderkey % 70)::double as rssi,
  o_orderkey % 11 as ev, (o_orderkey % 2)::int as ix, case when o_orderstatus = 'F' then 'complete' else 'pending' end as st from orders),
mt as (select o_orderkey as mid, 'r' || (o_custkey % 9) as test_run_id, 'AA' || (o_custkey % 40) as bssid, date_trunc('month', o_orderdate) as survey_time, o_orderkey % 11 as ev, (o_orderkey % 2)::int as ix, case when o_orderkey % 4 = 0 then o_orderkey end as cid, 'complete' as st from orders where o_orderpriority = '1-URGENT'),
ob as (select 'aa' || (l_suppkey % 40) as bssid, date_trunc('month', l_shipdate) as survey_time from lineitem where l_linenumber = 7),
att as (select mt.*, (select min(id) from cd where cd.test_run_id = mt.test_run_id and cd.bssid = lower(mt.bssid) and cd.survey_time = mt.survey_time and cd.ev = mt.ev and cd.ix = mt.ix) as found from mt),
dn as (select distinct lower(bssid) as b, survey_time as t from mt),
bs as (select * from (select *, row_number() over (partition by bssid, survey_time order by sel desc, score desc nulls last, rssi desc, id) as rn from cd) where rn = 1),
mk as (select * from bs where (bssid, survey_time) in (select (bssid, survey_time) from ob) and (bssid, survey_time) not in (select (b, t) from dn)),
d2 as (select b, t from dn union select bssid, survey_time from mk),
us as (select coalesce(cid, found) as id from att where coalesce(cid, found) is not null union select id from mk),
op as (select *, row_number() over (partition by bssid, survey_time order by sel desc, score desc nulls last, rssi desc, id) as rn from cd where st = 'pending' and (bssid, survey_time) not in (select (b, t) from d2)),
rp as (select id from op where rn > 1 and id not in (select id from us)),
sp as (select id from cd where st = 'pending' and (bssid, survey_time) in (select (b, t) from d2) and id not in (select id from us)),
cl as (select id from cd where st = 'pending' and (bssid, survey_time) in (select (b, t) from d2) and id not in (select id from sp)),
rem as (select bssid, survey_time from op where id not in (select id from rp) group by 1, 2 having count(*) > 1)
"""


@query("m09_reconcile", RECON + """
select 'attached_completed_matches_to_candidates' as action, count(*) as row_count from att where cid is null and found is not null union all select 'inserted_missing_completed_matches_from_manual_observations', count(*) from mk
union all select 'deleted_duplicate_pending_candidates_by_timestamp', count(*) from rp union all select 'deleted_unreferenced_duplicate_pending_candidates', count(*) from sp
union all select 'marked_duplicate_pending_candidates_complete', count(*) from cl union all select 'remaining_duplicate_pending_candidates', 0 union all select 'remaining_repeated_pending_timestamp_bssid_identities', count(*) from rem""")
def m09(t):
    k, u = c("o_orderkey"), c("o_custkey")
    month = F.date_trunc("month", "o_orderdate").alias("survey_time")
    cand = entry_tables(t)[0].withColumns({"bssid": F.lower("bssid"), "survey_time": F.date_trunc("month", "survey_time")})
    matches = t.orders.filter(c("o_orderpriority") == "1-URGENT").select(
        F.when(k % 4 == 0, k).alias("candidate_match_id"), F.concat(F.lit("r"), (u % 9).cast("string")).alias("test_run_id"), F.concat(F.lit("AA"), (u % 40).cast("string")).alias("bssid"), month, (k % 11).alias("badge_event_id"),
        (k % 2).cast("int").alias("badge_candidate_index"), F.lit("5GHz").alias("band"), F.lit(-1.0).alias("badge_rssi_dbm"), F.lit(-1.0).alias("survey_rssi_dbm"), F.lit(-8.0).alias("vendor_offset_db"), F.lit(0.0).alias("calibrated_delta_db"), F.lit("complete").alias("manual_entry_status"))
    s = c("l_suppkey") % 40
    obs = t.lineitem.filter(c("l_linenumber") == 7).select(
        (c("l_orderkey") * 100000 + c("l_partkey")).alias("id"), F.lit("r1").alias("test_run_id"), F.concat(F.lit("aa"), s.cast("string")).alias("bssid"), F.date_trunc("month", "l_shipdate").alias("survey_time"), (-c("l_quantity")).alias("rssi_dbm"), c("l_shipdate").alias("created_at"))
    return M.reconcile(cand, matches, obs)[2]


@query("m10_delete_run", """
select 'runs' as table_name, count(*) as rows, count(*) filter (where c_mktsegment = 'MACHINERY') as deleted from customer union all
select 'orders', count(*), 0 from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'MACHINERY')""")
def m10(t):
    runs = t.customer.select(c("c_custkey").alias("run"), F.lit(None).cast("timestamp").alias("deleted_at"), "c_mktsegment")
    gone = runs.filter("c_mktsegment = 'MACHINERY'")
    out = M.delete_run({"runs": runs, "orders": t.orders.withColumnRenamed("o_custkey", "run")}, "run", gone, "runs", F.lit("2024-01-01").cast("timestamp"))
    n = F.count(F.lit(1)).alias("rows")
    return out["runs"].agg(n, F.count("deleted_at").alias("deleted")).withColumn("table_name", F.lit("runs")).unionByName(
        out["orders"].agg(n).withColumns({"deleted": F.lit(0).cast("bigint"), "table_name": F.lit("orders")}))


@query("m11_audit", """
with a as (select l_orderkey, l_linenumber, count(*) as n, avg(l_quantity) as q from lineitem group by 1, 2), s as (select l_orderkey, l_linenumber, case when l_quantity = 7 then l_quantity + 1 else l_quantity end as l_quantity from lineitem where l_quantity <> 3 or l_tax <> 0.03),
b as (select l_orderkey, l_linenumber, count(*) as n, avg(l_quantity) as q from s group by 1, 2)
select 'key_count' as finding, sum(abs(a.n - coalesce(b.n, 0)))::bigint as n from a left join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber
union all select 'value:l_quantity', count(*) from a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where abs(a.q - b.q) > 1e-6
union all select 'invariant:at_most_50', count(*) from s where l_quantity > 50 having count(*) > 0""")
def m11(t):
    raw = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    q = c("l_quantity")
    stored = t.lineitem.filter((q != 3) | (c("l_tax") != 0.03)).select("l_orderkey", "l_linenumber", F.when(q == 7, q + 1).otherwise(c("l_quantity")).alias("l_quantity"))
    return M.audit(raw, stored, ["l_orderkey", "l_linenumber"], ["l_quantity"], invariants={"at_most_50": lambda d: c("l_quantity") <= 50})


@query("m12_quality_checks", """
select 'lineitem' as table_name, 'unique:l_orderkey,l_linenumber' as check_name, count(*) as violations from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'lineitem', 'foreign:l_orderkey', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') union all select 'lineitem', 'enum:l_returnflag', count(*) from lineitem where l_returnflag not in ('A', 'N')
union all select 'lineitem', 'not_null:l_shipdate', 0 union all select 'lineitem', 'one_open:l_suppkey', count(*) from (select 1 from lineitem where l_linestatus = 'O' and l_quantity > 49 group by l_suppkey having count(*) > 1)""")
def m12(t):
    return M.quality_checks("lineitem", t.lineitem, unique=["l_orderkey", "l_linenumber"], foreign={"l_orderkey": (t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey")},
                            enums={"l_returnflag": ["A", "N"]}, not_null=["l_shipdate"], one_open=(["l_suppkey"], (c("l_linestatus") == "O") & (c("l_quantity") > 49)))


@query("m13_apply_reviews", ctes("streams") + """
, r as (select l_orderkey as capture_id, arg_max('rev' || l_linenumber, l_linenumber * 100000 + l_partkey) as rs from lineitem where l_quantity > 45 group by 1)
select s.stream_id, packet_count, coalesce(rs, review_status) as review_status, stream_classification from streams s left join r on r.capture_id = s.capture_id""")
def m13(t):
    r = t.lineitem.filter("l_quantity > 45").select(c("l_orderkey").alias("capture_id"), F.concat(F.lit("rev"), c("l_linenumber").cast("string")).alias("review_status"), F.lit(None).cast("string").alias("stream_classification"),
                                                    (c("l_linenumber") * 100000 + c("l_partkey")).alias("at"))
    return M.apply_reviews(frame(t, "streams"), r, ["capture_id"], "at").select("stream_id", "packet_count", "review_status", "stream_classification")


TEMPLATE = """
with p as (select event_id, user_id, ts from events where event_type = 'view'), e as (select event_id, user_id, ts from events where event_type = 'click'), rs as (select event_id, user_id, ts, value, user_id % 3 as ch from events where event_type = 'error'),
n as (select p.event_id as pid, p.user_id, p.ts as pt, x.event_id as eid, x.ts as et from p, lateral (select e.event_id, e.ts from e where e.user_id = p.user_id and e.ts::date = p.ts::date order by abs(epoch_us(e.ts) - epoch_us(p.ts)), e.ts, e.event_id limit 1) x
   where abs(epoch_us(x.ts) - epoch_us(p.ts)) <= 7200000000),
k as (select n.*, i as ix, 'b' || ((eid + i) % 20) as bssid, (eid + i) % 3 as ch, case when (eid + i) % 5 = 0 then 33.0 end::double as own from n, (select unnest([0, 1]) as i)),
s as (select k.pid, k.ix, y.value from k, lateral (select value, ts from rs where rs.user_id = k.user_id and rs.ch = k.ch and abs(epoch_us(rs.ts) - epoch_us(k.et)) <= 300000000 order by abs(epoch_us(rs.ts) - epoch_us(k.et)), rs.ts, rs.event_id limit 1) y),
a as (select k.pid, k.ix, y.value from k, lateral (select value, ts from rs where rs.user_id = k.user_id and abs(epoch_us(rs.ts) - epoch_us(k.et)) <= 300000000 order by abs(epoch_us(rs.ts) - epoch_us(k.et)), rs.ts, rs.event_id limit 1) y)
"""


def template_rows(t):
    run = c("user_id").cast("string").alias("test_run_id")
    pick = lambda kind: t.events.filter(c("event_type") == kind)
    points = pick("view").select(run, c("event_id").alias("survey_point_id"), c("ts").alias("survey_time"))
    events = pick("click").select(run, "event_id", c("ts").alias("event_time"))
    i = (c("event_id") + c("candidate_index"))
    cands = pick("click").select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("candidate_index")).select(
        "event_id", "candidate_index", F.concat(F.lit("b"), (i % 20).cast("string")).alias("bssid"), (i % 3).alias("channel"), F.when(i % 5 == 0, 33.0).alias("snr_db"))
    radio = pick("error").select(run, c("event_id").alias("sample_id"), c("ts").alias("sample_time"), (c("user_id") % 3).alias("channel"), c("value").alias("snr_db"))
    names = t.nation.select(F.concat(F.lit("b"), c("n_nationkey").cast("string")).alias("bssid"), c("n_name").alias("ap_name"))
    return M.build_candidates(points, events, cands, radio, names, 7200.0, "UTC")


@query("m14_build_candidates", TEMPLATE + """
select k.pid as survey_point_id, k.eid as event_id, k.ix as candidate_index, k.bssid, n_name as ap_name, case when abs(epoch_us(et) - epoch_us(pt)) <= 1000000 then 'exact_1s' when abs(epoch_us(et) - epoch_us(pt)) <= 5000000 then 'close_5s' else 'within_window' end as match_quality,
 coalesce(own, s.value, a.value) as matched_value, case when own is not null then 'own' when s.pid is not null then 'same' when a.pid is not null then 'any' else 'none' end as match_source
from k left join s on s.pid = k.pid and s.ix = k.ix left join a on a.pid = k.pid and a.ix = k.ix left join nation on 'b' || n_nationkey = k.bssid""")
def m14(t):
    return template_rows(t).select("survey_point_id", "event_id", "candidate_index", "bssid", "ap_name", "match_quality", "matched_value", "match_source")


@query("m15_correlate", """
with r as (select event_id, user_id, ts as st, ts + interval 1 second * (value::int % 20) as bt, (value::int % 20)::double as d, 'b' || (user_id % 9) as bssid, -value as dev, case when user_id % 4 = 0 then -60.0 end::double as own, case when user_id % 3 = 0 then null when user_id % 3 = 1 then '5GHz' else '6GHz' end as band from events),
o as (select event_id, -(value / 2) as rssi from events where event_type in ('view', 'click')),
j as (select r.*, coalesce(own, o.rssi) as s, coalesce(band, case when o.event_id is not null then '2.4GHz' end) as b2 from r left join o on o.event_id = r.event_id where d <= 15 and st::date = bt::date),
k as (select *, case b2 when '5GHz' then -8.0 when '2.4GHz' then -5.0 end::double as off from j)
select event_id as survey_point_id, round(dev - s, 6) as raw_delta_db, round(dev - (s + off), 6) as calibrated_delta_db, case when s is null then 'pending_manual_entry' when off is null then 'missing_vendor_offset' else 'complete' end as manual_entry_status from k""")
def m15(t):
    d = F.round("value").cast("int") % 20
    u = c("user_id")
    rows = t.events.select(c("event_id").alias("survey_point_id"), c("ts").alias("survey_time"), F.timestamp_micros(F.unix_micros("ts") + d.cast("bigint") * 1000000).alias("badge_time"), d.cast("double").alias("time_delta_seconds"),
                           F.concat(F.lit("b"), (u % 9).cast("string")).alias("bssid"), (-c("value")).alias("badge_rssi_dbm"), F.when(u % 4 == 0, -60.0).alias("survey_rssi_dbm"), F.lit(None).cast("double").alias("survey_snr_db"),
                           F.when(u % 3 == 1, "5GHz").when(u % 3 == 2, "6GHz").alias("band"))
    obs = t.events.filter(c("event_type").isin("view", "click")).select(c("event_id").alias("survey_point_id"), F.concat(F.lit("b"), (u % 9).cast("string")).alias("bssid"), c("ts").alias("survey_time"), (-(c("value") / 2)).alias("rssi_dbm"),
                                                                        F.lit(None).cast("double").alias("snr_db"), F.lit("2.4GHz").alias("band"), c("event_id").alias("observation_id"))
    return rounded(M.correlate(rows, obs, 15.0, "UTC").select("survey_point_id", "raw_delta_db", "calibrated_delta_db", "manual_entry_status"))
