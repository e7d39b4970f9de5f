"""Scalar functions over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.registry import query
from tidewire.functions import scalars as S

_MAC = "lpad(lower(hex(s_suppkey * 7919 + 65535)), 12, '0')"


@query("f01_normalize_mac", """
with m as (select s_suppkey, lpad(lower(to_hex(s_suppkey * 7919 + 65535)), 12, '0') as h from supplier)
select s_suppkey, regexp_replace(h, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') as from_dashes,
  regexp_replace(h, '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') as from_dotted,
  cast(null as varchar) as too_short
from m""")
def f01(t):
    d = t.supplier.withColumn("h", F.expr(_MAC))
    dashes = F.upper(F.regexp_replace("h", "(..)(?=.)", "$1-"))
    dotted = F.regexp_replace("h", "(....)(?=.)", "$1.")
    return d.select("s_suppkey", S.normalize_mac(dashes).alias("from_dashes"), S.normalize_mac_lenient(dotted).alias("from_dotted"),
                    S.normalize_mac(F.substring("h", 1, 10)).alias("too_short"))


@query("f02_mac_hex", """
select doc_id, length(regexp_replace(lower(text), '[^0-9a-f]', '', 'g')) as n_hex,
  md5(regexp_replace(lower(text), '[^0-9a-f]', '', 'g')) as hex_md5 from documents""")
def f02(t):
    h = S.mac_hex(F.col("text"))
    return t.documents.select("doc_id", F.length(h).cast("bigint").alias("n_hex"), F.md5(h).alias("hex_md5"))


@query("f03_band", """
select p_partkey,
  case when p_size between 1 and 14 then '2.4GHz' when p_size between 32 and 177 then '5GHz' end as by_channel,
  case when 2300 + p_size * 100 >= 2400 and 2300 + p_size * 100 < 2500 then '2.4GHz'
       when 2300 + p_size * 100 >= 4900 and 2300 + p_size * 100 < 5925 then '5GHz'
       when 2300 + p_size * 100 between 5925 and 7125 then '6GHz' end as by_frequency,
  case p_size % 4 when 0 then '2.4ghz' when 1 then '5ghz' when 2 then '6ghz' else 'unknown' end as by_slot,
  case p_size % 4 when 0 then '24ghz' when 1 then '5ghz' when 2 then '6ghz' else 'ax' end as by_text
from part""")
def f03(t):
    size = F.col("p_size")
    text = S.case_map(size % 4, {0: "802.11g 2.4 GHz", 1: "5_GHz", 2: "6G"}, F.lit(" AX "))
    return t.part.select("p_partkey", S.band_from_channel(size).alias("by_channel"),
                         S.band_from_frequency(size * 100 + 2300).alias("by_frequency"), S.band_from_slot(size % 4).alias("by_slot"),
                         S.band_from_text(text).alias("by_text"))


@query("f04_channel_family", """
with c as (select p_partkey, cast(p_size * 4 as int) as ch from part)
select p_partkey, ch in (52,56,60,64,100,104,108,112,116,120,124,128,132,136,140,144) as dfs,
  case when ch in (36,40,44,48) then 'UNII-1 non-DFS' when ch in (52,56,60,64) then 'UNII-2 DFS'
       when ch between 100 and 144 then 'UNII-2e DFS' when ch in (149,153,157,161,165) then 'UNII-3 non-DFS' else 'other' end as family
from c""")
def f04(t):
    ch = F.col("p_size") * 4
    return t.part.select("p_partkey", S.is_dfs(ch).alias("dfs"), S.channel_family(ch).alias("family"))


@query("f05_local_date", """
select event_id, cast((ts at time zone 'UTC') at time zone 'America/Chicago' as date) as local_day,
  strftime((ts at time zone 'UTC') at time zone 'America/Chicago', '%Y-%m-%d %H:%M:%S') as local_clock from events""")
def f05(t):
    return t.events.select("event_id", S.local_date(F.col("ts"), "America/Chicago").alias("local_day"),
                           S.local_text(F.col("ts"), "America/Chicago").alias("local_clock"))


@query("f06_parse_timestamp", """
select event_id, date_trunc('second', ts) as from_iso_z, date_trunc('second', ts) as from_offset,
  date_trunc('second', ts) as from_us, date_trunc('second', ts) as from_epoch_s, date_trunc('millisecond', ts) as from_epoch_ms from events""")
def f06(t):
    z = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    off = F.concat(F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530"))
    us = F.date_format(F.from_utc_timestamp("ts", "America/Chicago"), "MM/dd/yyyy HH:mm:ss")
    p = S.parse_timestamp_variants
    return t.events.select(
        "event_id", p(F.concat(z, F.lit("Z"))).alias("from_iso_z"), p(off).alias("from_offset"),
        p(us, "America/Chicago").alias("from_us"), p(F.unix_seconds("ts").cast("string")).alias("from_epoch_s"),
        p(F.unix_millis("ts").cast("string")).alias("from_epoch_ms"))


@query("f07_ft_state", """
select event_id, case when event_type in ('click') then 'ft' when event_type = 'view' then 'non_ft'
   when event_type = 'error' then 'ft' else 'unknown' end as ft, 'wlc' || user_id as host from events""")
def f07(t):
    word = S.case_map(F.col("event_type"), {"click": "Fast-Transition", "view": "Disabled"}, F.lit("?"))
    akm = F.when(F.col("event_type") == "error", "PSK + FT").otherwise("PSK SOFT")
    host = F.concat(F.lit("wlc"), F.col("user_id").cast("string"), F.lit(".corp.example"))
    return t.events.select("event_id", S.ft_state(word, akm).alias("ft"), S.strip_domain(host).alias("host"))


@query("f08_rates", """
select p_partkey, p_size * 1000.0::double as bps_k, round(p_size * 1.5 * 1e6, 3)::double as bps_m,
  p_size::double as gbps, case when p_size >= 1000 then '?' else p_size || ' Gbps' end as gbps_label,
  round(p_size / 1000.0::double, 9) as mbps_as_gbps, round(p_size / 1000000.0::double, 9) as bare_as_gbps, null::double as bad from part""")
def f08(t):
    n = F.col("p_size").cast("string")
    g = S.link_speed_gbps(F.lit("n/a"), F.concat(n, F.lit(" Gbit/s")))
    m = F.format_string("%.1fM", F.col("p_size") * 1.5)
    return t.part.select(
        "p_partkey", S.parse_rate(F.concat(n, F.lit("K"))).alias("bps_k"), F.round(S.parse_rate(m), 3).alias("bps_m"), g.alias("gbps"),
        S.format_speed(g).alias("gbps_label"), F.round(S.link_speed_gbps(F.concat(n, F.lit("mbps"))), 9).alias("mbps_as_gbps"),
        F.round(S.link_speed_gbps(n), 9).alias("bare_as_gbps"), S.link_speed_gbps(F.lit("-1"), F.lit("fast")).alias("bad"))


@query("f09_ms_or_s", """
select event_id, coalesce(case when event_type = 'click' then cast(json_extract(props, '$.k') as double) end,
   cast(json_extract(props, '$.k') as double) / 1000.0) as seconds from events""")
def f09(t):
    k = S.json_value(F.col("props"), "$.k", "double")
    return t.events.select("event_id", S.seconds_from([F.when(F.col("event_type") == "click", k)], [k]).alias("seconds"))


@query("f10_multicast", """
with g as (select c_custkey, 230 as o1, 230 + cast(c_custkey // 65536 as bigint) as o2, (c_custkey // 256) % 256 as o3, c_custkey % 256 as o4 from customer)
select c_custkey, '01:00:5e:' || lpad(to_hex(o2 % 128), 2, '0') || ':' || lpad(lower(to_hex(o3)), 2, '0') || ':' || lpad(lower(to_hex(o4)), 2, '0') as mac,
  c_custkey < 512 as in_small_pool, c_custkey between 1 and 510 as mac_in_pool, true as mapping_ok from g""")
def f10(t):
    ip = F.format_string("230.%d.%d.%d", (F.col("c_custkey") / 65536).cast("bigint") + 230, (F.col("c_custkey") / 256).cast("bigint") % 256, F.col("c_custkey") % 256)
    mac = S.multicast_mac(ip)
    pool = "230.230.0.0/23"
    return t.customer.select("c_custkey", mac.alias("mac"), S.in_pool(ip, pool).alias("in_small_pool"),
                             S.mac_in_range(mac, pool).alias("mac_in_pool"), S.mapping_is_valid(ip, mac).alias("mapping_ok"))


@query("f11_find_ips", r"""
with f as (select doc_id, list_filter(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'),
   lambda x: regexp_full_match(x, '(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}')) as a from documents),
p as (select doc_id, unnest(a) as ip, unnest(range(len(a))) as pos from f),
q as (select doc_id, ip, min(pos) as pos from p group by all)
select doc_id, string_agg(ip, ',' order by pos) as ips, count(*) as n from q group by doc_id""")
def f11(t):
    d = t.documents.select("doc_id", S.find_ips(F.col("text")).alias("a")).filter(F.size("a") > 0)
    return d.select("doc_id", F.array_join("a", ",").alias("ips"), F.size("a").cast("bigint").alias("n"))


@query("f12_stable_id", """
select o_orderkey, 'art_' || substr(sha256(o_orderkey || '|' || o_custkey || '|' || '' || '|' || o_orderstatus), 1, 24) as id from orders""")
def f12(t):
    return t.orders.select("o_orderkey", S.stable_id(F.col("o_orderkey"), F.col("o_custkey"), F.lit(None), F.col("o_orderstatus"), prefix="art_").alias("id"))


@query("f13_clamp_min", """
select event_id, case when event_type = 'error' then null else greatest(value, 5.0) end as clamped from events""")
def f13(t):
    return t.events.select("event_id", S.clamp_min(F.when(F.col("event_type") != "error", F.col("value")), 5).alias("clamped"))


@query("f15_nullif_truthy", """
select o_orderkey, nullif(trim(case when o_orderstatus = 'F' then '  ' else ' ' || o_orderstatus || ' ' end), '') as trimmed,
  o_orderstatus in ('O', 'P') as yes from orders""")
def f15(t):
    s = F.col("o_orderstatus")
    word = S.case_map(s, {"O": " Yes ", "P": "1"}, F.lit("nope"))
    return t.orders.select("o_orderkey", S.nullif_trim(F.when(s == "F", "  ").otherwise(F.concat(F.lit(" "), s, F.lit(" ")))).alias("trimmed"),
                           S.truthy(word).alias("yes"))


@query("f16_scope", """
select c_custkey, case c_mktsegment when 'MACHINERY' then 'badge' when 'AUTOMOBILE' then 'handheld' else lower(c_mktsegment) end as scope,
  case when c_mktsegment like 'AUTO%' then 'handheld' else 'badge' end as by_prefix from customer""")
def f16(t):
    m = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", S.normalize_scope(m, {"machinery": "badge", "automobile": "handheld"}, "badge").alias("scope"),
        S.scope_of(m, {"AUTO": "handheld"}, "badge").alias("by_prefix"))


@query("f17_vendor_offset", """
select p_partkey, case when p_brand = 'Brand#1' and p_size <= 14 then -3.0::double when p_size between 1 and 14 then -5.0::double
   when p_size between 32 and 177 then -8.0::double end as offset_db from part""")
def f17(t):
    band = S.band_from_channel(F.col("p_size"))
    return t.part.select("p_partkey", S.vendor_offset(F.col("p_brand"), band, {("BRAND#1", "2.4GHz"): -3.0}, S.BAND_OFFSETS).alias("offset_db"))


@query("f18_calibrated_delta", """
with r as (select event_id, -value as dev, case when event_type = 'error' then null else -(value / 2) end as sur,
   case event_type when 'click' then -5.0::double when 'view' then -8.0::double end as off from events)
select event_id, round(sur + off, 6) as expected_rssi_dbm, round(dev - sur, 6) as raw_delta_db, round(dev - (sur + off), 6) as calibrated_delta_db,
  round(abs(dev - (sur + off)), 6) as absolute_calibrated_delta_db,
  case when sur is null then 'pending_manual_entry' when off is null then 'missing_vendor_offset' else 'complete' end as manual_entry_status from r""")
def f18(t):
    v = F.col("value")
    sur = F.when(F.col("event_type") != "error", -(v / 2))
    off = S.case_map(F.col("event_type"), {"click": -5.0, "view": -8.0})
    cols = S.calibrated_delta(-v, sur, off)
    return t.events.select("event_id", *[(c if n.endswith("status") else F.round(c, 6)).alias(n) for n, c in cols.items()])


@query("f19_direction", """
with s as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  case when l_suppkey % 200 = 7 and l_linenumber = 1 then 'server' when l_linenumber <= 3 then 'badge' else 'unknown' end as a,
  case when l_partkey % 200 = 9 then 'server' when l_partkey % 200 < 128 then 'badge' else 'unknown' end as b from lineitem)
select a || '_to_' || b as direction, count(*) as n from s group by all""")
def f19(t):
    from tidewire.catalog.bindings import frame
    s = frame(t, "streams")
    src = S.role_for(F.col("src_ip"), ["10.0.1.7"], ["10.0.0.0/22"])
    dst = S.role_for(F.col("dst_ip"), ["10.9.0.9"], ["10.9.0.0/25"])
    return s.groupBy(S.direction(src, dst).alias("direction")).agg(F.count(F.lit(1)).alias("n"))


@query("f20_confidence_layers", """
with w as (select s_suppkey, s_name, case s_nationkey % 4 when 0 then 'reachable' when 1 then 'unreachable' when 2 then 'managed' else '' end as st,
   case s_nationkey % 3 when 0 then 'ACCESS' when 1 then 'Wireless Controller X' else 'other' end as role, s_acctbal / 100 as gbps from supplier),
c as (select *, case when st in ('reachable', 'managed') then 'high' when st = 'unreachable' then 'low' else 'medium' end as confidence from w)
select s_suppkey, confidence, (confidence = 'high')::int as arc_high, (confidence = 'medium')::int as arc_medium, (confidence = 'low')::int as arc_low,
  case when s_name like '%7' then 1 when role = 'ACCESS' then 3 when upper(role) like '%WIRELESS CONTROLLER%' then 4 else 5 end as layer,
  case when gbps >= 40 then 'blue' when gbps >= 10 then 'green' when gbps >= 1 then 'orange' else 'gray' end as color from c""")
def f20(t):
    n = F.col("s_nationkey")
    state = S.case_map(n % 4, {0: "Reachable ", 1: "Unreachable", 2: "managed"}, F.lit(""))
    role = S.case_map(n % 3, {0: "access", 1: "Wireless Controller X"}, F.lit("other"))
    conf = S.state_confidence([state], ["reachable", "managed"], ["unreachable"])
    return t.supplier.select(
        "s_suppkey", conf.alias("confidence"), *[c.alias(k) for k, c in S.confidence_arcs(conf).items()],
        S.layer_for(F.col("s_name"), role, [("*7", 1)], {"ACCESS": 3}, {"WIRELESS CONTROLLER": 4}).alias("layer"),
        S.speed_color(F.col("s_acctbal") / 100, [(40, "blue"), (10, "green"), (1, "orange")], "gray").alias("color"))


@query("f21_json", """
select event_id, cast(json_extract(props, '$.k') as bigint) as k, true as has_k, false as has_z,
  event_type || ':' || user_id as built_type, cast(3 as bigint) as arr_len from events""")
def f21(t):
    built = S.json_build(type=F.col("event_type"), user=F.col("user_id"), gone=F.lit(None).cast("string"))
    arr = F.concat(F.lit('{"a":['), F.col("user_id").cast("string"), F.lit(",2,3]}"))
    return t.events.select(
        "event_id", S.json_value(F.col("props"), "$.k", "bigint").alias("k"), S.json_has(F.col("props"), "k").alias("has_k"),
        S.json_has(F.col("props"), "z").alias("has_z"),
        F.concat(S.json_value(built, "$.type"), F.lit(":"), S.json_value(built, "$.user")).alias("built_type"),
        S.json_length(arr, "$.a").cast("bigint").alias("arr_len"))


@query("f22_concat_notes", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, concat_ws(' | ', case when l_returnflag <> 'N' then 'flag ' || l_returnflag end,
  case when l_linestatus = 'O' then 'open' end, 'mode ' || l_linenumber) as notes from lineitem""")
def f22(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        S.concat_notes(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("flag "), "l_returnflag")),
                       F.when(F.col("l_linestatus") == "O", "open").otherwise("  "), F.concat(F.lit("mode "), F.col("l_linenumber").cast("string"))).alias("notes"))


@query("f23_age", """
select event_id, greatest((epoch_us(timestamp '2024-01-20 00:00:00') - epoch_us(ts)) / 1000000.0::double, 0)::double as age_seconds from events""")
def f23(t):
    return t.events.select("event_id", S.age_seconds(F.col("ts"), F.lit("2024-01-20 00:00:00").cast("timestamp")).alias("age_seconds"))


@query("f24_edges_overlap", """
with g as (select user_id, min(ts) filter (where event_type = 'view') as a0, max(ts) filter (where event_type = 'view') as a1,
   min(ts) filter (where event_type = 'click') as b0, max(ts) filter (where event_type = 'click') as b1 from events group by 1)
select user_id, case when greatest(a0, b0) - interval 60 second <= least(a1, b1) + interval 60 second then greatest(a0, b0) - interval 60 second end as starts,
  case when greatest(a0, b0) - interval 60 second <= least(a1, b1) + interval 60 second then least(a1, b1) + interval 60 second end as ends,
  abs(epoch_us(b0) / 1e6 - epoch_us(a0) / 1e6) > 0.8 * 86400 as edge from g""")
def f24(t):
    pick = lambda fn, kind: fn(F.when(F.col("event_type") == kind, F.col("ts")))
    g = t.events.groupBy("user_id").agg(pick(F.min, "view").alias("a0"), pick(F.max, "view").alias("a1"),
                                        pick(F.min, "click").alias("b0"), pick(F.max, "click").alias("b1"))
    w = S.overlap_window(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"), 60)
    return g.select("user_id", w["start"].alias("starts"), w["end"].alias("ends"),
                    S.near_edge(S.epoch_seconds(F.col("b0")) - S.epoch_seconds(F.col("a0")), 86400).alias("edge"))


@query("f25_text_slugs", """
select p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') as category,
  case p_size % 4 when 0 then 'wifi7_mlo' when 1 then 'non_wifi6' when 2 then 'wifi6' else 'legacy_b' end as generation from part""")
def f25(t):
    g = S.case_map(F.col("p_size") % 4, {0: "WiFi7 MLO", 1: "Non-WiFi6", 2: "Wi-Fi 6"}, F.lit(" Legacy/B "))
    return t.part.select("p_partkey", S.access_category(F.col("p_brand")).alias("category"), S.generation(g).alias("generation"))
