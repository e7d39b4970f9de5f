"""Readers, text jobs and metric rendering over text and JSON derived from the input tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.catalog.aggregate_queries import rounded
from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.registry import query
from tidewire.operators.aggregates import neighbor_stats
from tidewire.operators.blocked import HEAVY_KEY_ROWS, Order, scan
from tidewire.session import checkpoint_dir, checkpointed, store
from tidewire.sources import exposition as X
from tidewire.sources import files as S
from tidewire.sources import textjobs as T

c = F.col
#: Lines that a task numbers and writes at once.
FILE_LINES = 500_000


def fmt(pattern, *cols):
    return F.format_string(pattern, *cols)


def as_file(d, order):
    """Number the derived lines and write them once, as a file would hold them."""
    return checkpointed(scan(d, ["path"], order, number="line_no").select("path", "line_no", "value"))


def spread(d, *keys):
    """Rows that each take long, over several tasks a core, rows of the same keys in one: a table of millions of short rows may be one small
    file, which one task reads."""
    spark = d.sparkSession
    return d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def as_large_file(d, order, lines, n):
    """The same where a leading value has few lines and a file many: lines are numbered within their leading value and moved up by the
    lines of the values before it, so no file is sorted whole. A row of ``d`` holds ``n`` lines, of which ``lines`` makes an array of ties and
    value: rows are dealt to tasks, and lines are made where they are numbered, so no text is shuffled."""
    lead = ["path", order.col]
    counts = store(d.groupBy(*lead).agg(F.sum(n).alias("_n")), "line-counts")
    heavy = counts.filter(c("_n") > HEAVY_KEY_ROWS).select(*lead)
    before = scan(counts, ["path"], Order(order.col), running={"_upto": "_n"}).select(*lead, F.lit(0).alias("_line"), (c("_upto") - c("_n")).alias("_before"))
    rows = d.withColumn("_line", F.lit(1)).unionByName(before, allowMissingColumns=True)
    if heavy.limit(1).count():
        known = heavy
    else:
        known, rows = None, rows.repartitionByRange((counts.agg(F.sum("_n")).first()[0] or 0) // FILE_LINES + 1, *lead)
    made = rows.select(*lead, "_line", "_before", F.inline_outer(F.when(c("_line") == 1, lines)))
    out = scan(made, lead, Order("_line", order.ties), ffill={"_up": "_before"}, number="_at", heavy=known)
    return store(out.filter("_line = 1").select("path", (c("_up") + c("_at") - 1).alias("line_no"), "value"), "lines", packed=True)


# --- device log ------------------------------------------------------------

def log_lines(t):
    """One log line per event; twenty files."""
    kind, v = c("event_type"), F.floor(c("value")).cast("int")
    mac = F.concat(F.lit("AA:BB:CC:DD:EE:"), F.lpad(F.hex(v % 200), 2, "0"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = (F.when(kind == "purchase", F.concat(stamp, F.lit(" drv: roam_reason = LOW_RSSI["), v.cast("string"), F.lit("]")))
            .when(kind == "signup", fmt("drv: Found %d total APs and %d roam candidate APs", v % 4, v % 3))
            .when(kind == "click", F.concat(stamp, fmt(" drv: [%d%s] [%s] [Channel: %d] [RSSI = -%d] [CU = %d%%] [Score = %d]", v % 5, F.when(v % 2 == 0, "*").otherwise(""), mac, v % 170 + 1, v, v % 100, v)))
            .when((kind == "view") & (v % 2 == 0), F.concat(stamp, fmt(" NCI : Connected to network, channel=%d,bssid=%s,ssid='net%d'", v % 170 + 1, mac, v % 3)))
            .when(kind == "view", F.concat(stamp, fmt(" NCI : Radio signal info,sig_bars=%d,noise=-90,level=-%d,snr=%d,channel=%d,bandwidth=20,powersave=2,cu=%d", v % 6, v, v, v % 170 + 1, v % 100)))
            .when(v % 2 == 0, F.concat(stamp, fmt(" drv: outage time = %d ms, total_scan_time = %d ms", v, v + 5)))
            .otherwise(F.concat(stamp, fmt(" wlan0: RRM-NEIGHBOR-REP-RECEIVED bssid=%s info=0x2f7 op_class=%d chan=%d phy_type=7", mac, v % 20 + 120, v % 170 + 1))))
    d = t.events.select(F.concat(F.lit("log"), (c("user_id") % 20).cast("string")).alias("path"), "ts", "event_id", text.alias("value"))
    return as_file(d, Order("ts", ("event_id",)))


LOG = """
with l as (select 'log' || (user_id % 20) as path, row_number() over (partition by user_id % 20 order by ts, event_id) as line_no, event_type as k, floor(value)::int as v, date_trunc('second', ts) as own from events),
t as (select *, last_value(case when k <> 'signup' then own end ignore nulls) over (partition by path order by line_no) as et, case k when 'purchase' then 'R' when 'signup' then 'F' when 'click' then 'C' end as kind from l),
b as (select *, last_value(kind ignore nulls) over (partition by path order by line_no rows between unbounded preceding and 1 preceding) as before from t where et is not null),
s as (select *, sum(case when kind = 'R' or (kind = 'F' and coalesce(before, '') <> 'R') or (kind = 'C' and before is null) then 1 else 0 end) over (partition by path order by line_no) as event_no,
  'aa:bb:cc:dd:ee:' || lpad(lower(to_hex(v % 200)), 2, '0') as mac from b)
"""


@query("s07_scan_events", LOG + """
, g as (select path, event_no, arg_min(et, line_no) as event_time, min(line_no) as source_line, max(case when kind = 'R' then 'LOW_RSSI[' || v || ']' end) as roam_reason, max(case when kind = 'F' then v % 4 end) as total_aps,
  arg_max(v, line_no) filter (where k = 'error' and v % 2 = 0) as outage_ms, arg_max(v % 170 + 1, line_no) filter (where k = 'view' and v % 2 = 0) as connected_channel, arg_max(mac, line_no) filter (where k = 'view' and v % 2 = 0) as connected_bssid,
  arg_max('net' || (v % 3), line_no) filter (where k = 'view' and v % 2 = 0) as ssid, count(*) filter (where kind = 'C') as candidate_count, count(*) filter (where kind = 'C' and v % 2 = 0) as selected_count,
  arg_min(mac, line_no) filter (where kind = 'C' and v % 2 = 0) as sel from s where event_no > 0 group by 1, 2)
select path, event_no::bigint as event_no, event_time, source_line, roam_reason, total_aps, outage_ms, connected_channel, connected_bssid, ssid, candidate_count, selected_count,
 (case when selected_count <> 1 and candidate_count > 0 then 1 else 0 end + case when candidate_count > total_aps or (candidate_count > 0 and candidate_count < total_aps) then 1 else 0 end + case when sel <> connected_bssid then 1 else 0 end)::int as n_warnings from g""")
def s07(t):
    e = T.scan_events_job(log_lines(t))["events"]
    return e.select("path", "event_no", "event_time", "source_line", "roam_reason", "total_aps", "outage_ms", "connected_channel", "connected_bssid", "ssid", "candidate_count", "selected_count",
                    F.size("warnings").alias("n_warnings"))


@query("s07_scan_candidates", LOG + """
select path, event_no::bigint as event_no, line_no, v % 5 as candidate_index, v % 2 = 0 as selected, mac as bssid, v % 170 + 1 as channel, -v::double as rssi_dbm, v::double as score,
 case when v % 170 + 1 between 1 and 14 then '2.4GHz' when v % 170 + 1 between 32 and 177 then '5GHz' end as band from s where kind = 'C' and event_no > 0""")
def s07c(t):
    return T.scan_events_job(log_lines(t))["candidates"].select("path", "event_no", "line_no", "candidate_index", "selected", "bssid", "channel", "rssi_dbm", "score", "band")


@query("s08_radio_samples", LOG + "select path, line_no, et as event_time, -v::double as level_dbm, v::double as snr_db, v % 170 + 1 as channel from s where k = 'view' and v % 2 = 1")
def s08(t):
    return T.radio_samples_job(log_lines(t)).select("path", "line_no", "event_time", "level_dbm", "snr_db", "channel")


@query("s08_rrm_neighbors", LOG + """
select path, line_no, et as event_time, mac as bssid, v % 20 + 120 as op_class, case when v % 20 + 120 between 131 and 137 then '6GHz' when v % 170 + 1 between 1 and 14 then '2.4GHz' when v % 170 + 1 between 32 and 177 then '5GHz' end as band
from s where k = 'error' and v % 2 = 1""")
def s08b(t):
    return T.rrm_neighbors_job(log_lines(t)).select("path", "line_no", "event_time", "bssid", "op_class", "band")


# --- client scan report ----------------------------------------------------

def report_lines(t):
    """One report per nation: a scan section with the nation's customers, then a section to be ignored."""
    mac = F.concat(F.lit("aabb.cc"), F.lpad(F.lower(F.hex(c("c_custkey") % 40)), 2, "0"), F.lit(".0001"))
    bal = F.floor(F.abs(c("c_acctbal")))
    row = lambda sec: t.customer.select(c("c_nationkey").alias("n"), F.lit(sec).alias("sec"), c("c_custkey").alias("i"), F.concat(
        F.lit("  "), mac, F.lit("   "), F.concat((c("c_custkey") % 3 + 36).cast("string"), F.lit("  -"), (bal % 60 + 30).cast("string"), F.lit(" dBm  SNR: "), (bal % 40).cast("string"), F.lit(" dB"))).alias("value"))
    head = lambda sec, text: t.nation.select(c("n_nationkey").alias("n"), F.lit(sec).alias("sec"), F.lit(0).cast("bigint").alias("i"), F.lit(text).alias("value"))
    d = head(0, "Client MAC Address : aabb.cc00.0001").unionByName(head(1, "Client Scan Reports")).unionByName(head(2, "  Last Report @: 05/21/2026 09:47:05 UTC"))
    d = d.unionByName(row(3)).unionByName(head(4, "Nearby AP Statistics:")).unionByName(row(5))
    d = d.withColumn("path", F.concat(F.lit("n"), c("n").cast("string")))
    return as_file(d, Order("sec", ("i",)))


@query("s09_scan_report", """
with r as (select 'n' || c_nationkey as path, c_custkey, 'aa:bb:cc:' || lpad(lower(to_hex(c_custkey % 40)), 2, '0') || ':00:01' as bssid, (c_custkey % 3 + 36)::int as channel, -(floor(abs(c_acctbal)) % 60 + 30) as rssi, floor(abs(c_acctbal)) % 40 as snr from customer),
k as (select *, row_number() over (partition by path, bssid, channel order by rssi desc, c_custkey) as rn from r)
select path, bssid, channel, rssi as rssi_dbm, snr as snr_db, timestamp '2026-05-21 09:47:05' as report_time from k where rn = 1""")
def s09(t):
    out = T.scan_report_job(report_lines(t))
    return out["candidates"].join(out["report_time"], "path").select("path", "bssid", "channel", "rssi_dbm", "snr_db", "report_time")


# --- controller dump -------------------------------------------------------

def dump_lines(t):
    """Dumps with one radio block per order, its lineitems as neighbours, and one latency block per customer."""
    o, n = c("o_orderkey"), c("o_orderkey").cast("string")
    part = F.concat(F.lit("dump"), (o % 7).cast("string"))
    ch = F.when(o % 3 == 0, "100#").when(o % 3 == 1, "44").otherwise("999")
    pre = (F.concat(F.lit("wlc#show ap name AP"), n, F.lit(" auto-rf dot11 5ghz")), F.concat(F.lit("AP Name: AP"), n), F.lit("Nearby APs"))
    post = (F.lit("Radar Information"), F.concat(F.lit("Current Channel: "), ch), fmt("Channel Width: %d", F.when(o % 2 == 0, 80).otherwise(90)), fmt("Channel changes due to radar: %d", o % 5),
                   F.concat(F.lit("Zero Wait DFS Enabled: "), F.when(o % 2 == 0, "yes").otherwise("no")), F.lit("Zero Wait DFS Capable: yes"), F.lit("Load Information"),
                   fmt("  Receive Utilization: %d%%", o % 100), fmt("  Channel Utilization: %d%%", o % 150), F.when(o % 50 == 0, "% Invalid input detected").otherwise("ok"))
    lat = (fmt("show wireless stats ap name AP%s traffic-distribution slot 1 latency access-category voice", n), F.lit("Time Period : Ending at 05/21/2026 09:47:05"),
                  F.lit("              WiFi6     Non-WiFi6"), fmt("Active Clients  %d   %d", o % 9, o % 4), fmt("Average Latency (us)  %d  %d", o % 1000, o % 500), fmt("Very High  %d %d", o % 3, o % 2), fmt("Good  %d %d", o % 77, o % 66))
    p, q, line = c("p"), c("q"), c("l_linenumber")
    near = (line * 100000 + p).cast("int"), fmt("N%d 00:11:22:33:44:%s %d -%d", p, F.lpad(F.hex(p % 256), 2, "0"), line + 35, q + 20)
    entry = lambda sec, i, value: F.struct(F.lit(sec).alias("sec"), i.alias("i"), value.alias("value"))
    fixed = [entry(sec, F.lit(i), value) for sec, values in ((0, pre), (2, post), (3, lat)) for i, value in enumerate(values)]
    heard = t.lineitem.select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", F.floor(c("l_partkey")).alias("p"), F.floor(c("l_quantity")).cast("int").alias("q"), F.lit(True).alias("near"))
    d = heard.unionByName(t.orders.select("o_orderkey", F.lit(False).alias("near")), allowMissingColumns=True).withColumns({"path": part, "k": o})
    return as_large_file(d, Order("k", ("sec", "i", "value")), F.when(c("near"), F.array(entry(1, *near))).otherwise(F.array(*fixed)), F.when(c("near"), 1).otherwise(len(fixed)))


@query("s10_rf_snapshots", """
select 'dump' || (o_orderkey % 7) as path, 'AP' || o_orderkey as ap_name, '5ghz' as band, (case o_orderkey % 3 when 0 then 100 when 1 then 44 end)::int as current_channel, o_orderkey % 3 = 0 as cac_running, o_orderkey % 3 = 0 as is_dfs_channel,
 (case when o_orderkey % 2 = 0 then 80 end)::int as channel_width_mhz, (o_orderkey % 5)::int as radar_changes_total, o_orderkey % 2 = 0 as zero_wait_dfs_enabled, true as zero_wait_dfs_capable,
 (o_orderkey % 100)::double as receive_utilization_pct, case when o_orderkey % 150 <= 100 then (o_orderkey % 150)::double end as channel_utilization_pct from orders""")
def s10(t):
    s = T.rf_dump_job(dump_lines(t))["snapshots"]
    return s.select("path", "ap_name", "band", "current_channel", "cac_running", "is_dfs_channel", "channel_width_mhz", "radar_changes_total", "zero_wait_dfs_enabled", "zero_wait_dfs_capable",
                    "receive_utilization_pct", "channel_utilization_pct")


@query("s10_rf_neighbors", """
select 'AP' || l_orderkey as ap_name, count(*) as neighbor_count, max(-(floor(l_quantity)::int + 20)) as strongest_dbm, min(-(floor(l_quantity)::int + 20)) as weakest_dbm, count(distinct l_linenumber) as unique_channels,
 array_to_string(list_sort(list(distinct l_linenumber + 35)), ',') as channel_list from lineitem where l_orderkey in (select o_orderkey from orders) group by 1""")
def s10n(t):
    n = T.rf_dump_job(dump_lines(t))["neighbors"]
    return neighbor_stats(n, ["ap_name"], "rssi_dbm", "channel", []).select("ap_name", "neighbor_count", "strongest_dbm", "weakest_dbm", "unique_channels", "channel_list")


@query("s10_rf_latencies", """
with g as (select o_orderkey, unnest(['wifi6', 'non_wifi6']) as client_generation from orders)
select 'AP' || o_orderkey as ap_name, '5ghz' as band, 'voice' as access_category, client_generation, case when client_generation = 'wifi6' then o_orderkey % 1000 else o_orderkey % 500 end::double as avg_latency_us,
 case when client_generation = 'wifi6' then o_orderkey % 9 else o_orderkey % 4 end as active_clients, case when client_generation = 'wifi6' then o_orderkey % 3 else o_orderkey % 2 end as packets_very_high,
 case when client_generation = 'wifi6' then o_orderkey % 77 else o_orderkey % 66 end as packets_good, timestamp '2026-05-21 09:47:05' as sample_end from g""")
def s10l(t):
    d = T.rf_dump_job(dump_lines(t))["latencies"]
    return d.select("ap_name", "band", "access_category", "client_generation", "avg_latency_us", "active_clients", "packets_very_high", "packets_good", "sample_end")


@query("s11_collection_stats", """
select 'dump' || (o_orderkey % 7) as path, 2 * count(*) as commands_total, count(*) filter (where o_orderkey % 50 = 0) as commands_failed, count(*) as ap_count, 2 * count(*) as latency_samples,
 case when count(*) filter (where o_orderkey % 50 = 0) > 0 then 'collect_failed' else 'none' end as last_error_reason from orders group by 1""")
def s11(t):
    lines = dump_lines(t)
    return T.collection_stats(lines, T.rf_dump_job(lines)).select("path", "commands_total", "commands_failed", "ap_count", "latency_samples", "last_error_reason")


# --- ping, transcripts -----------------------------------------------------

@query("s13_ping_log", """
with g as (select user_id, round(value, 2) as v, row_number() over (partition by user_id order by value) as rn, count(*) over (partition by user_id) as n from events)
select user_id::varchar as run_id, (count(*) + 2)::int as sent, count(*)::int as received, round(min(v), 4) as rtt_min_ms, round(avg(v), 4) as rtt_avg_ms, round(max(v), 4) as rtt_max_ms, round(max(v) filter (where rn = greatest(1, ceil(n * 0.95::double))), 4) as rtt_p95_ms,
 round(stddev_pop(v), 4) as rtt_mdev_ms, round(max(v) - min(v), 4) as pdv_range_ms from g group by 1""")
def s13(t):
    reply = fmt("64 bytes from 10.0.0.1: icmp_seq=%d ttl=60 time=%.2f ms", c("event_id"), c("value"))
    g = t.events.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(reply)), "\n").alias("t"), F.count(F.lit(1)).alias("n"))
    out = F.concat("t", fmt("\n%d packets transmitted, %d received, 1%% packet loss, time 9ms", c("n") + 2, c("n")))
    d = T.ping_log_job(g.select(c("user_id").cast("string").alias("run_id"), out.alias("output")))
    return rounded(d.select("run_id", "sent", "received", "rtt_min_ms", "rtt_avg_ms", "rtt_max_ms", "rtt_p95_ms", "rtt_mdev_ms", "pdv_range_ms"), 4)


def transcript(t):
    """Conversations as terminal logs: a user's turn opens a command sheet."""
    user = F.array(F.lit("wlc#terminal length 0"), F.concat(F.lit("wlc#show wireless multicast group 230.230.1."), (c("turn") % 9).cast("string"), F.lit(" vlan 7")), F.concat(F.lit("! Attempt: a"), c("turn").cast("string")))
    other = F.array(F.concat(F.lit("output "), F.length("text").cast("string")))
    d = t.conversations.select(F.concat(F.lit("c"), c("conv_id").cast("string")).alias("path"), "turn", F.posexplode(F.when(c("role") == "user", user).otherwise(other)).alias("i", "value"))
    return as_file(d, Order("turn", ("i",)))


@query("s14_transcript_blocks", """
with b as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as blk from conversations)
select 'c' || conv_id as path, (blk - 1)::bigint as block_index, 2 as n_commands, 'resolved_group' as phase, 'a' || min(turn) as attempts, (length('wlc#terminal length 0') + length('! Attempt: a' || min(turn)) + length('wlc#show wireless multicast group 230.230.1.X vlan 7') + 2
 + coalesce(sum(length('output ' || length(text)) + 1) filter (where role <> 'user'), 0))::int as text_length from b where blk > 0 group by conv_id, blk""")
def s14(t):
    d = T.transcript_blocks_job(transcript(t))
    return d.select("path", "block_index", F.size("commands").alias("n_commands"), "phase", F.array_join("attempt_ids", ",").alias("attempts"), F.length("text").alias("text_length"))


@query("s15_snapshot_extract", """
with b as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as blk from conversations)
select 'c' || conv_id as path, (blk - 1)::bigint as block_index, '230.230.1.' || (min(turn) % 9) as group_ip, 7 as group_vlan, '01:00:5e:66:01:0' || (min(turn) % 9) as dynamic_group_mac, 'resolved_confirmed' as vlan_context_state from b where blk > 0 group by conv_id, blk""")
def s15(t):
    d = T.snapshot_extract_job(T.transcript_blocks_job(transcript(t)), expected_vlan=7)
    return d.select("path", "block_index", "group_ip", "group_vlan", "dynamic_group_mac", "vlan_context_state")


@query("s15_snapshot_fields", """
select c_custkey, '230.230.0.' || (c_custkey % 250) as group_ip, (c_custkey % 4000)::int as mgid, (c_custkey % 90)::int as group_vlan, c_custkey % 2 = 0 as receiver_group_member, case when c_custkey % 2 = 0 then 'joined' end as receiver_group_status,
 'ap' || c_nationkey as receiver_ap, -(c_custkey % 90)::int as receiver_rssi, c_custkey % 3 = 0 as multicast_enabled, case c_custkey % 3 when 0 then 'v3' else 'unknown' end as igmp_version from customer""")
def s15f(t):
    k = c("c_custkey")
    text = F.concat_ws("\n", F.lit("wlc#show wireless multicast group summary"), fmt("  %d   239.1.1.1   5", k % 9), fmt("wlc#show wireless multicast group 230.230.0.%d vlan %d", k % 250, k % 90), fmt("Group : 230.230.0.%d", k % 250),
                       fmt("Vlan : %d", k % 90), fmt("MGID : %d", k % 4000), F.lit("Client List"), F.when(k % 2 == 0, "  aabb.cc00.0001   joined").otherwise("  aabb.cc00.0002   joined"), F.lit("wlc#show wireless client mac-address x detail"),
                       fmt("AP Name : ap%d", c("c_nationkey")), fmt("RSSI : -%d", k % 90), F.when(k % 3 == 0, "Multicast : Enabled").otherwise("Multicast : Disabled"), F.when(k % 3 == 0, "IGMP version 3").otherwise("igmp"))
    d = T.snapshot_extract_job(spread(t.customer.select("c_custkey", "c_nationkey")).select("c_custkey", text.alias("text")), receiver_mac="aa:bb:cc:00:00:01")
    return d.select("c_custkey", "group_ip", "mgid", "group_vlan", "receiver_group_member", "receiver_group_status", "receiver_ap", "receiver_rssi", "multicast_enabled", "igmp_version")


@query("s15_ap_mgid_rows", """
select 's' || (s_suppkey % 3) as path, s_suppkey as line_no, case when s_suppkey % 2 = 0 then 'client' else 'counter' end as kind, case when s_suppkey % 2 = 0 then s_suppkey else s_suppkey + 1 end as mgid,
 case when s_suppkey % 2 = 0 then 'aa:bb:cc:00:00:0f' end as receiver_mac, 'mc2uc' as ap_delivery_mode, case when s_suppkey % 2 = 1 then s_suppkey + 2 end as ap_rx_packets, case when s_suppkey % 2 = 1 then s_suppkey + 3 end as ap_tx_packets from supplier""")
def s15m(t):
    k = c("s_suppkey")
    text = F.when(k % 2 == 0, fmt("%d aa:bb:cc:00:00:0f mc2uc slot 1", k)).otherwise(fmt("mgid %d mc2uc %d %d", k + 1, k + 2, k + 3))
    return T.ap_mgid_rows(t.supplier.select(F.concat(F.lit("s"), (k % 3).cast("string")).alias("path"), k.alias("line_no"), text.alias("value")))


# --- JSON ------------------------------------------------------------------

@query("s01_throughput_results", """
select o_orderkey, case when o_orderkey % 10 = 9 then 'unknown' else 'dev' || (o_custkey % 5) end as device, 'host' || (o_custkey % 3) as target, case when o_orderkey % 4 = 3 or o_orderkey % 10 = 9 then 0 else 1 end as up, o_orderkey % 10 = 9 as parse_error,
 case when o_orderkey % 10 <> 9 and o_orderkey % 4 <> 3 then round(o_totalprice, 2) end as bits_per_second, case when o_orderkey % 10 <> 9 and o_orderkey % 4 <> 3 then 1.5::double end as jitter_ms,
 case when o_orderkey % 10 <> 9 then 0.012::double end as raw_latency_seconds from orders where o_orderkey % 10 <> 9 union all
select o_orderkey, 'd' || (o_custkey % 5), 'unknown', 0, true, null, null, null from orders where o_orderkey % 10 = 9""")
def s01(t):
    k = c("o_orderkey")
    price = F.round("o_totalprice", 2)
    body = F.when(k % 2 == 0, fmt('"sum_received": {"bits_per_second": %s, "jitter_ms": 1.5}, "sum": {"bits_per_second": 1}', price.cast("string"))).otherwise(
        fmt('"sum": {"bits_per_second": %s, "jitter_ms": 1.5}', price.cast("string")))
    end = F.when(k % 4 == 3, "").otherwise(body)
    res = F.concat(F.lit('{"start": {"connecting_to": {"host": "host'), (c("o_custkey") % 3).cast("string"), F.lit('", "port": 5201}, "timestamp": {"timesecs": 1700000000}}, "end": {'), end, F.lit("}}"))
    meta = F.concat(F.lit('"metadata": {"device": "dev'), (c("o_custkey") % 5).cast("string"), F.lit('", "rtt_ms": 12}'))
    doc = F.when(k % 10 == 9, "{broken").when(k % 3 == 0, F.concat(F.lit("{"), meta, F.lit(', "iperf3": '), res, F.lit("}"))).otherwise(F.concat(F.lit("{"), meta, F.lit(", "), F.expr("''"), F.substring(res, 2, 100000)))
    path = F.concat(F.lit("/in/d"), (c("o_custkey") % 5).cast("string"), F.lit("/raw/upstream-20240101-010203.json"))
    files = t.orders.select("o_orderkey", path.alias("path0"), doc.alias("content"))
    files = files.select(F.concat("path0", F.lit("#"), k.cast("string")).alias("key"), "path0", "content")
    d = S.throughput_results(files.select(F.concat(F.regexp_extract("key", "#(.*)$", 1), F.lit("!"), "path0").alias("path"), "content", F.lit(None).cast("timestamp").alias("mtime")))
    return d.select(F.substring_index("path", "!", 1).cast("bigint").alias("o_orderkey"), "device", "target", "up", "parse_error", "bits_per_second", "jitter_ms", "raw_latency_seconds")


@query("s02_survey_points", """
with v as (select user_id, ts, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, min(ts) over (partition by user_id) as t0, max(ts) over (partition by user_id) as t1 from events where event_type = 'view')
select 'u' || user_id as survey_id, i::int as point_index, date_trunc('second', t0) + interval 10 millisecond * (epoch(date_trunc('second', ts)) - epoch(date_trunc('second', t0)))::bigint as measured_at, event_id::double as x_m from v where user_id % 2 = 0
union all select 'g' || event_id, null, date_trunc('second', ts), event_id::double from v where user_id % 2 = 1""")
def s02(t):
    v = t.events.filter("event_type = 'view'").withColumn("s", F.unix_seconds("ts"))
    g = v.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "s"))).alias("p"))
    s0 = F.element_at("p", 1)["s"]
    ms = F.transform("p", lambda x: F.concat(F.lit('{"time": '), ((x["s"] - s0) * 10).cast("string"), F.lit(', "location": {"x": '), x["event_id"].cast("string"), F.lit(', "y": 1.5}}')))
    native = F.concat(F.lit('{"surveys": [{"id": "u'), c("user_id").cast("string"), F.lit('", "name": "walk", "startTime": '), s0.cast("string"), F.lit(', "routePoints": ['), F.array_join(ms, ","), F.lit("]}]}"))
    iso = lambda x: F.concat(F.lit('{"id": "g'), x["event_id"].cast("string"), F.lit('", "timestamp": "'), F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z", "x": '), x["event_id"].cast("string"), F.lit("}"))
    generic = F.concat(F.lit('{"surveyData": {"measurements": ['), F.array_join(F.transform("p", iso), ","), F.lit("]}}"))
    files = g.select(F.concat(F.lit("f"), c("user_id").cast("string")).alias("path"), F.when(c("user_id") % 2 == 0, native).otherwise(generic).alias("content"))
    return S.survey_points(files).select("survey_id", "point_index", "measured_at", "x_m")


@query("s03_ap_name_lookup", """
with e as (select s_suppkey, s_name, p_partkey from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey),
m as (select '00:00:00:00:' || substr(lpad(lower(to_hex(p_partkey % 500)), 4, '0'), 1, 2) || ':' || substr(lpad(lower(to_hex(p_partkey % 500)), 4, '0'), 3, 2) as bssid, s_name, s_suppkey, p_partkey from e)
select bssid, arg_max(s_name, s_suppkey) as ap_name from m group by 1""")
def s03(t):
    aps = t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    mac = F.lpad(F.hex(c("p_partkey") % 500), 12, "0")
    meas = t.part.select(c("p_partkey").alias("id"), mac.alias("mac"))
    # one radio per order and supplier, with the few parts of it
    radios = t.lineitem.groupBy("l_orderkey", c("l_suppkey").alias("ap_id")).agg(F.array_sort(F.collect_list("l_partkey")).alias("measurement_ids")).select("ap_id", c("ap_id").alias("pos"), "measurement_ids")
    return S.ap_name_lookup(aps, radios, meas)


@query("s04_manual_observations", """
select c_custkey::varchar as survey_point_id, lpad(lower(to_hex(c_custkey % 256)), 2, '0') as tail, timestamp '2024-01-01 10:00:00' as survey_time, case when c_custkey % 3 = 0 then 'X' when c_custkey % 3 = 1 then '5GHz' else '2.4GHz' end as band, -(c_nationkey)::double as rssi_dbm
from customer where c_custkey % 5 > 0""")
def s04(t):
    k = c("c_custkey")
    mac = F.concat(F.lit("AA-BB-CC-00-00-"), F.lpad(F.hex(k % 256), 2, "0"))
    rows = t.customer.select(F.lit("r").alias("test_run_id"), k.cast("string").alias("survey_point_id"), F.lit("2024-01-01 04:00:00").alias("survey_time"), mac.alias("bssid"),
                             F.when(k % 3 == 1, "36").otherwise("6").alias("channel"), F.when(k % 3 == 0, "X").otherwise(" ").alias("band"), F.when(k % 5 > 0, F.concat(F.lit("-"), c("c_nationkey").cast("string"))).otherwise("").alias("survey_rssi_dbm"))
    d = S.manual_observations(rows, "America/Chicago")
    return d.select("survey_point_id", F.substring_index("bssid", ":", -1).alias("tail"), "survey_time", "band", "rssi_dbm")


@query("s12_client_detail", """
select s_suppkey::varchar as record_id, 'aa:bb:cc:00:00:' || lpad(lower(to_hex(s_suppkey % 256)), 2, '0') as client_mac, case when s_suppkey % 2 = 0 then 'site' || s_nationkey else 'unknown' end as site_tag, 'wlc1' as wlc, '5ghz' as band, -(s_nationkey)::double as rssi_dbm,
 case when s_suppkey % 2 = 0 then s_nationkey * 1000.0 else s_nationkey end::double as latency_voice_us, case when s_suppkey % 2 = 0 then 'ft' else 'non_ft' end as ft_state from supplier where s_suppkey % 7 > 0""")
def s12(t):
    k, n = c("s_suppkey"), c("s_nationkey").cast("string")
    mac = F.when(k % 7 > 0, F.concat(F.lit("AABB.CC00.00"), F.lpad(F.hex(k % 256), 2, "0"))).otherwise("bad")
    a = F.concat(F.lit('{"detail": {"hostMac": "'), mac, F.lit('", "site": "site'), n, F.lit('", "controller": "wlc1.corp.example", "radio": {"radioType": "802.11a/5GHz", "rssi": "-'), n,
                 F.lit(' dBm", "voiceLatencyMs": '), n, F.lit('}, "authKeyMgmt": "PSK + FT"}}'))
    b = F.concat(F.lit('{"client_mac": "'), mac, F.lit('", "wlc_name": "wlc1", "frequency": "5.0 GHz", "rssi_dbm": -'), n, F.lit(', "latency_voice_us": '), n, F.lit(', "fastTransitionState": "disabled"}'))
    d = S.client_detail_job(t.supplier.select(k.cast("string").alias("record_id"), F.when(k % 2 == 0, a).otherwise(b).alias("content")), "record_id", "content")
    return d.select("record_id", "client_mac", "site_tag", "wlc", "band", "rssi_dbm", "latency_voice_us", "ft_state")


# --- exposition ------------------------------------------------------------

@query("s16_read_exposition", "select event_id, event_type as metric, 'u\"' || user_id || '\\x' as usr, value from events")
def s16(t):
    usr = F.concat(F.lit('u"'), c("user_id").cast("string"), F.lit("\\x"))
    line = F.concat("event_type", F.lit('{id="'), c("event_id").cast("string"), F.lit('",user="'), X.escape(usr), F.lit('"} '), c("value").cast("string"))
    d = X.read_exposition(t.events.select(line.alias("value")))
    return d.select(c("labels")["id"].cast("bigint").alias("event_id"), "metric", c("labels")["user"].alias("usr"), "value")


@query("s17_exposition_lines", """
select event_type as metric, event_type || '{kind="a\\"b",user="' || user_id || '"} ' || count(*) as line from events group by event_type, user_id""")
def s17(t):
    g = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    s = g.select(c("event_type").alias("metric"), F.create_map(F.lit("user"), c("user_id").cast("string"), F.lit("kind"), F.lit('a"b')).alias("labels"), "value")
    return X.exposition_lines(s)


_STREAM = ctes("streams") + """
, s as (select *, measurement_mode = 'rtp' and packet_count >= 20 as ok from streams),
r as (select device_role, interarrival_p50_ms as a, interarrival_p95_ms as b, row_number() over (partition by device_role order by interarrival_p50_ms) as ra, row_number() over (partition by device_role order by interarrival_p95_ms) as rb, count(*) over (partition by device_role) as n from s where ok),
q as (select device_role, max(a) filter (where ra = ceil(n * 0.5::double)) as p50, max(b) filter (where rb = ceil(n * 0.95::double)) as p95 from r group by 1),
g as (select device_role, count(*)::double as streams, sum(packet_count)::double as packets, sum(byte_count)::double as bytes, count(*) filter (where ok)::double as trusted_streams, sum(expected_packets) filter (where ok)::double as expected_packets,
  sum(lost_packets) filter (where ok)::double as lost_packets, max(interarrival_max_ms) filter (where ok) as interarrival_max_ms, count(*) filter (where dscp_mismatch)::double as dscp_mismatch_streams, quantile_cont(jitter_ms, 0.5) filter (where ok) as jitter_ms from s group by 1),
w as (select g.*, p50 as interarrival_p50_ms, p95 as interarrival_p95_ms, lost_packets / expected_packets as loss_ratio from g join q on q.device_role = g.device_role)
select device_role, 'stream_' || metric as metric, round(value, 6) as value from (unpivot w on columns(* exclude (device_role)) into name metric value value)"""


@query("s18_stream_metrics", _STREAM)
def s18(t):
    return rounded(X.render_stream_metrics(frame(t, "streams"), ["device_role"]))


@query("s18_rejections", ctes("streams") + """
select device_role, coalesce(nullif(r, ''), 'unspecified') as reason, count(*)::double as value, 'stream_rejected' as metric from (select device_role, unnest(case when server_key % 2 = 0 then ['x', 'y'] else [null]::varchar[] end) as r from streams where measurement_mode = 'rtp_candidate_rejected') group by 1, 2""")
def s18b(t):
    d = frame(t, "streams").withColumn("rs", F.when(c("server_key") % 2 == 0, F.array(F.lit("x"), F.lit("y"))))
    return X.render_rejections(d, ["device_role"], "rs")


@query("s19_rf_metrics", """
with n as (select l_suppkey, -40 - l_quantity::int as rssi from lineitem), g as (select l_suppkey, count(*)::double as a, avg(rssi) as b, count(*) filter (where rssi >= -65)::double as c, count(*) filter (where rssi >= -75)::double as d from n group by 1)
select l_suppkey, 'neighbor_count' as metric, '' as threshold_dbm, a as value from g union all select l_suppkey, 'neighbor_rssi_mean_dbm', '', round(b, 5) from g
union all select l_suppkey, 'neighbor_high_rssi_total', '-65', c from g union all select l_suppkey, 'neighbor_high_rssi_total', '-75', d from g""")
def s19(t):
    d = t.lineitem.select("l_suppkey", (-40 - c("l_quantity").cast("int")).alias("rssi"), c("l_linenumber").alias("ch"))
    n = neighbor_stats(d, ["l_suppkey"], "rssi", "ch", [-65, -75])
    return rounded(X.render_rf_metrics(n, ["l_suppkey"], {"neighbor_count": "neighbor_count", "neighbor_rssi_mean_dbm": "mean_dbm"}, {-65: "ge_neg65", -75: "ge_neg75"}), 5)


@query("s19_client_metrics", """
with p as (select p_partkey, case p_size % 3 when 0 then 'ft' when 1 then 'non_ft' else 'unknown' end as st, case when p_size % 4 > 0 then p_size::double end as v from part)
select p_partkey, 'rssi' as metric, '' as state, v as value from p where v is not null union all
select p_partkey, 'client_state', s, (st = s)::int::double from p, (select unnest(['ft', 'non_ft', 'unknown']) as s)""")
def s19b(t):
    n = c("p_size")
    d = t.part.select("p_partkey", F.when(n % 3 == 0, "ft").when(n % 3 == 1, "non_ft").otherwise("unknown").alias("st"), F.when(n % 4 > 0, n.cast("double")).alias("v"))
    return X.render_client_metrics(d, ["p_partkey"], {"rssi": "v"}, "st", ["ft", "non_ft", "unknown"])


KINDS = [(r"^p[0-4]", "early"), (r"\.html$", "page")]
PAGE_FILES = """
with f as (select '/in/' || (page_id % 50) || '/p' || page_id || case when page_id % 5 = 0 then '.txt' else '.html' end as path, 'p' || page_id as stem, length(url) as size_bytes, page_id % 50 as d, page_id from pages),
k as (select *, case when substr(stem, 2, 1) in ('0', '1', '2', '3', '4') then 'early' when page_id % 5 > 0 then 'page' end as file_type from f)
"""


def page_files(t):
    """Each page as a file of a folder."""
    k = c("page_id")
    path = F.concat(F.lit("/in/"), (k % 50).cast("string"), F.lit("/p"), k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".html"))
    return t.pages.select(path.alias("path"), F.length("url").cast("long").alias("size_bytes"), F.timestamp_seconds(k).alias("mtime"))


@query("s21_file_inventory", PAGE_FILES + """
select path, '/in/' || d as folder, size_bytes::bigint as size_bytes, file_type from k where file_type is not null and size_bytes >= 20""")
def s21(t):
    return S.classify_files(page_files(t), KINDS, 20).select("path", "folder", "size_bytes", "file_type")


@query("s21_newest_per_folder", PAGE_FILES + """
select '/in/' || d as folder, arg_max(path, page_id) as path from k where file_type is not null and size_bytes >= 20 group by 1""")
def s21n(t):
    return S.newest_per_folder(S.classify_files(page_files(t), KINDS, 20)).select("folder", "path")


@query("s13_ping_samples", """
select event_type, count(*) as received, min(value) as rtt_min_ms, max(value) as rtt_max_ms, round(avg(value), 6) as rtt_avg_ms, list_sort(list(value))[ceil(0.95::double * count(*))::int] as rtt_p95_ms from events group by 1""")
def s13r(t):
    from tidewire.sources.textjobs import ping_samples_stats
    return ping_samples_stats(t.events, ["event_type"], "value").select("event_type", "received", "rtt_min_ms", "rtt_max_ms", F.round("rtt_avg_ms", 6).alias("rtt_avg_ms"), "rtt_p95_ms")


# --- files written and read back -------------------------------------------

def place(t, name):
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("s05_template_csv", """
select event_id::varchar as survey_point_id, ts as survey_time, value as badge_rssi_dbm, user_id % 2 = 0 as badge_selected, case when event_type = 'view' then 'a, "b"' end as notes from events""")
def s05(t):
    out = place(t, "s05")
    S.write_template_csv(t.events.select(c("event_id").cast("string").alias("survey_point_id"), c("ts").alias("survey_time"), c("value").alias("badge_rssi_dbm"), (c("user_id") % 2 == 0).alias("badge_selected"),
                                         F.when(c("event_type") == "view", 'a, "b"').alias("notes")), out)
    return S.read_template_csv(t.spark, out).select("survey_point_id", "survey_time", "badge_rssi_dbm", "badge_selected", "notes")


@query("s06_read_log_lines", """
with l as (select lang, unnest(string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10))) as line from documents where text is not null)
select lang, count(*) as n, sum(length(line))::bigint as chars from l group by 1""")
def s06(t):
    out = place(t, "s06")
    t.documents.filter(c("text").isNotNull()).select("lang", "text").write.partitionBy("lang").text(out)
    d = S.read_log_lines(t.spark, out)
    g = d.groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"), "path").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("top"), F.sum(F.length("value")).alias("chars"))
    # the last line number of a file is its line count
    return g.groupBy("lang").agg(F.sum(F.when(c("n") == c("top"), c("n")).otherwise(-1)).alias("n"), F.sum("chars").alias("chars"))


@query("s01_read_folder", """
select s_suppkey, 'dev' || (s_nationkey % 5) as device, 'host' || (s_suppkey % 3) as target, '5201' as target_port,
 case when s_suppkey % 4 = 0 then 'own' || s_suppkey when s_suppkey % 3 = 0 then 'cell zero' when s_suppkey % 3 = 1 then 'cell one' else 'host2' end as target_name,
 round(abs(s_acctbal), 2) as bits_per_second, 1 as up from supplier""")
def s01f(t):
    """A folder with one test result per supplier, read back, its targets named by host and port, then by host."""
    out = place(t, "s01")
    k = c("s_suppkey")
    one = lambda *cols: F.struct(*cols)
    host = F.concat(F.lit("host"), (k % 3).cast("string"))
    start = one(one(host.alias("host"), F.lit(5201).alias("port")).alias("connecting_to"), one(F.lit(1700000000).alias("timesecs")).alias("timestamp"))
    end = one(one(F.round(F.abs("s_acctbal"), 2).alias("bits_per_second")).alias("sum_received"))
    meta = one(F.concat(F.lit("dev"), (c("s_nationkey") % 5).cast("string")).alias("device"), F.when(k % 4 == 0, F.concat(F.lit("own"), k.cast("string"))).alias("target_name"))
    # one file per key: tasks write and place them side by side, else one task writes all and the driver moves each; 64 shelves of folders are listed side by side too
    runs = spread(t.supplier, k).select((k % 64).alias("shelf"), k.alias("run"), meta.alias("metadata"), start.alias("start"), end.alias("end"))
    runs.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("shelf", "run").json(out)
    names = t.region.filter("r_regionkey < 3").select(
        F.when(c("r_regionkey") == 0, "host0:5201").when(c("r_regionkey") == 1, "host1").otherwise("host2:9").alias("key"), F.when(c("r_regionkey") == 0, "cell zero").otherwise("cell one").alias("name"))
    d = S.with_target_config(S.read_iperf_json(t.spark, out), names)
    return d.select(F.regexp_extract("path", "run=([0-9]+)/", 1).cast("bigint").alias("s_suppkey"), "device", "target", "target_port", "target_name", "bits_per_second", "up")


@query("s04_read_folder", """
select c_custkey::varchar as survey_point_id, 'aa:bb:cc:00:00:' || lpad(lower(to_hex(c_custkey % 256)), 2, '0') as bssid, case when c_custkey % 3 = 0 then 'X' when c_custkey % 3 = 1 then '5GHz' else '2.4GHz' end as band,
 (case when c_custkey % 3 = 1 then 36 else 6 end)::int as channel, timestamp '2024-01-01 10:00:00' + interval 1 second * c_nationkey as survey_time, -(c_nationkey)::double as rssi_dbm, case when c_custkey % 2 = 0 then 'x, "y"' end as notes
from customer where c_custkey % 5 > 0""")
def s04f(t):
    """Observations in the template's columns, written as a folder of CSV files and read back."""
    out = place(t, "s04")
    k = c("c_custkey")
    mac = F.concat(F.lit("AA-BB-CC-00-00-"), F.lpad(F.hex(k % 256), 2, "0"))
    S.write_template_csv(t.customer.select(
        k.cast("string").alias("survey_point_id"), F.timestamp_seconds(c("c_nationkey") + 1704103200).alias("survey_time"), mac.alias("bssid"), F.when(k % 3 == 1, 36).otherwise(6).alias("channel"),
        F.when(k % 3 == 0, "X").alias("band"), F.when(k % 5 > 0, -c("c_nationkey").cast("double")).alias("survey_rssi_dbm"), F.when(k % 2 == 0, 'x, "y"').alias("notes")), out)
    return S.read_manual_csv(t.spark, out, "America/Chicago").select("survey_point_id", "bssid", "band", "channel", "survey_time", "rssi_dbm", "notes")


@query("s17_write_exposition", "select event_type as metric, count(distinct user_id) + 2 as n_lines, true as sorted from events group by 1")
def s17w(t):
    out = place(t, "s17")
    g = t.events.groupBy("event_type", "user_id").agg(F.sum("value").alias("value"))
    s = g.select(c("event_type").alias("metric"), F.create_map(F.lit("user"), c("user_id").cast("string")).alias("labels"), "value")
    helps = t.events.select(c("event_type").alias("metric")).distinct().withColumns({"help": F.lit("h"), "type": F.lit("gauge")})
    X.write_exposition(s, out, helps)
    d = S.read_log_lines(t.spark, out).withColumn("metric", F.regexp_extract("path", "metric=([^/]+)/", 1))
    first = F.min_by(c("value").startswith("# HELP"), F.struct("path", "line_no"))
    return d.groupBy("metric").agg(F.count(F.lit(1)).alias("n_lines"), first.alias("sorted"))


@query("s20_tables", "select l_returnflag, l_linestatus, count(*) as n, max(l_shipdate) as last_time from lineitem group by 1, 2")
def s20(t):
    out = place(t, "s20")
    S.write_table(t.lineitem.select("l_orderkey", "l_shipdate", "l_linestatus", "l_returnflag"), out, ["l_returnflag"], ["l_shipdate"])
    d = S.read_table(t.spark, out, "l_orderkey BIGINT, l_shipdate TIMESTAMP, l_linestatus STRING, l_returnflag STRING")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_time"))
