"""Packet-flow statistics over packets derived from events.

A capture is an event type, a flow a tenth of the users; thirty days are folded
into five minutes. Sequence numbers run with the event ids, with some early,
repeated and far-off ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.registry import query
from tidewire.operators import flows as R
from tidewire.operators.blocked import Order, scan

CFG = R.FlowConfig(media_ports=((20000, 20009),), expected_dscp=46, server_ips=("10.9.0.1",), badge_cidrs=("10.0.0.0/24",), max_gap_ms=60000.0)
KEY = ["capture_id", "src_ip", "dst_ip", "ssrc", "pt"]


def packets(t):
    c = F.col
    u = c("user_id") % 10
    arrival = F.unix_micros("ts") / F.lit(8640e6)
    n = F.floor(c("event_id") / 25)
    seq = (n + 65000 - F.when(c("value") > 60, 5).otherwise(0) + F.when(c("value").between(45, 47), 20000).otherwise(0)) % 65536
    rtp = F.struct(F.when(u % 3 == 0, 0).when(u % 3 == 1, 8).otherwise(111).alias("pt"), F.lit(0).alias("marker"), seq.cast("int").alias("seq"),
                   F.floor(arrival * 8000 + c("value") * 10).cast("bigint").alias("ts"), (u + 1000).alias("ssrc"))
    return t.events.select(
        c("event_id").alias("pkt_no"), c("event_type").alias("capture_id"), arrival.alias("arrival"), F.concat(F.lit("10.0.0."), u.cast("string")).alias("src_ip"),
        (u + 20000).cast("int").alias("src_port"), F.concat(F.lit("10.9.0."), (u % 2).cast("string")).alias("dst_ip"), F.lit(30000).alias("dst_port"),
        F.when(c("value") < 20, 0).otherwise(46).alias("dscp"), (F.floor(c("value")) + 20).alias("udp_length"), F.when(c("value") >= 5, rtp).alias("rtp"))


PKT = """
with p as (select event_id as pkt_no, event_type as capture_id, epoch_us(ts) / 8640e6::double as arrival, '10.0.0.' || (user_id % 10) as src_ip, (user_id % 10 + 20000)::int as src_port, '10.9.0.' || (user_id % 10 % 2) as dst_ip,
  (case when value < 20 then 0 else 46 end)::int as dscp, floor(value)::bigint + 20 as udp_length, value >= 5 as has_rtp, case when value >= 5 then user_id % 10 + 1000 end as ssrc,
  (case when value >= 5 then case user_id % 10 % 3 when 0 then 0 when 1 then 8 else 111 end end)::int as pt,
  case when value >= 5 then (event_id // 25 + 65000 - case when value > 60 then 5 else 0 end + case when value between 45 and 47 then 20000 else 0 end) % 65536 end as seq,
  case when value >= 5 then floor(epoch_us(ts) / 8640e6::double * 8000 + value * 10)::bigint end as rtp_ts from events),
c as (select *, row_number() over w as rn, lag(arrival) over w as pa, lag(rtp_ts) over w as pts from p where has_rtp window w as (partition by capture_id, src_ip, dst_ip, ssrc, pt order by arrival, pkt_no))
"""


def routed(t):
    return R.split_flows(packets(t), CFG)


def candidates(t):
    return routed(t).filter(F.col("rtp").isNotNull())


@query("r01_split_flows", PKT + "select capture_id, src_ip, dst_ip, ssrc, pt, count(*) as n from p group by all")
def r01(t):
    return routed(t).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


@query("r02_rtp_candidates", PKT + "select capture_id, src_ip, dst_ip, count(*) as candidate_packets from c group by 1, 2, 3")
def r02(t):
    return R.rtp_candidates(packets(t)).select("capture_id", "src_ip", "dst_ip", "candidate_packets")


RECURSE = PKT.replace("with p as", "with recursive p as", 1) + """
, step as (
  select capture_id, src_ip, rn, seq, seq as highest, null::bigint as bad, seq as first, [seq] as seen, 0::bigint as lost, 0 as cls from c where rn = 1
  union all
  select q.capture_id, q.src_ip, q.rn, q.seq,
    case when dup then s.highest when diff > 0 and diff <= 3000 then cand when diff >= -100 and diff < 0 then s.highest when q.seq = s.bad then q.seq else s.highest end,
    case when dup then s.bad when (diff > 0 and diff <= 3000) or (diff >= -100 and diff < 0) or q.seq = s.bad then null else (q.seq + 1) % 65536 end,
    case when not dup and not (diff > 0 and diff <= 3000) and not (diff >= -100 and diff < 0) and q.seq = s.bad then q.seq else s.first end,
    case when dup then s.seen when (diff > 0 and diff <= 3000) or (diff >= -100 and diff < 0) then list_append(s.seen, cand) when q.seq = s.bad then [q.seq] else s.seen end,
    case when dup then 0 when diff > 0 and diff <= 3000 then diff - 1 when diff >= -100 and diff < 0 then case when cand > s.first then -1 else 0 end else 0 end,
    case when dup then 2 when diff > 0 and diff <= 3000 then 1 when diff >= -100 and diff < 0 then 3 when q.seq = s.bad then 4 else 5 end
  from step s, lateral (select c.*, case when x - s.highest < -32768 then x + 65536 when x - s.highest > 32768 then x - 65536 else x end as cand from (select c.*, (s.highest // 65536) * 65536 + c.seq as x from c
    where c.capture_id = s.capture_id and c.src_ip = s.src_ip and c.rn = s.rn + 1) c) q, lateral (select q.cand - s.highest as diff, list_contains(s.seen, q.cand) as dup) z)
"""


@query("r04_sequence_stats", RECURSE + """
select capture_id, src_ip, count(*) as packets, sum(lost)::bigint as lost_packets, count(*) filter (where cls = 2) as duplicate_packets, count(*) filter (where cls = 3) as out_of_order_packets, count(*) filter (where cls = 4) as restarts,
  (count(*) filter (where cls in (0, 1, 3, 4)) + sum(lost))::bigint as expected_packets from step group by 1, 2""")
def r04(t):
    s = R.sequence_stats(R.sequence_scan(candidates(t)))
    return s.select("capture_id", "src_ip", "packets", "lost_packets", "duplicate_packets", "out_of_order_packets", "restarts", "expected_packets")


@query("r03_extended_sequence", RECURSE + """
select capture_id, src_ip, rn as packet_index, cls as seq_class, lost as lost_change from step""")
def r03(t):
    d = scan(R.sequence_scan(candidates(t)), R.CANDIDATE, Order("arrival", ("pkt_no",)), number="packet_index")
    return d.select("capture_id", "src_ip", "packet_index", "seq_class", "lost_change")


@query("r04_gap_counts", PKT + """
, f as (select *, seq - lag(seq) over (partition by capture_id, src_ip order by arrival, pkt_no) as d from c)
select capture_id, src_ip, count(*) filter (where d = 0) as repeats, count(*) filter (where d > 1) as jumps, count(*) filter (where d < 0) as steps_back from f group by 1, 2""")
def r04b(t):
    from tidewire.operators.aggregates import count_where
    d = scan(candidates(t), R.CANDIDATE, R.ORDER, lag={"_p": "seq"}).withColumn("d", F.col("seq") - F.col("_p"))
    return d.groupBy("capture_id", "src_ip").agg(count_where(F.col("d") == 0).alias("repeats"), count_where(F.col("d") > 1).alias("jumps"), count_where(F.col("d") < 0).alias("steps_back"))


JIT = PKT + """
, dl as (select *, (arrival - rtp_ts / 8000.0::double) - (pa - pts / 8000.0::double) as d from c),
kp as (select *, count(*) over (partition by capture_id, src_ip) - row_number() over (partition by capture_id, src_ip order by arrival, pkt_no) as after from dl where abs(d) <= 1),
jt as (select capture_id, src_ip, sum(abs(d) / 16 * pow(15.0::double / 16, after)) * 1000 as j from kp group by 1, 2)
"""


@query("r05_jitter", JIT + "select k.capture_id, k.src_ip, round(coalesce(j, 0), 6) as jitter_ms from (select distinct capture_id, src_ip from c) k left join jt on jt.capture_id = k.capture_id and jt.src_ip = k.src_ip")
def r05(t):
    d = R.jitter_ms(R.with_deltas(candidates(t), R.CANDIDATE, CFG), R.CANDIDATE, CFG)
    return d.select("capture_id", "src_ip", F.round("jitter_ms", 6).alias("jitter_ms"))


@query("r06_clock_rate", PKT + "select pt, 8000 as clock_hz, pt <> 111 as known, count(*) as n from c group by pt")
def r06(t):
    hz, known = R.clock_rate(F.col("pt"), CFG)
    return candidates(t).groupBy("pt", hz.alias("clock_hz"), known.alias("known")).agg(F.count(F.lit(1)).alias("n"))


GAPS = """
, g as (select capture_id, src_ip, (arrival - pa) * 1000 as gap from c where arrival >= pa),
gr as (select *, row_number() over (partition by capture_id, src_ip order by gap) as rn, count(*) over (partition by capture_id, src_ip) as n from g),
gs as (select capture_id, src_ip, max(gap) filter (where rn = greatest(1, ceil(n * 0.5::double))) as p50, max(gap) filter (where rn = greatest(1, ceil(n * 0.95::double))) as p95, max(gap) as mx from gr group by 1, 2)
"""


@query("r07_gap_stats", PKT + GAPS + "select capture_id, src_ip, round(p50, 6) as interarrival_p50_ms, round(p95, 6) as interarrival_p95_ms, round(mx, 6) as interarrival_max_ms from gs")
def r07(t):
    d = R.gap_stats(candidates(t), R.CANDIDATE)
    return d.select("capture_id", "src_ip", *[F.round(c, 6).alias(c) for c in ("interarrival_p50_ms", "interarrival_p95_ms", "interarrival_max_ms")])


@query("r08_ts_delta", PKT + "select pkt_no, case when rtp_ts - pts < -2147483648 then rtp_ts - pts + 4294967296 when rtp_ts - pts > 2147483648 then rtp_ts - pts - 4294967296 else rtp_ts - pts end as rtp_delta from c")
def r08(t):
    return R.with_deltas(candidates(t), R.CANDIDATE, CFG).select("pkt_no", "rtp_delta")


PLAUS = RECURSE + """
, fw as (
  select capture_id, src_ip, rn, seq as h, false as ok from c where rn = 1
  union all
  select c.capture_id, c.src_ip, c.rn, case when x - f.h > 0 and x - f.h <= 3000 then x else f.h end, x - f.h > 0 and x - f.h <= 3000
  from fw f join c on c.capture_id = f.capture_id and c.src_ip = f.src_ip and c.rn = f.rn + 1, lateral (select (f.h // 65536) * 65536 + c.seq as y), lateral (select case when y - f.h < -32768 then y + 65536 when y - f.h > 32768 then y - 65536 else y end as x))
""" + JIT[len(PKT):] + GAPS + """
, sq as (select capture_id, src_ip, sum(lost) as lost, count(*) filter (where cls = 2) as dup, count(*) filter (where cls = 3) as ooo, count(*) filter (where cls in (0, 1, 3, 4)) + sum(lost) as expected from step group by 1, 2),
pr as (select c.*, fw.ok and rtp_ts > pts as moved, fw.ok from c join fw on fw.capture_id = c.capture_id and fw.src_ip = c.src_ip and fw.rn = c.rn),
er as (select capture_id, src_ip, abs((arrival - pa) - (rtp_ts - pts) / 8000.0::double) * 1000 as err, (rtp_ts - pts) / 8000.0::double * 1000 as step from pr where moved),
ek as (select *, row_number() over (partition by capture_id, src_ip order by err) as e1, row_number() over (partition by capture_id, src_ip order by step) as e2, count(*) over (partition by capture_id, src_ip) as n from er),
es as (select capture_id, src_ip, max(err) filter (where e1 = ceil(n * 0.95::double)) as err95, max(step) filter (where e2 = ceil(n * 0.5::double)) as step50 from ek group by 1, 2),
bs as (select capture_id, src_ip, count(*) as n, max(arrival) - min(arrival) as dur, count(*) filter (where ok) as fwd, count(*) filter (where moved) as tf, min(pt) as pt from pr group by 1, 2),
al as (select bs.*, sq.*, es.*, gs.*, coalesce(jt.j, 0) as j, bs.capture_id as cap, bs.src_ip as ip, bs.n as cnt from bs join sq on sq.capture_id = bs.capture_id and sq.src_ip = bs.src_ip left join es on es.capture_id = bs.capture_id and es.src_ip = bs.src_ip
   left join gs on gs.capture_id = bs.capture_id and gs.src_ip = bs.src_ip left join jt on jt.capture_id = bs.capture_id and jt.src_ip = bs.src_ip),
ju as (select cap as capture_id, ip as src_ip, cnt as packet_count, lost, expected, dup, ooo, fwd, tf, j, err95, step50, list_sort(list_filter([case when cnt < 20 then 'too_few_packets' end, case when dur <= 0 or dur < 0.25 then 'duration_too_short' end,
   case when coalesce(fwd / nullif(cnt - 1, 0)::double, 0) < 0.8 then 'sequence_not_progressing' end, case when coalesce(tf / nullif(fwd, 0)::double, 0) < 0.8 then 'timestamp_not_progressing' end, case when err95 > 250 then 'timestamp_wallclock_mismatch' end,
   case when step50 < 5 or step50 > 100 then 'packetization_implausible' end, case when p95 > 60000 then 'interarrival_gap_too_large' end, case when lost / expected::double > 0.5 then 'loss_ratio_implausible' end,
   case when dup / cnt::double > 0.5 then 'duplicate_ratio_implausible' end, case when ooo / cnt::double > 0.5 then 'out_of_order_ratio_implausible' end, case when j > 500 then 'jitter_implausible' end], lambda x: x is not null)) as rs from al)
"""


@query("r09_plausibility", PLAUS + """
select capture_id, src_ip, packet_count, round(coalesce(fwd / nullif(packet_count - 1, 0)::double, 0), 6) as sequence_progress, round(coalesce(tf / nullif(fwd, 0)::double, 0), 6) as timestamp_progress, round(err95, 5) as wallclock_error_ms,
  round(step50, 5) as packetization_ms, array_to_string(rs, ';') as reasons, len(rs) = 0 as plausible from ju""")
def r09(t):
    d = R.plausibility(candidates(t), CFG)
    return d.select("capture_id", "src_ip", "packet_count", F.round("sequence_progress", 6).alias("sequence_progress"), F.round("timestamp_progress", 6).alias("timestamp_progress"),
                    F.round("wallclock_error_ms", 5).alias("wallclock_error_ms"), F.round("packetization_ms", 5).alias("packetization_ms"), F.array_join("reasons", ";").alias("reasons"), "plausible")


@query("r10_stream_stats", PKT + """
, k as (select capture_id, src_ip, dst_ip, ssrc, dscp, count(*) as n, min((arrival, pkt_no)) as f from c group by all),
m as (select capture_id, src_ip, arg_min(dscp, (-n, f)) as dscp from k group by 1, 2)
select c.capture_id, c.src_ip, count(*) as packet_count, sum(udp_length)::bigint as byte_count, m.dscp, round(count(*) / nullif(max(arrival) - min(arrival), 0), 6) as packet_rate_pps, m.dscp <> 46 as dscp_mismatch,
  'badge_to_' || case when c.dst_ip = '10.9.0.1' then 'server' else 'unknown' end as direction from c join m on m.capture_id = c.capture_id and m.src_ip = c.src_ip group by c.capture_id, c.src_ip, c.dst_ip, m.dscp""")
def r10(t):
    d = R.stream_stats(candidates(t), R.CANDIDATE, CFG)
    return d.select("capture_id", "src_ip", "packet_count", "byte_count", "dscp", F.round("packet_rate_pps", 6).alias("packet_rate_pps"), "dscp_mismatch", "direction")


@query("r11_classify_streams", PLAUS + """
select capture_id, src_ip, case when len(rs) = 0 then 'rtp' else 'rtp_candidate_rejected' end as measurement_mode, packet_count, case when len(rs) = 0 then lost::bigint end as lost_packets, array_to_string(rs, ';') as reasons from ju
union all select capture_id, src_ip, case when count(*) > 1 then 'udp_interarrival_only' else 'unknown_udp' end, count(*), null, '' from p where not has_rtp group by 1, 2""")
def r11(t):
    d = R.classify_streams(packets(t), CFG)
    return d.select("capture_id", "src_ip", "measurement_mode", "packet_count", "lost_packets", F.array_join("rejection_reasons", ";").alias("reasons"))


@query("r12_debug_packets", PKT + """
select capture_id, src_ip, rn as packet_index, seq::int as seq, rtp_ts, round((arrival - pa) * 1000, 4) as arrival_delta_ms, round((rtp_ts - pts) / 8000.0::double * 1000, 4) as rtp_delta_ms from c where rn <= 20""")
def r12(t):
    d = R.debug_packets(candidates(t), R.CANDIDATE, CFG)
    return d.select("capture_id", "src_ip", "packet_index", "seq", "rtp_ts", F.round("arrival_delta_ms", 4).alias("arrival_delta_ms"), F.round("rtp_delta_ms", 4).alias("rtp_delta_ms"))


@query("r13_capture_summary", PKT + """
, lim as (select epoch_us(timestamp '1970-01-03 06:44:00') / 1e6::double + 300 as x),
r as (select event_type as capture_id, count(*) as packets_read from events group by 1)
select r.capture_id, packets_read, count(*) filter (where (arrival * 1e6)::bigint <= 197340000000) as udp_packets_seen, count(*) filter (where not ((arrival * 1e6)::bigint <= 197340000000)) as future_packets,
  count(*) filter (where (arrival * 1e6)::bigint <= 197340000000) > 0 as success from r join p on p.capture_id = r.capture_id group by 1, 2""")
def r13(t):
    p = packets(t)
    # two days, six hours and 44 minutes after the epoch, five minutes of skew: 197340 s
    at = F.timestamp_micros(F.lit(197040_000_000).cast("bigint"))
    reads = p.groupBy("capture_id").agg(F.count(F.lit(1)).alias("packets_read"))
    return R.capture_summary(p, reads, at).select("capture_id", "packets_read", "udp_packets_seen", "future_packets", "success")


@query("r14_device_labels", PKT + """
, d as (select '10.0.0.' || s_suppkey as ip, s_name as name from supplier union all select '10.9.0.' || n_nationkey, n_name from nation),
s as (select distinct capture_id, src_ip, dst_ip from p)
select capture_id, src_ip, coalesce(a.name, b.name, 'unmapped') as device_name, case when a.name is not null and b.name is not null then b.name else 'unmapped' end as peer_device_name
from s left join d a on a.ip = s.src_ip left join d b on b.ip = s.dst_ip""")
def r14(t):
    part = lambda ip, name: [ip.alias("ip"), name.alias("name"), F.lit("test").alias("role"), F.lit("cfg").alias("config")]
    d = t.supplier.select(*part(F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")), F.col("s_name"))).unionByName(
        t.nation.select(*part(F.concat(F.lit("10.9.0."), F.col("n_nationkey").cast("string")), F.col("n_name"))))
    s = packets(t).select("capture_id", "src_ip", "dst_ip").distinct()
    return R.device_labels(s, d).select("capture_id", "src_ip", "device_name", "peer_device_name")


@query("r15_observation_rows", """
with i as (select l_orderkey as a, l_partkey as s, l_suppkey, l_shipdate, l_quantity, unnest([0, 1]) as ix from lineitem)
select substr(sha256(a || '|' || s || '|' || ix || '|' || case ix when 0 then 'wlc_cli' else 'ap' end || '|' || case ix when 0 then '230.230.0.' || (l_suppkey % 40) else '' end || '|' || l_suppkey || '|' || ''), 1, 24) as observation_id,
  a as attempt_id, ix::int as item_index, case ix when 0 then 'after' else 'during' end as phase, case ix when 0 then '10.1.1.1' else '10.2.2.2' end as receiver_ip, l_quantity as q from i""")
def r15(t):
    c = F.col
    item = lambda src, grp, phase, ip: F.struct(F.lit(src).alias("evidence_source"), grp.alias("group_ip"), c("l_suppkey").alias("mgid"), F.lit(None).cast("string").alias("receiver_mac"),
                                                F.lit(phase).alias("phase"), F.lit(ip).alias("receiver_ip"))
    grp = F.concat(F.lit("230.230.0."), (c("l_suppkey") % 40).cast("string"))
    d = t.lineitem.select(c("l_orderkey").alias("attempt_id"), c("l_partkey").alias("snapshot_id"), c("l_quantity").alias("observed_at"), F.lit("during").alias("phase"), F.lit("10.1.1.1").alias("receiver_ip"),
                          F.array(item("wlc_cli", grp, "after", ""), item("ap", F.lit(None).cast("string"), None, "10.2.2.2")).alias("items"))
    return R.observation_rows(d, "items").select("observation_id", "attempt_id", "item_index", "phase", "receiver_ip", c("observed_at").alias("q"))
