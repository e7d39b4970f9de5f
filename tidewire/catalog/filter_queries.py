"""Filters and classification rules over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.registry import query
from tidewire.functions import predicates as P
from tidewire.functions.scalars import in_pool, json_value
from tidewire.operators.aggregates import count_where
from tidewire.operators import timeseries as T

NOW = "2024-01-25 00:00:00"


def samples(t):
    """Events as metric samples with one label."""
    return t.events.select(F.col("event_type").alias("metric"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
                           "ts", "value", "event_id")


def now():
    return F.lit(NOW).cast("timestamp")


@query("p01_select_series", """
select event_id, user_id::varchar as usr, value from events
where event_type = 'view' and user_id::varchar <> '7' and regexp_full_match(user_id::varchar, '1.*|2\\d') and not regexp_full_match(user_id::varchar, '1\\d\\d')""")
def p01(t):
    m = [("user", "!=", "7"), ("user", "=~", "1.*|2\\d"), ("user", "!~", "1\\d\\d")]
    return T.select_series(samples(t), "view", m).select("event_id", T.label("user").alias("usr"), "value")


@query("p02_compare_filter", "select event_id, value from events where value > 10 and value < 45")
def p02(t):
    return P.compare_filter(P.compare_filter(samples(t), ">", 10), "<", 45).select("event_id", "value")


@query("p03_compare_bool", "select event_id, case when value >= 20 then 1.0 else 0.0 end::double as value from events")
def p03(t):
    return P.compare_bool(samples(t), ">=", 20).select("event_id", "value")


@query("p04_soft_delete", ctes("captures", "studies") + """
select capture_id, c.study_id from captures c join studies s on s.study_id = c.study_id where c.deleted_at is null and s.deleted_at is null""")
def p04(t):
    s = P.not_deleted(frame(t, "studies")).select("study_id")
    return P.not_deleted(frame(t, "captures")).join(s, "study_id").select("capture_id", "study_id")


@query("p05_trusted_gate", ctes("streams") + """
select device_role, count(*) as n, count(*) filter (where measurement_mode = 'rtp' and packet_count >= 20) as trusted from streams group by 1""")
def p05(t):
    return frame(t, "streams").groupBy("device_role").agg(
        F.count(F.lit(1)).alias("n"), count_where(P.trusted(F.col("measurement_mode"), F.col("packet_count"))).alias("trusted"))


@query("p06_future_gate", f"""
select user_id, count(*) filter (where ts <= timestamp '{NOW}' + interval 5 minute) as kept, count(*) filter (where ts > timestamp '{NOW}' + interval 5 minute) as future,
  count(*) = count(*) filter (where ts > timestamp '{NOW}' + interval 5 minute) as failed from events group by 1""")
def p06(t):
    late = P.is_future(F.col("ts"), now())
    g = t.events.groupBy("user_id").agg(count_where(~late).alias("kept"), count_where(late).alias("future"))
    return g.withColumn("failed", F.col("kept") == 0)


@query("p07_effective_device", ctes("streams") + """
select stream_id, packet_count, case when device_role <> 'unmapped' then device_role else coalesce(case when server_key % 2 = 0 then 'test' end, device_role) end as role,
  case when device_role <> 'unmapped' then device_name else coalesce(case when server_key % 2 = 0 then 'spare' end, device_name) end as name from streams""")
def p07(t):
    even = F.col("server_key") % 2 == 0
    role = F.col("device_role")
    return frame(t, "streams").select(
        "stream_id", "packet_count", P.effective(role, role, F.when(even, "test")).alias("role"),
        P.effective(role, F.col("device_name"), F.when(even, "spare")).alias("name"))


@query("p08_classify_phase", """
select conv_id, turn, case when regexp_matches(text, '(?i)thank') then 'thanks' when regexp_matches(text, '(?i)que|der') then 'words' when role = 'x' then 'never' else 'unassigned' end as phase from conversations""")
def p08(t):
    rules = [("(?i)thank", "thanks"), ("(?i)que|der", "words")]
    return t.conversations.select("conv_id", "turn", P.classify_phase(F.col("text"), rules).alias("phase"))


@query("p08_transcript_phase", """
with c as (select o_orderkey, o_orderstatus, o_orderpriority, case when o_orderstatus = 'F' then 'show wireless  multicast group summary' || chr(10) ||
    case when o_orderpriority < '3' then 'mobility history' || chr(10) || 'show monitor capture X buffer brief' else 'show ap multicast mom' end
  when o_orderstatus = 'O' then 'show wireless multicast group ' || case when o_orderpriority < '3' then '239.1.1.1' else 'vlan 5' end
  when o_orderpriority < '3' then 'Monitor Capture X start' else 'no ip access-list extended Y' end as text from orders)
select o_orderkey, case when o_orderstatus = 'F' then case when o_orderpriority < '3' then 'post_failure' else 'baseline' end
   when o_orderstatus = 'O' then 'resolved_group' when o_orderpriority < '3' then 'capture_start' else 'cleanup' end as phase from c""")
def p08b(t):
    high = F.col("o_orderpriority") < "3"
    nl = F.lit("\n")
    text = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("show wireless  multicast group summary\n"), F.when(high, F.concat(
        F.lit("mobility history"), nl, F.lit("show monitor capture X buffer brief"))).otherwise("show ap multicast mom")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("show wireless multicast group "), F.when(high, "239.1.1.1").otherwise("vlan 5")))
        .when(high, "Monitor Capture X start").otherwise("no ip access-list extended Y"))
    return t.orders.select("o_orderkey", P.classify_phase(text, P.PHASE_RULES).alias("phase"))


@query("p09_match_quality", """
select event_id, case when abs(value - 10) > 30 then null when abs(value - 10) <= 1 then 'exact_1s' when abs(value - 10) <= 5 then 'close_5s' else 'within_window' end as quality from events""")
def p09(t):
    return t.events.select("event_id", P.match_quality(F.col("value") - 10, F.lit(30)).alias("quality"))


def severity_cols():
    c = F.col
    return P.stream_severity(c("loss_ratio"), c("jitter_ms"), c("interarrival_p95_ms"), c("dscp_mismatch"), c("measurement_mode"),
                             c("packet_count"), c("review_status"), c("stream_classification"))


SEVERITY_SQL = """
, sev as (select *, lower(coalesce(review_status, 'unreviewed')) = 'excluded' or lower(coalesce(stream_classification, '')) in ('exclude', 'noise', 'control') as muted,
  list_filter([case when loss_ratio >= 0.05 then 'Loss critical' end, case when jitter_ms >= 20 then 'Jitter critical' end,
    case when interarrival_p95_ms >= 40 then 'Timing critical' end], lambda x: x is not null) as crit,
  list_filter([case when loss_ratio >= 0.01 and loss_ratio < 0.05 then 'Loss warning' end, case when jitter_ms >= 10 and jitter_ms < 20 then 'Jitter warning' end,
    case when interarrival_p95_ms >= 25 and interarrival_p95_ms < 40 then 'Timing warning' end,
    case when dscp_mismatch then case when measurement_mode = 'rtp' then 'Trusted RTP DSCP mismatch' else 'Non-RTP DSCP mismatch' end end], lambda x: x is not null) as warn
 from streams),
lev as (select *, case when muted then 'muted' when len(crit) > 0 then 'critical' when len(warn) > 0 then 'warning'
   when measurement_mode = 'rtp' and packet_count >= 20 then 'good' else 'info' end as severity,
  case when muted then 'Excluded/noise/control' when len(crit) > 0 then array_to_string(crit, ';') when len(warn) > 0 then array_to_string(warn, ';')
   when measurement_mode = 'rtp' and packet_count >= 20 then 'RTP QoE stream' when measurement_mode <> 'rtp' then 'Non-RTP/unknown' else 'Needs classification' end as reasons
 from sev)
"""


@query("p10_stream_severity", ctes("streams") + SEVERITY_SQL + "select stream_id, packet_count, severity, reasons from lev")
def p10(t):
    s = severity_cols()
    return frame(t, "streams").select("stream_id", "packet_count", s["severity"].alias("severity"), F.array_join(s["reasons"], ";").alias("reasons"))


@query("p11_capture_usefulness", ctes("captures") + """
, f as (select *, source_size_bytes % 7 / 100.0 as loss, source_size_bytes % 35 as jit, source_size_bytes % 40 as gap, source_size_bytes % 3 as tn, source_size_bytes % 5 as mm from captures),
b as (select *, capture_status = 'complete' and coalesce(parse_success, false) as done,
  case when loss >= 0.03 then 'high_loss' when loss > 0 then 'loss_detected' end as b1,
  case when jit >= 20 then 'high_jitter' when jit >= 10 then 'jitter_review' end as b2,
  case when gap >= 30 then 'high_interarrival' when gap >= 25 then 'interarrival_review' end as b3,
  case when mm = 1 then 'trusted_rtp_dscp_mismatch_found' when mm = 2 then 'only_non_rtp_dscp_mismatch_found' when mm > 2 then 'dscp_mismatch_present' end as b4 from f)
select capture_id, case when done then concat_ws(';', b1, b2, b3, b4) else '' end as concerns,
  case when capture_status = 'failed' or not coalesce(parse_success, true) or coalesce(parse_exit_code, 0) <> 0 then 'parse_failed'
    when not done then 'not_parsed' when tn = 0 then 'no_usable_rtp' when coalesce(b1, b2, b3, b4) is not null then 'needs_review' else 'useful_rtp' end as usefulness from b""")
def p11(t):
    n = F.col("source_size_bytes")
    c = frame(t, "captures")
    done = (F.col("capture_status") == "complete") & F.coalesce(F.col("parse_success"), F.lit(False))
    mm = n % 5
    concerns = P.capture_concerns(done, n % 7 / 100.0, F.lit(None), n % 35, n % 40, (mm == 1).cast("int"), (mm == 2).cast("int"), mm)
    use = P.capture_usefulness(F.col("capture_status"), F.col("parse_success"), F.col("parse_exit_code"), n % 3, concerns)
    return c.select("capture_id", F.array_join(concerns, ";").alias("concerns"), use.alias("usefulness"))


@query("p12_filter_streams", ctes("streams") + """
select stream_id, packet_count from streams where coalesce(review_status, 'unreviewed') = 'unreviewed' and jitter_ms >= 10
 and (src_ip like '%0.5%' or dst_ip like '%0.5%' or src_port::varchar like '%0.5%' or dst_port::varchar like '%0.5%' or ssrc::varchar like '%0.5%' or stream_id like '%0.5%')""")
def p12(t):
    return P.filter_streams(frame(t, "streams"), text=" 0.5", review="unreviewed", flag="jitter_warning").select("stream_id", "packet_count")


@query("p12_filter_captures", ctes("captures") + """
select capture_id from captures where capture_status = 'complete' and parse_success is true and (lower(source_name) like '%99%' or capture_id::varchar like '%99%' or lower(source_path) like '%99%')""")
def p12b(t):
    return P.filter_captures(frame(t, "captures"), text="99", status="complete", parse_state="success").select("capture_id")


@query("p13_rf_filter", """
select s_suppkey from supplier where regexp_matches('site' || (s_nationkey % 5), 'site[0-2]') and regexp_matches(s_name, '[1-6]$') and s_nationkey >= 3""")
def p13(t):
    d = t.supplier.select("s_suppkey", F.concat(F.lit("site"), (F.col("s_nationkey") % 5).cast("string")).alias("site_tag"), F.col("s_name").alias("ap_name"),
                          F.lit("5GHz").alias("band"), F.col("s_nationkey").alias("neighbor_count"))
    return P.rf_filter(d, site_regex="site[0-2]", ap_regex="[1-6]$", band="5ghz", min_neighbors=3).select("s_suppkey")


@query("p13_client_filter", "select p_partkey from part where p_brand = 'Brand#3' and p_type = 'SMALL'")
def p13b(t):
    d = t.part.select("p_partkey", F.col("p_brand").alias("device_group"), F.col("p_type").alias("ssid"))
    return P.client_filter(d, device_group="Brand#3", ssid="SMALL", wlc=None).select("p_partkey")


@query("p14_review_flags", ctes("streams") + """
select count(*) filter (where accepted is true) as accepted, count(*) filter (where accepted is false or review_status = 'excluded') as excluded, count(*) as n from streams""")
def p14(t):
    f = P.accepted_flags(F.col("accepted"), F.col("review_status"))
    return frame(t, "streams").agg(count_where(f["is_accepted"]).alias("accepted"), count_where(f["is_excluded"]).alias("excluded"), F.count(F.lit(1)).alias("n"))


@query("p16_visibility", """
with p as (select l_suppkey, l_orderkey, case l_linenumber when 1 then 5246 when 2 then 5247 else 20000 end as port, l_returnflag = 'A' and l_linenumber >= 6 and l_suppkey % 3 = 0 as pool,
  l_linenumber = 5 and l_suppkey % 2 = 0 as mc, l_tax = 0.08 and l_suppkey % 4 = 0 as rtp from lineitem),
g as (select l_orderkey as capture_id, count(*) as n, count(*) filter (where port = 5246) as ctl, count(*) filter (where port = 5247) as dat, count(*) filter (where pool) as pl,
  count(*) filter (where mc or pool) as m, count(*) filter (where rtp) as r from p group by 1)
select capture_id, case when n <= 0 then 'empty_or_unusable' when r > 0 and pl > 0 then 'inner_voice_visible' when pl > 0 or m > 0 then 'inner_multicast_visible'
  when dat > 0 then 'outer_capwap_only' else 'control_plane_only' end as visibility from g""")
def p16(t):
    c = F.col
    pool = (c("l_returnflag") == "A") & (c("l_linenumber") >= 6) & (c("l_suppkey") % 3 == 0)
    mc = (c("l_linenumber") == 5) & (c("l_suppkey") % 2 == 0)
    dst = F.when(pool, "230.230.1.9").when(mc, "239.1.1.1").otherwise("10.0.0.9")
    port = F.when(c("l_linenumber") == 1, 5246).when(c("l_linenumber") == 2, 5247).otherwise(20000)
    p = t.lineitem.select(c("l_orderkey").alias("capture_id"), dst.alias("dst"), port.alias("port"), ((c("l_tax") == 0.08) & (c("l_suppkey") % 4 == 0)).alias("rtp"))
    g = p.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n"), count_where(c("port") == 5246).alias("ctl"), count_where(c("port") == 5247).alias("dat"),
        count_where(in_pool(c("dst"), "230.230.0.0/20")).alias("pl"), count_where(in_pool(c("dst"), "224.0.0.0/4")).alias("m"), count_where(c("rtp")).alias("r"))
    return g.select("capture_id", P.visibility_class(c("n"), c("n"), c("r"), c("pl"), c("m"), c("dat"), c("ctl")).alias("visibility"))


@query("p17_attempt_verdict", """
with a as (select o_orderkey, case o_orderpriority when '1-URGENT' then 'heard' when '2-HIGH' then 'missed' when '3-MEDIUM' then 'missed' when '4-NOT SPECIFIED' then 'choppy' else 'unknown' end as outcome,
   o_custkey % 3 > 0 as grp, case o_orderstatus when 'F' then true when 'O' then false end as member, o_custkey % 2 = 0 as cap from orders)
select o_orderkey, case when outcome = 'heard' then 'baseline_success' when outcome = 'missed' and grp and member is false then 'membership_failure'
   when outcome = 'missed' and not grp then 'inconclusive' when outcome = 'choppy' and cap then 'media_degraded' else 'inconclusive' end as verdict,
  case when outcome = 'heard' then 'medium' when outcome = 'missed' and grp and member is false then 'high' when outcome = 'missed' and not grp then 'low'
   when outcome = 'missed' and member is true and cap then 'medium' else 'low' end as verdict_confidence,
  concat_ws(';', case when member is false then 'membership_missing' when member is true then 'membership_present' end, case when cap then 'capture_container_valid' end) as findings from a""")
def p17(t):
    c = F.col
    outcome = (F.when(c("o_orderpriority") == "1-URGENT", "heard").when(c("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "missed")
               .when(c("o_orderpriority") == "4-NOT SPECIFIED", "choppy").otherwise("unknown"))
    member = F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False)
    cap = c("o_custkey") % 2 == 0
    v = P.attempt_verdict(outcome, c("o_custkey") % 3 > 0, member, cap)
    names = F.transform(P.attempt_findings(member, cap), lambda f: f["finding_type"])
    return t.orders.select("o_orderkey", *[x.alias(k) for k, x in v.items()], F.array_join(names, ";").alias("findings"))


@query("p17_attempt_findings", """
with a as (select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as member, o_custkey % 2 = 0 as cap from orders)
select o_orderkey, case when member then 'membership_present' else 'membership_missing' end as finding_type, case when member then 'info' else 'critical' end as severity,
  case when member then 'medium' else 'high' end as confidence from a where member is not null
union all select o_orderkey, 'capture_container_valid', 'info', 'low' from a where cap""")
def p17b(t):
    c = F.col
    member = F.when(c("o_orderstatus") == "F", True).when(c("o_orderstatus") == "O", False)
    return t.orders.select("o_orderkey", F.explode(P.attempt_findings(member, c("o_custkey") % 2 == 0)).alias("f")).select("o_orderkey", "f.*")


@query("p17_outcome_verdict", """
select event_id, case event_type when 'click' then 'baseline_success' when 'error' then 'alert_only_failure' else 'inconclusive' end as verdict,
  case when event_type in ('click', 'error') then 'medium' else 'low' end as verdict_confidence from events""")
def p17c(t):
    kind = F.when(F.col("event_type") == "click", "heard").when(F.col("event_type") == "error", "alert_only").otherwise("missed")
    return t.events.select("event_id", *[x.alias(k) for k, x in P.outcome_verdict(kind).items()])


@query("p18_vlan_state", """
with v as (select p_partkey, case when p_size % 3 > 0 then 100 + p_size % 4 end as conf, case when p_size % 5 > 1 then 100 + p_size % 2 end as res, case when p_size % 7 > 0 then 'g' end as ip from part)
select p_partkey, case when ip is not null and res is not null and conf is not null and conf <> res then 'configured_group_mismatch' when ip is not null and res is not null then 'resolved_confirmed'
  when conf is not null then 'configured_only' else 'unresolved' end as state from v""")
def p18(t):
    n = F.col("p_size")
    return t.part.select("p_partkey", P.vlan_context_state(F.when(n % 3 > 0, n % 4 + 100), F.when(n % 5 > 1, n % 2 + 100), F.when(n % 7 > 0, "g")).alias("state"))


@query("p19_relabel_keep", "select event_id, event_type as metric from events where event_type in ('view', 'click', 'error')")
def p19(t):
    return P.relabel_keep(samples(t), "vi.*|click|err.r").select("event_id", "metric")


@query("s22_label_values", "select distinct user_id::varchar as label_value from events where event_type = 'error' and user_id::varchar like '1%'")
def s22(t):
    return T.label_values(samples(t), "error", "user", [("user", "=~", "1.*")])


@query("s12_json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def s12_props(t):
    return t.events.select("event_id", json_value(F.col("props"), "$.k", "bigint").alias("k"))
