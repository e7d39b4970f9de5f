"""Media-quality views over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.aggregate_queries import rounded
from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.registry import query
from tidewire.plans import media_views as V

NOW = "2000-06-01 00:00:00"
TR = "measurement_mode = 'rtp' and packet_count >= 20"
OK = "capture_status = 'complete' and parse_success"
BAD = "capture_status = 'failed' or (capture_status = 'complete' and not parse_success)"
LOSSY = "coalesce(lost_packets, 0) > 0 or coalesce(loss_ratio, 0) > 0"


def now():
    return F.lit(NOW).cast("timestamp")


def joined(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


def cap(t):
    """Captures with the stream count of each."""
    n = frame(t, "streams").groupBy("capture_id").agg(F.count(F.lit(1)).alias("stream_count"))
    return frame(t, "captures").join(n, "capture_id", "left")


def samples(t):
    return V.stream_samples(frame(t, "streams"), frame(t, "captures"), devices(t))


def devices(t):
    """Device list: a MAC for each supplier, which no capture path of these tables contains except by its digits."""
    return t.supplier.select(F.col("s_suppkey").alias("key"), F.expr("lpad(cast(s_suppkey as string), 12, '0')").alias("mac"), F.col("s_name").alias("name"),
                             F.lit("test").alias("role"), F.lit("spare").alias("config"))


SAMPLES = """
, ss as (select s.*, c.study_id, c.source_name, c.source_path, c.capture_time, c.capture_status, c.deleted_at, c.parse_success,
  device_role as effective_device_role, device_name as effective_device_name, device_config as effective_device_config from streams s join captures c on c.capture_id = s.capture_id)
"""


@query("v01_latest_capture", ctes("captures") + f"""
select capture_id, source_name, capture_time from captures order by coalesce(case when capture_time <= timestamp '{NOW}' + interval 5 minute then capture_time end, parsed_at) desc, source_name desc limit 1""")
def v01(t):
    return V.latest_capture(frame(t, "captures"), now()).select("capture_id", "source_name", "capture_time")


@query("v02_capture_health", ctes("captures", "streams") + f"""
, n as (select capture_id, count(*) as stream_count from streams group by 1)
select site, capture_point, max(capture_time) filter (where capture_time <= timestamp '{NOW}' + interval 5 minute) as latest_capture_time,
 max(capture_time) filter (where capture_time > timestamp '{NOW}' + interval 5 minute) as latest_future_capture_time, count(*) filter (where capture_time > timestamp '{NOW}' + interval 5 minute) as future_capture_count,
 max(parsed_at) as latest_parsed_at, count(*) as capture_count, count(*) filter (where {OK}) as successful_capture_count, count(*) filter (where {BAD}) as failed_capture_count,
 sum(packets_read)::bigint as packets_read, sum(udp_packets_seen)::bigint as udp_packets_seen, sum(stream_count)::bigint as stream_count from captures c left join n on n.capture_id = c.capture_id group by 1, 2""")
def v02(t):
    return V.capture_health(cap(t), now())


@query("v03_stream_samples", ctes("streams", "captures") + SAMPLES + "select stream_id, packet_count, study_id, source_name, effective_device_role, effective_device_name, effective_device_config, deleted_at from ss")
def v03(t):
    return samples(t).select("stream_id", "packet_count", "study_id", "source_name", "effective_device_role", "effective_device_name", "effective_device_config", "deleted_at")


STUDIES = f"""
, cs as (select study_id, count(*) as capture_count, count(*) filter (where {OK}) as successful_capture_count, count(*) filter (where {BAD}) as failed_capture_count, min(capture_time) as first_capture_time,
  max(capture_time) as last_capture_time, max(parsed_at) as latest_parsed_at, sum(packets_read)::bigint as packets_read, sum(udp_packets_seen)::bigint as udp_packets_seen from captures where deleted_at is null group by 1),
st as (select study_id, count(*) as stream_count, count(*) filter (where {TR}) as rtp_qoe_stream_count, count(*) filter (where accepted) as accepted_stream_count,
  count(*) filter (where accepted is false or review_status = 'excluded') as excluded_stream_count, count(*) filter (where dscp_mismatch) as dscp_mismatch_stream_count,
  count(*) filter (where {LOSSY}) as lossy_stream_count, count(*) filter (where jitter_ms > 30) as jitter_stream_count from streams s join captures c on c.capture_id = s.capture_id where deleted_at is null group by 1),
vs as (select p.project_id, project_name, s.study_id, study_name, study_status, study_scope, coalesce(capture_count, 0) as capture_count, coalesce(successful_capture_count, 0) as successful_capture_count,
  coalesce(failed_capture_count, 0) as failed_capture_count, coalesce(stream_count, 0) as stream_count, coalesce(rtp_qoe_stream_count, 0) as rtp_qoe_stream_count, coalesce(accepted_stream_count, 0) as accepted_stream_count,
  coalesce(excluded_stream_count, 0) as excluded_stream_count, coalesce(dscp_mismatch_stream_count, 0) as dscp_mismatch_stream_count, coalesce(lossy_stream_count, 0) as lossy_stream_count,
  coalesce(jitter_stream_count, 0) as jitter_stream_count, first_capture_time, last_capture_time, latest_parsed_at, coalesce(packets_read, 0) as packets_read, coalesce(udp_packets_seen, 0) as udp_packets_seen,
  s.created_at, s.updated_at, s.deleted_at, s.study_type from studies s join projects p on p.project_id = s.project_id left join cs on cs.study_id = s.study_id left join st on st.study_id = s.study_id
  where study_type = 'media_qoe' and study_scope = 'media_qoe')
"""


def study_view(t):
    return V.studies(frame(t, "studies"), frame(t, "projects"), frame(t, "captures"), frame(t, "streams"))


@query("v04_studies", ctes("streams", "captures", "studies", "projects") + STUDIES + "select * from vs")
def v04(t):
    return study_view(t)


PROJECTS = """
, vp as (select p.project_id, p.project_name, p.project_type, p.description, p.site, count(s.study_id) as study_count, count(s.study_id) filter (where s.deleted_at is null) as active_study_count,
  coalesce(sum(capture_count) filter (where s.deleted_at is null), 0)::bigint as capture_count, coalesce(sum(stream_count) filter (where s.deleted_at is null), 0)::bigint as stream_count,
  coalesce(sum(rtp_qoe_stream_count) filter (where s.deleted_at is null), 0)::bigint as rtp_qoe_stream_count, coalesce(sum(accepted_stream_count) filter (where s.deleted_at is null), 0)::bigint as accepted_stream_count,
  coalesce(sum(dscp_mismatch_stream_count) filter (where s.deleted_at is null), 0)::bigint as dscp_mismatch_stream_count, min(first_capture_time) filter (where s.deleted_at is null) as first_capture_time,
  max(last_capture_time) filter (where s.deleted_at is null) as last_capture_time, max(latest_parsed_at) filter (where s.deleted_at is null) as latest_parsed_at, p.created_at, p.updated_at, p.deleted_at,
  coalesce(sum(lossy_stream_count) filter (where s.deleted_at is null), 0)::bigint as lossy_stream_count
  from projects p left join vs s on s.project_id = p.project_id where p.project_type in ('media_qoe', 'mixed') group by all)
"""


@query("v05_projects", ctes("streams", "captures", "studies", "projects") + STUDIES + PROJECTS + "select * exclude (lossy_stream_count) from vp")
def v05(t):
    return V.projects(frame(t, "projects"), study_view(t))


def P95(name, col, q="0.95"):
    return f"round(quantile_cont({col}, {q}) filter (where {TR} and {col} is not null), 6) as {name}"


PCT = ", ".join([P95("jitter_p95_ms", "jitter_ms"), P95("loss_p95_ratio", "loss_ratio"), P95("interarrival_p95_ms", "interarrival_p95_ms")])


@query("v06_study_captures", ctes("streams", "captures", "studies", "projects") + f"""
, g as (select capture_id, count(*) filter (where {TR}) as a, count(*) filter (where dscp_mismatch) as b, count(*) filter (where {LOSSY}) as l, count(*) filter (where dscp_mismatch and measurement_mode = 'rtp') as d,
  count(*) filter (where dscp_mismatch and measurement_mode <> 'rtp') as e, {PCT} from streams group by 1)
select p.project_id, c.study_id, c.capture_id, c.source_name, c.capture_status, coalesce(a, 0) as rtp_qoe_stream_count, coalesce(b, 0) as dscp_mismatch_stream_count, coalesce(l, 0) as lossy_stream_count,
 coalesce(d, 0) as trusted_rtp_dscp_mismatch_stream_count, coalesce(e, 0) as non_rtp_dscp_mismatch_stream_count, jitter_p95_ms, loss_p95_ratio, interarrival_p95_ms
from captures c join studies s on s.study_id = c.study_id join projects p on p.project_id = s.project_id left join g on g.capture_id = c.capture_id""")
def v06(t):
    d = V.study_captures(frame(t, "captures"), frame(t, "studies"), frame(t, "projects"), frame(t, "streams"))
    return rounded(d.select("project_id", "study_id", "capture_id", "source_name", "capture_status", "rtp_qoe_stream_count", "dscp_mismatch_stream_count", "lossy_stream_count",
                            "trusted_rtp_dscp_mismatch_stream_count", "non_rtp_dscp_mismatch_stream_count", "jitter_p95_ms", "loss_p95_ratio", "interarrival_p95_ms"))


@query("v07_parse_runs", ctes("parse_runs", "captures", "studies", "projects") + """
select r.parse_run_id, r.study_id, r.capture_id, r.status, c.source_name, p.project_id from parse_runs r left join captures c on c.capture_id = r.capture_id
left join studies s on s.study_id = coalesce(r.study_id, c.study_id) left join projects p on p.project_id = s.project_id""")
def v07(t):
    d = V.parse_runs(frame(t, "parse_runs"), frame(t, "captures"), frame(t, "studies"), frame(t, "projects"))
    return d.select("parse_run_id", "study_id", "capture_id", "status", "source_name", "project_id")


@query("v08_study_streams", ctes("streams", "captures", "studies", "projects") + """
select p.project_id, c.study_id, s.capture_id, source_name, stream_id, packet_count, loss_ratio, review_status from streams s join captures c on c.capture_id = s.capture_id join studies st on st.study_id = c.study_id
join projects p on p.project_id = st.project_id where c.deleted_at is null""")
def v08(t):
    d = V.study_streams(frame(t, "streams"), frame(t, "captures"), frame(t, "studies"), frame(t, "projects"))
    return d.select("project_id", "study_id", "capture_id", "source_name", "stream_id", "packet_count", "loss_ratio", "review_status")


@query("v09_project_summary", ctes("streams", "captures", "studies", "projects") + STUDIES + PROJECTS + f"""
, q as (select p.project_id, {PCT} from projects p join studies st on st.project_id = p.project_id join captures c on c.study_id = st.study_id and c.deleted_at is null join streams s on s.capture_id = c.capture_id
  where p.project_type in ('media_qoe', 'mixed') and st.study_type = 'media_qoe' and st.deleted_at is null group by 1)
select vp.project_id, project_name, study_count, capture_count, stream_count, rtp_qoe_stream_count, accepted_stream_count, dscp_mismatch_stream_count, lossy_stream_count, jitter_p95_ms, loss_p95_ratio, interarrival_p95_ms,
 first_capture_time, last_capture_time, latest_parsed_at from vp left join q on q.project_id = vp.project_id""")
def v09(t):
    return rounded(V.project_summary(frame(t, "projects"), frame(t, "studies"), frame(t, "captures"), frame(t, "streams")))


@query("v10_duplicate_captures", ctes("captures", "studies", "projects") + """
, n as (select p.project_id, c.*, coalesce(nullif(source_sha256, ''), 'path:' || coalesce(source_path, '') || '|size:' || coalesce(source_size_bytes::varchar, '') || '|mtime:' || coalesce(source_mtime_ns::varchar, '')) as duplicate_key
  from captures c join studies s on s.study_id = c.study_id join projects p on p.project_id = s.project_id where c.deleted_at is null),
k as (select *, count(*) over (partition by project_id, duplicate_key) as duplicate_count, row_number() over (partition by project_id, duplicate_key order by capture_time desc nulls last, capture_id desc) as duplicate_rank from n)
select project_id, study_id, capture_id, duplicate_key, duplicate_count, duplicate_rank from k where duplicate_count > 1""")
def v10(t):
    return V.duplicate_captures(frame(t, "captures"), frame(t, "studies"), frame(t, "projects")).select(
        "project_id", "study_id", "capture_id", "duplicate_key", "duplicate_count", "duplicate_rank")


TOT = f"""coalesce(sum(packet_count) filter (where measurement_mode = 'rtp_candidate_rejected'), 0)::bigint as rtp_candidate_rejected_packet_count,
 coalesce(sum(packet_count) filter (where {TR}), 0)::bigint as rtp_packet_count, coalesce(sum(expected_packets) filter (where {TR}), 0)::bigint as rtp_expected_packets,
 coalesce(sum(lost_packets) filter (where {TR}), 0)::bigint as rtp_lost_packets, coalesce(sum(duplicate_packets) filter (where {TR}), 0)::bigint as rtp_duplicate_packets,
 coalesce(sum(out_of_order_packets) filter (where {TR}), 0)::bigint as rtp_out_of_order_packets"""
RATIOS = """round(rtp_lost_packets::double / nullif(rtp_expected_packets, 0), 6) as rtp_loss_total_ratio, round(rtp_duplicate_packets::double / nullif(rtp_packet_count, 0), 6) as rtp_duplicate_packet_ratio,
 round(rtp_out_of_order_packets::double / nullif(rtp_packet_count, 0), 6) as rtp_out_of_order_packet_ratio"""
SUMS = "coalesce(sum(lost_packets), 0)::bigint as lost_packets, sum(duplicate_packets)::bigint as duplicate_packets, sum(out_of_order_packets)::bigint as out_of_order_packets"


@query("v11_current_study", ctes("streams", "captures") + SAMPLES + f"""
, a as (select count(*) as capture_count, count(*) filter (where {OK}) as successful_capture_count, count(*) filter (where {BAD}) as failed_capture_count, min(capture_time) as first_capture_time, max(capture_time) as last_capture_time,
  max(parsed_at) as latest_parsed_at, sum(packets_read)::bigint as packets_read, sum(udp_packets_seen)::bigint as udp_packets_seen from captures),
b as (select count(*) as stream_count, count(*) filter (where {TR}) as rtp_qoe_stream_count, count(*) filter (where measurement_mode = 'rtp_candidate_rejected') as rtp_candidate_rejected_stream_count, sum(packet_count)::bigint as packet_count,
  {SUMS}, {TOT}, count(distinct effective_device_role) filter (where effective_device_role in ('control', 'test')) as tested_device_role_count from ss)
select *, {RATIOS} from a, b""")
def v11(t):
    return rounded(V.current_study(frame(t, "captures"), samples(t)))


DEVICE = f"""
, dv as (select effective_device_role as device_role, effective_device_name as device_name, effective_device_config as device_config, count(distinct capture_id) as capture_count, count(*) as stream_count,
  count(*) filter (where {TR}) as rtp_qoe_stream_count, min(sample_time) as first_sample_time, max(sample_time) as last_sample_time, sum(packet_count)::bigint as packet_count, sum(byte_count)::bigint as byte_count, {SUMS},
  quantile_cont(jitter_ms, 0.95) filter (where {TR}) as jitter_p95_ms, quantile_cont(loss_ratio, 0.95) filter (where {TR}) as loss_p95_ratio, quantile_cont(interarrival_p95_ms, 0.95) filter (where {TR}) as interarrival_p95_ms,
  max(interarrival_max_ms) filter (where {TR}) as interarrival_max_ms, count(*) filter (where dscp_mismatch) as dscp_mismatch_stream_count, count(*) filter (where measurement_mode = 'rtp_candidate_rejected') as rtp_candidate_rejected_stream_count,
  {TOT}, quantile_cont(jitter_ms, 0.05) filter (where {TR}) as jitter_p05_ms, avg(jitter_ms) filter (where {TR}) as jitter_mean_ms, quantile_cont(interarrival_p95_ms, 0.05) filter (where {TR}) as interarrival_p05_ms,
  avg(interarrival_p95_ms) filter (where {TR}) as interarrival_mean_ms from ss where effective_device_role in ('control', 'test') group by 1, 2, 3)
"""


@query("v12_device_summary", ctes("streams", "captures") + SAMPLES + DEVICE + f"""
select * replace (round(jitter_p95_ms, 6) as jitter_p95_ms, round(loss_p95_ratio, 6) as loss_p95_ratio, round(interarrival_p95_ms, 6) as interarrival_p95_ms, round(interarrival_max_ms, 6) as interarrival_max_ms,
 round(jitter_p05_ms, 6) as jitter_p05_ms, round(jitter_mean_ms, 6) as jitter_mean_ms, round(interarrival_p05_ms, 6) as interarrival_p05_ms, round(interarrival_mean_ms, 6) as interarrival_mean_ms), {RATIOS} from dv""")
def v12(t):
    return rounded(V.device_summary(samples(t)))


@query("v13_rtp_classification", ctes("streams", "captures") + SAMPLES + """
select effective_device_role as device_role, effective_device_name as device_name, effective_device_config as device_config, measurement_mode as classification, count(distinct capture_id) as capture_count,
 count(*) as stream_count, sum(packet_count)::bigint as packet_count, min(sample_time) as first_sample_time, max(sample_time) as last_sample_time from ss group by 1, 2, 3, 4""")
def v13(t):
    return V.rtp_classification(samples(t))


@query("v14_rejection_reasons", ctes("streams", "captures") + SAMPLES + """
, r as (select *, unnest(case when server_key % 3 = 0 then ['']::varchar[] when server_key % 3 = 1 then ['a', 'b'] else [null]::varchar[] end) as rr from ss where measurement_mode = 'rtp_candidate_rejected')
select effective_device_role as device_role, effective_device_name as device_name, effective_device_config as device_config, coalesce(nullif(rr, ''), 'unspecified') as reason, payload_type, dscp,
 count(distinct capture_id) as capture_count, count(*) as stream_count, sum(packet_count)::bigint as packet_count, min(sample_time) as first_sample_time, max(sample_time) as last_sample_time from r group by all""")
def v14(t):
    k = F.col("server_key") % 3
    reasons = F.when(k == 0, F.array(F.lit(""))).when(k == 1, F.array(F.lit("a"), F.lit("b")))
    return V.rtp_rejection_reasons(samples(t).withColumn("rejection_reasons", reasons))


def _delta_sql():
    rows = []
    for label, col, scale in V.DELTA_METRICS:
        a, b = (f"(max({col}) filter (where device_role = '{r}'))::double * {scale}" for r in ("control", "test"))
        rows.append(f"select '{label}' as metric, round({a}, 6) as control_value, round({b}, 6) as test_value, round({b} - {a}, 6) as delta from x")
    return " union all ".join(rows)


@query("v15_control_test_delta", ctes("streams", "captures") + SAMPLES + DEVICE + f", x as (select * exclude (loss_p95_ratio), loss_p95_ratio, {RATIOS.replace('round(', '(').replace(', 6)', ')')} from dv) " + _delta_sql())
def v15(t):
    return rounded(V.control_test_deltas(V.device_summary(samples(t))))


@query("v16_capture_inventory", ctes("streams", "captures") + SAMPLES + """
select c.capture_id, c.source_name, coalesce(string_agg(distinct effective_device_role, ', ' order by effective_device_role), 'unmapped') as device_roles from captures c left join ss on ss.capture_id = c.capture_id group by 1, 2""")
def v16(t):
    return V.capture_inventory(frame(t, "captures"), samples(t)).select("capture_id", "source_name", "device_roles")


@query("v17_capture_sessions", ctes("sessions", "attempts", "session_events", "legs") + """
select s.*, coalesce(a.n, 0) as attempt_count, coalesce(a.h, 0) as heard_attempt_count, coalesce(a.m, 0) as missed_attempt_count, coalesce(a.d, 0) as degraded_attempt_count, coalesce(e.n, 0) as event_count, e.latest as latest_event_time,
 r.attempt_id as latest_resolved_attempt_id, r.resolved_group_ip as latest_resolved_group_ip, r.resolved_group_vlan as latest_resolved_group_vlan, r.resolved_mgid as latest_resolved_mgid,
 r.vlan_context_state as latest_resolved_vlan_context_state, r.active_group_selected_at as latest_resolved_at, coalesce(l.n, 0) as leg_count, coalesce(l.o, 0) as ap_ota_leg_count, coalesce(l.r, 0) as ready_ap_ota_leg_count
from sessions s left join (select capture_session_id as k, count(*) as n, count(*) filter (where audio_result = 'heard') as h, count(*) filter (where audio_result = 'missed') as m, count(*) filter (where audio_result in ('partial', 'choppy')) as d from attempts group by 1) a on a.k = s.session_id
left join (select capture_session_id as k, count(*) as n, max(event_time) as latest from session_events group by 1) e on e.k = s.session_id
left join (select capture_session_id as k, count(*) as n, count(*) filter (where leg_type = 'ap_client_ota') as o, count(*) filter (where leg_type = 'ap_client_ota' and leg_state in ('ready', 'running', 'parsed')) as r from legs group by 1) l on l.k = s.session_id
left join (select *, row_number() over (partition by capture_session_id order by coalesce(active_group_selected_at, attempt_started_at) desc, attempt_id desc) as rn from attempts where resolved_group_ip is not null) r on r.capture_session_id = s.session_id and r.rn = 1""")
def v17(t):
    return V.capture_sessions(frame(t, "sessions"), frame(t, "attempts"), frame(t, "session_events"), frame(t, "legs"))


@query("v18_capture_legs", ctes("legs") + "select * from legs")
def v18(t):
    return V.capture_legs(frame(t, "legs"))


@query("v19_session_events", ctes("session_events") + "select * from session_events")
def v19(t):
    return V.capture_session_events(frame(t, "session_events"))


@query("v20_broadcast_attempts", ctes("attempts", "sessions", "artifacts", "snapshots", "findings") + """
, a as (select attempt_id as k, count(*) as artifact_count, count(*) filter (where artifact_type in ('wlc_epc', 'ap_packet_capture')) as pcap_artifact_count from artifacts group by 1),
s as (select attempt_id as k, count(*) as snapshot_count, max(receiver_ap) filter (where phase = 'during') as receiver_ap, max(receiver_channel) filter (where phase = 'during') as receiver_channel, max(receiver_rssi) filter (where phase = 'during') as receiver_rssi,
  bool_or(receiver_group_member) filter (where phase = 'during') as snapshot_receiver_group_member, max(receiver_group_status) filter (where phase = 'during') as receiver_group_status, max(mgid) filter (where phase = 'during') as mgid from snapshots group by 1),
f as (select attempt_id as k, count(*) filter (where severity = 'critical') as critical_finding_count, count(*) filter (where severity = 'warning') as warning_finding_count from findings group by 1)
select attempt_id, capture_session_id, verdict, capture_name, session_state, coalesce(artifact_count, 0) as artifact_count, coalesce(pcap_artifact_count, 0) as pcap_artifact_count, coalesce(snapshot_count, 0) as snapshot_count, receiver_ap, receiver_channel, receiver_rssi,
 snapshot_receiver_group_member, receiver_group_status, mgid, coalesce(critical_finding_count, 0) as critical_finding_count, coalesce(warning_finding_count, 0) as warning_finding_count
from attempts t left join sessions e on e.session_id = t.capture_session_id left join a on a.k = attempt_id left join s on s.k = attempt_id left join f on f.k = attempt_id""")
def v20(t):
    d = V.broadcast_attempts(*[frame(t, n) for n in ("attempts", "sessions", "artifacts", "snapshots", "findings")])
    return d.select("attempt_id", "capture_session_id", "verdict", "capture_name", "session_state", "artifact_count", "pcap_artifact_count", "snapshot_count", "receiver_ap", "receiver_channel", "receiver_rssi",
                    "snapshot_receiver_group_member", "receiver_group_status", "mgid", "critical_finding_count", "warning_finding_count")


@query("v21_attempt_artifacts", ctes("artifacts") + "select * from artifacts")
def v21(t):
    return V.attempt_artifacts(frame(t, "artifacts"))


@query("v22_attempt_findings", ctes("findings") + "select * from findings")
def v22(t):
    return V.attempt_findings(frame(t, "findings"))


@query("v23_multicast_observations", ctes("observations") + "select * from observations")
def v23(t):
    return V.multicast_observations(frame(t, "observations"))


def _set(col):
    return f"coalesce(array_to_string(list_sort(list(distinct {col}) filter (where {col} is not null)), ','), '')"


@query("v24_group_explorer", ctes("observations") + f"""
select group_ip, group_mac, min(observed_at) as first_seen, max(observed_at) as last_seen, {_set('source_ip')} as source_ips, {_set('vlan')} as vlans, {_set('mgid')} as mgids, count(distinct attempt_id) as attempts,
 bool_or(receiver_member) as receiver_membership_seen, {_set('ap_name')} as aps_involved, {_set('evidence_source')} as evidence_sources, max(capture_confidence) as capture_confidence, count(*) as observation_count
from observations where group_ip is not null group by 1, 2""")
def v24(t):
    d = V.group_explorer(frame(t, "observations"))
    sets = ["source_ips", "vlans", "mgids", "aps_involved", "evidence_sources"]
    return d.select("group_ip", "group_mac", "first_seen", "last_seen", *[joined(s).alias(s) for s in sets], F.size("associated_attempts").cast("bigint").alias("attempts"),
                    "receiver_membership_seen", "capture_confidence", "observation_count")


@query("v25_attempt_timeline", ctes("attempts", "session_events", "snapshots") + """
select attempt_id, study_id, started_at as event_time, 'attempt_started' as event_kind, verdict as event_value, raw_context as context from attempts where started_at is not null
union all select coalesce(attempt_id, event_id), study_id, event_time, 'session_' || event_kind, coalesce(audio_result, notes, event_kind), raw_context from session_events
union all select attempt_id, null, null, 'wlc_snapshot_' || coalesce(phase, 'unknown'), coalesce(receiver_ap, group_ip, receiver_group_status), receiver_channel || ':' || mgid from snapshots""")
def v25(t):
    d = V.attempt_timeline(frame(t, "attempts"), frame(t, "session_events"), frame(t, "snapshots"))
    ctx = F.when(F.col("event_kind").startswith("wlc_"), F.concat(F.get_json_object("event_context", "$.receiver_channel"), F.lit(":"), F.get_json_object("event_context", "$.mgid"))).otherwise(F.col("event_context"))
    return d.select("attempt_id", "study_id", "event_time", "event_kind", "event_value", ctx.alias("context"))


@query("v26_attempt_matrix", ctes("attempts", "observations") + f"""
select a.attempt_id, a.study_id, a.audio_result, a.vlan_context_state, a.verdict, max(o.group_ip) as group_ip, max(o.vlan) as vlan, max(o.mgid) as mgid, bool_or(o.receiver_member) as receiver_member_seen,
 bool_or(o.receiver_blocklisted) as receiver_blocklisted_seen, max(o.ap_tx_packets) as ap_tx_packets, {_set('o.evidence_source')} as evidence_sources from attempts a left join observations o on o.attempt_id = a.attempt_id group by 1, 2, 3, 4, 5""")
def v26(t):
    d = V.attempt_matrix(frame(t, "attempts"), frame(t, "observations"))
    return d.select("attempt_id", "study_id", "audio_result", "vlan_context_state", "verdict", "group_ip", "vlan", "mgid", "receiver_member_seen", "receiver_blocklisted_seen", "ap_tx_packets", joined("evidence_sources").alias("evidence_sources"))


@query("v27_attempt_summary", ctes("attempts") + """
select study_id, capture_session_id, count(*) as attempt_count, count(*) filter (where audio_result = 'heard') as heard_attempt_count, count(*) filter (where audio_result = 'missed') as missed_attempt_count,
 count(*) filter (where audio_result in ('partial', 'choppy')) as degraded_attempt_count, count(*) filter (where verdict = 'membership_failure') as membership_failure_count, count(*) filter (where verdict = 'media_degraded') as media_degraded_count,
 count(*) filter (where verdict = 'inconclusive') as inconclusive_count, min(started_at) as first_attempt_at, max(started_at) as latest_attempt_at from attempts group by 1, 2""")
def v27(t):
    return V.attempt_summary(frame(t, "attempts"))


@query("v28_attempt_ap_distribution", ctes("attempts", "snapshots") + """
select study_id, receiver_ap, receiver_channel, receiver_band, count(*) as attempt_count, count(*) filter (where audio_result = 'missed') as missed_audio_count, count(*) filter (where verdict = 'membership_failure') as membership_failure_count
from attempts a join snapshots s on s.attempt_id = a.attempt_id where phase = 'during' group by 1, 2, 3, 4""")
def v28(t):
    return V.attempt_ap_distribution(frame(t, "attempts"), frame(t, "snapshots"))


@query("a35_group_members", ctes("observations") + """
, m as (select group_ip, group_mac, observed_at, unnest([{'kind': 'source_ips', 'member': source_ip::varchar}, {'kind': 'vlans', 'member': vlan::varchar}, {'kind': 'mgids', 'member': mgid::varchar},
  {'kind': 'associated_attempts', 'member': attempt_id::varchar}, {'kind': 'aps_involved', 'member': ap_name::varchar}, {'kind': 'evidence_sources', 'member': evidence_source::varchar}]) as x from observations where group_ip is not null)
select group_ip, group_mac, x.kind as kind, x.member as member, count(*) as observation_count, min(observed_at) as first_seen, max(observed_at) as last_seen from m where x.member is not null group by 1, 2, 3, 4""")
def a35m(t):
    return V.group_members(frame(t, "observations"))


@query("a35_group_explorer", ctes("observations") + "select group_ip, group_mac, count(*) as observation_count, bool_or(receiver_member) as receiver_membership_seen from observations where group_ip is not null group by 1, 2")
def a35(t):
    return V.group_explorer(frame(t, "observations")).select("group_ip", "group_mac", "observation_count", "receiver_membership_seen")
