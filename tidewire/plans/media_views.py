"""Media-quality views: captures, streams, studies, projects, sessions and attempts.

Each view is a function of DataFrames. Children are aggregated before they are
joined to a parent; percentiles of trusted streams are exact and skew-safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.predicates import effective, is_future, trusted
from tidewire.functions.scalars import json_build, safe_ratio
from tidewire.operators.aggregates import (control_test_delta, count_where, explode_reasons, pivot_roles, set_sorted,
                                           string_list, sum_where)
from tidewire.operators.blocked import Order
from tidewire.operators.joins import contains_join, latest_child, rollup_left, single_rows, zero_fill
from tidewire.operators.quantiles import with_percentiles
from tidewire.operators.windows import duplicate_sources, latest_row, source_key
from tidewire.session import checkpointed

c = F.col


def rows_n() -> Column:
    """Rows of a group."""
    return F.count(F.lit(1))


READY_LEG_STATES = ["ready", "prepared", "running", "stopped", "attached", "parsed"]
CAPTURE_FILE_TYPES = ["wlc_epc", "ap_packet_capture"]
CLASSES = ["rtp", "rtp_candidate_rejected", "udp_interarrival_only", "unknown_udp"]


def _trusted() -> Column:
    return trusted(c("measurement_mode"), c("packet_count"))


def _parsed() -> Column:
    return (c("capture_status") == "complete") & c("parse_success")


def _failed() -> Column:
    return (c("capture_status") == "failed") | ((c("capture_status") == "complete") & ~c("parse_success"))


def _lossy() -> Column:
    return (F.coalesce("lost_packets", F.lit(0)) > 0) | (F.coalesce("loss_ratio", F.lit(0.0)) > 0)


def _zero(col: str) -> Column:
    return F.coalesce(c(col), F.lit(0))


def _trusted_measures(streams: DataFrame) -> DataFrame:
    """Quality figures of trusted streams only; null elsewhere, so percentiles skip the rest."""
    return streams.withColumns({f"_t_{m}": F.when(_trusted(), c(m).cast("double")) for m in
                                ("jitter_ms", "loss_ratio", "interarrival_p95_ms", "interarrival_max_ms")})


P95 = {"jitter_p95_ms": ("_t_jitter_ms", 0.95, "cont"), "loss_p95_ratio": ("_t_loss_ratio", 0.95, "cont"),
       "interarrival_p95_ms": ("_t_interarrival_p95_ms", 0.95, "cont")}


def latest_capture(captures: DataFrame, now: Column) -> DataFrame:
    """The newest capture by its time, unless that lies in the future, else by parse time."""
    at = F.coalesce(F.when(~is_future(c("capture_time"), now), c("capture_time")), c("parsed_at"))
    return latest_row(captures, at.desc(), c("source_name").desc())


def capture_health(captures: DataFrame, now: Column) -> DataFrame:
    late = is_future(c("capture_time"), now)
    return captures.groupBy("site", "capture_point").agg(
        F.max(F.when(~late, c("capture_time"))).alias("latest_capture_time"), F.max(F.when(late, c("capture_time"))).alias("latest_future_capture_time"),
        count_where(late).alias("future_capture_count"), F.max("parsed_at").alias("latest_parsed_at"), rows_n().alias("capture_count"),
        count_where(_parsed()).alias("successful_capture_count"), count_where(_failed()).alias("failed_capture_count"),
        *[F.sum(m).alias(m) for m in ("packets_read", "udp_packets_seen", "stream_count")])


def stream_samples(streams: DataFrame, captures: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """Streams with their capture and the effective device labels.

    ``devices`` (key, mac, name, role, config) names devices whose MAC may occur
    in a capture's path, for streams whose own role is unmapped.
    """
    cap = captures.select("capture_id", "study_id", "source_name", "source_path", "capture_time", "capture_status", "deleted_at", "parse_success")
    take = {"_dev_name": "name", "_dev_role": "role", "_dev_config": "config"}
    if devices is not None:
        cap = contains_join(cap, devices, ["source_path", "source_name"], "mac", ["capture_id"], "key", take)
    else:
        cap = cap.withColumns({k: F.lit(None).cast("string") for k in take})
    role = c("device_role")
    out = streams.join(cap, "capture_id").withColumns({
        "effective_device_role": effective(role, role, c("_dev_role")),
        "effective_device_name": effective(role, c("device_name"), c("_dev_name")),
        "effective_device_config": effective(role, c("device_config"), c("_dev_config"))})
    return out.drop(*take)


def studies(studies_df: DataFrame, projects_df: DataFrame, captures: DataFrame, streams: DataFrame) -> DataFrame:
    alive = captures.filter(c("deleted_at").isNull())
    cap = alive.groupBy("study_id").agg(
        rows_n().alias("capture_count"), count_where(_parsed()).alias("successful_capture_count"), count_where(_failed()).alias("failed_capture_count"),
        F.min("capture_time").alias("first_capture_time"), F.max("capture_time").alias("last_capture_time"), F.max("parsed_at").alias("latest_parsed_at"),
        F.sum("packets_read").alias("packets_read"), F.sum("udp_packets_seen").alias("udp_packets_seen"))
    counts = {"stream_count": rows_n(), "rtp_qoe_stream_count": count_where(_trusted()), "accepted_stream_count": count_where(c("accepted")),
              "excluded_stream_count": count_where((~c("accepted")).eqNullSafe(True) | (c("review_status") == "excluded")),
              "dscp_mismatch_stream_count": count_where(c("dscp_mismatch")), "lossy_stream_count": count_where(_lossy()),
              "jitter_stream_count": count_where(c("jitter_ms") > 30)}
    per_capture = streams.groupBy("capture_id").agg(*[v.alias(k) for k, v in counts.items()])
    st = alive.select("study_id", "capture_id").join(per_capture, "capture_id").groupBy("study_id").agg(*[F.sum(k).alias(k) for k in counts])
    base = studies_df.filter((c("study_type") == "media_qoe") & (c("study_scope") == "media_qoe")).join(
        projects_df.select("project_id", "project_name"), "project_id")
    zeros = ["capture_count", "successful_capture_count", "failed_capture_count", "packets_read", "udp_packets_seen", *counts]
    return zero_fill(base.join(cap, "study_id", "left").join(st, "study_id", "left"), zeros)


def projects(projects_df: DataFrame, study_view: DataFrame) -> DataFrame:
    alive = c("deleted_at").isNull()
    sums = ["capture_count", "stream_count", "rtp_qoe_stream_count", "accepted_stream_count", "dscp_mismatch_stream_count"]
    g = study_view.groupBy("project_id").agg(
        rows_n().alias("study_count"), count_where(alive).alias("active_study_count"), *[sum_where(alive, c(s)).alias(s) for s in sums],
        F.min(F.when(alive, c("first_capture_time"))).alias("first_capture_time"), F.max(F.when(alive, c("last_capture_time"))).alias("last_capture_time"),
        F.max(F.when(alive, c("latest_parsed_at"))).alias("latest_parsed_at"))
    base = projects_df.filter(c("project_type").isin("media_qoe", "mixed"))
    return rollup_left(base, g, ["project_id"], ["study_count", "active_study_count", *sums])


def study_captures(captures: DataFrame, studies_df: DataFrame, projects_df: DataFrame, streams: DataFrame) -> DataFrame:
    mode, bad = c("measurement_mode"), c("dscp_mismatch")
    measured = _trusted_measures(streams)
    counts = {"rtp_qoe_stream_count": count_where(_trusted()), "dscp_mismatch_stream_count": count_where(bad), "lossy_stream_count": count_where(_lossy()),
              "trusted_rtp_dscp_mismatch_stream_count": count_where(bad & (mode == "rtp")),
              "non_rtp_dscp_mismatch_stream_count": count_where(bad & (F.coalesce(mode, F.lit("")) != "rtp"))}
    g = with_percentiles(measured.groupBy("capture_id").agg(*[v.alias(k) for k, v in counts.items()]), measured, ["capture_id"], P95)
    owner = studies_df.select("study_id", "project_id").join(projects_df.select("project_id"), "project_id")
    return rollup_left(captures.join(owner, "study_id"), g, ["capture_id"], list(counts))


def parse_runs(runs: DataFrame, captures: DataFrame, studies_df: DataFrame, projects_df: DataFrame) -> DataFrame:
    cap = captures.select("capture_id", "source_name", c("study_id").alias("_cs"))
    owner = studies_df.select(c("study_id").alias("_st"), "project_id").join(projects_df.select("project_id"), "project_id")
    d = runs.join(cap, "capture_id", "left")
    return d.join(owner, F.coalesce(c("study_id"), c("_cs")) == c("_st"), "left").drop("_cs", "_st")


def study_streams(streams: DataFrame, captures: DataFrame, studies_df: DataFrame, projects_df: DataFrame) -> DataFrame:
    alive = captures.filter(c("deleted_at").isNull()).select("capture_id", "study_id", "source_name")
    owner = studies_df.select("study_id", "project_id").join(projects_df.select("project_id"), "project_id")
    return streams.join(alive, "capture_id").join(owner, "study_id")


def project_summary(projects_df: DataFrame, studies_df: DataFrame, captures: DataFrame, streams: DataFrame) -> DataFrame:
    study_view = studies(studies_df, projects_df, captures, streams)
    project_view = projects(projects_df, study_view)
    lossy = study_view.filter(c("deleted_at").isNull()).groupBy("project_id").agg(F.sum("lossy_stream_count").alias("lossy_stream_count"))
    st = studies_df.filter((c("study_type") == "media_qoe") & c("deleted_at").isNull()).select("study_id", "project_id")
    st = st.join(projects_df.filter(c("project_type").isin("media_qoe", "mixed")).select("project_id"), "project_id")
    rows = _trusted_measures(streams.join(captures.filter(c("deleted_at").isNull()).select("capture_id", "study_id"), "capture_id").join(st, "study_id"))
    cols = ["project_id", "project_name", "study_count", "capture_count", "stream_count", "rtp_qoe_stream_count", "accepted_stream_count",
            "dscp_mismatch_stream_count", "first_capture_time", "last_capture_time", "latest_parsed_at"]
    out = zero_fill(project_view.select(*cols).join(lossy, "project_id", "left"), ["lossy_stream_count"])
    return with_percentiles(out, rows, ["project_id"], P95)


def duplicate_captures(captures: DataFrame, studies_df: DataFrame, projects_df: DataFrame) -> DataFrame:
    owner = studies_df.select("study_id", "project_id").join(projects_df.select("project_id"), "project_id")
    d = captures.filter(c("deleted_at").isNull()).join(owner, "study_id")
    key = source_key(c("source_sha256"), c("source_path"), c("source_size_bytes"), c("source_mtime_ns"))
    return duplicate_sources(d, ["project_id"], key, Order("capture_time", ("-capture_id",), desc=True))


def current_study(captures: DataFrame, samples: DataFrame) -> DataFrame:
    """One row of totals over everything."""
    cap = captures.agg(
        rows_n().alias("capture_count"), count_where(_parsed()).alias("successful_capture_count"), count_where(_failed()).alias("failed_capture_count"),
        F.min("capture_time").alias("first_capture_time"), F.max("capture_time").alias("last_capture_time"), F.max("parsed_at").alias("latest_parsed_at"),
        F.sum("packets_read").alias("packets_read"), F.sum("udp_packets_seen").alias("udp_packets_seen"))
    rejected = c("measurement_mode") == "rtp_candidate_rejected"
    role = c("effective_device_role")
    st = samples.agg(
        rows_n().alias("stream_count"), count_where(_trusted()).alias("rtp_qoe_stream_count"), count_where(rejected).alias("rtp_candidate_rejected_stream_count"),
        F.sum("packet_count").alias("packet_count"), *[F.sum(_zero(m)).alias(m) for m in ("lost_packets", "duplicate_packets", "out_of_order_packets")],
        *_trusted_totals(), F.count_distinct(F.when(role.isin("control", "test"), role)).alias("tested_device_role_count"))
    return _with_total_ratios(single_rows(cap, st))


def _trusted_totals() -> list[Column]:
    rejected = c("measurement_mode") == "rtp_candidate_rejected"
    total = lambda cond, value: F.coalesce(sum_where(cond, value), F.lit(0))
    return [total(rejected, c("packet_count")).alias("rtp_candidate_rejected_packet_count"), total(_trusted(), c("packet_count")).alias("rtp_packet_count"),
            total(_trusted(), c("expected_packets")).alias("rtp_expected_packets"),
            *[total(_trusted(), _zero(m)).alias(f"rtp_{m}") for m in ("lost_packets", "duplicate_packets", "out_of_order_packets")]]


def _with_total_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "rtp_loss_total_ratio": safe_ratio(c("rtp_lost_packets"), c("rtp_expected_packets")),
        "rtp_duplicate_packet_ratio": safe_ratio(c("rtp_duplicate_packets"), c("rtp_packet_count")),
        "rtp_out_of_order_packet_ratio": safe_ratio(c("rtp_out_of_order_packets"), c("rtp_packet_count"))})


DEVICE = ["device_role", "device_name", "device_config"]


def _as_device(samples: DataFrame) -> DataFrame:
    return samples.drop(*DEVICE).withColumnsRenamed({f"effective_{d}": d for d in DEVICE})


def device_summary(samples: DataFrame) -> DataFrame:
    """Per tested device: counts over all streams, quality over trusted ones."""
    used = [*DEVICE, "capture_id", "measurement_mode", "packet_count", "byte_count", "expected_packets", "lost_packets", "duplicate_packets", "out_of_order_packets",
            "jitter_ms", "loss_ratio", "interarrival_p95_ms", "interarrival_max_ms", "dscp_mismatch", "sample_time"]
    # the counts and both passes of the percentiles read these rows, so the joins behind them run once
    d = checkpointed(_as_device(samples).filter(c("device_role").isin("control", "test")).select(*used))
    d = _trusted_measures(d)
    g = d.groupBy(*DEVICE).agg(
        F.count_distinct("capture_id").alias("capture_count"), rows_n().alias("stream_count"), count_where(_trusted()).alias("rtp_qoe_stream_count"),
        F.min("sample_time").alias("first_sample_time"), F.max("sample_time").alias("last_sample_time"), F.sum("packet_count").alias("packet_count"),
        F.sum("byte_count").alias("byte_count"), *[F.sum(_zero(m)).alias(m) for m in ("lost_packets", "duplicate_packets", "out_of_order_packets")],
        F.max("_t_interarrival_max_ms").alias("interarrival_max_ms"), count_where(c("dscp_mismatch")).alias("dscp_mismatch_stream_count"),
        count_where(c("measurement_mode") == "rtp_candidate_rejected").alias("rtp_candidate_rejected_stream_count"), *_trusted_totals(),
        F.avg("_t_jitter_ms").alias("jitter_mean_ms"), F.avg("_t_interarrival_p95_ms").alias("interarrival_mean_ms"))
    specs = {**P95, "jitter_p05_ms": ("_t_jitter_ms", 0.05, "cont"), "interarrival_p05_ms": ("_t_interarrival_p95_ms", 0.05, "cont")}
    return with_percentiles(_with_total_ratios(g), d, DEVICE, specs)


def rtp_classification(samples: DataFrame) -> DataFrame:
    d = _as_device(samples).filter(c("measurement_mode").isin(CLASSES))
    return d.groupBy(*DEVICE, c("measurement_mode").alias("classification")).agg(
        F.count_distinct("capture_id").alias("capture_count"), rows_n().alias("stream_count"), F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packet_count"),
        F.min("sample_time").alias("first_sample_time"), F.max("sample_time").alias("last_sample_time"))


def rtp_rejection_reasons(samples: DataFrame, reasons: str = "rejection_reasons") -> DataFrame:
    d = _as_device(samples).filter(c("measurement_mode") == "rtp_candidate_rejected")
    d = explode_reasons(d.select(*DEVICE, "payload_type", "dscp", "capture_id", "packet_count", "sample_time", reasons), reasons)
    return d.groupBy(*DEVICE, "reason", "payload_type", "dscp").agg(
        F.count_distinct("capture_id").alias("capture_count"), rows_n().alias("stream_count"), F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packet_count"),
        F.min("sample_time").alias("first_sample_time"), F.max("sample_time").alias("last_sample_time"))


# Report metrics as (label, column, scale).
DELTA_METRICS = [
    ("RTP jitter p05 ms", "jitter_p05_ms", 1.0), ("RTP jitter mean ms", "jitter_mean_ms", 1.0), ("RTP jitter p95 ms", "jitter_p95_ms", 1.0),
    ("RTP packet loss p95 %", "loss_p95_ratio", 100.0), ("RTP packet loss total %", "rtp_loss_total_ratio", 100.0),
    ("RTP duplicate packet %", "rtp_duplicate_packet_ratio", 100.0), ("RTP out-of-order packet %", "rtp_out_of_order_packet_ratio", 100.0),
    ("RTP interarrival p05 ms", "interarrival_p05_ms", 1.0), ("RTP interarrival mean ms", "interarrival_mean_ms", 1.0),
    ("RTP interarrival p95 ms", "interarrival_p95_ms", 1.0), ("RTP interarrival max ms", "interarrival_max_ms", 1.0),
    ("Trusted RTP lost packets", "lost_packets", 1.0), ("Trusted RTP duplicate packets", "duplicate_packets", 1.0),
    ("Trusted RTP out-of-order packets", "out_of_order_packets", 1.0), ("Trusted RTP packets", "rtp_packet_count", 1.0),
    ("Total packets", "packet_count", 1.0)]


def control_test_deltas(device_view: DataFrame) -> DataFrame:
    wide = pivot_roles(device_view, [], "device_role", ["control", "test"], [m[1] for m in DELTA_METRICS])
    return control_test_delta(wide, DELTA_METRICS)


def capture_inventory(captures: DataFrame, samples: DataFrame) -> DataFrame:
    roles = string_list(samples.filter(c("effective_device_role").isNotNull()), ["capture_id"], "effective_device_role", out="device_roles")
    return captures.join(roles, "capture_id", "left").withColumn("device_roles", F.coalesce("device_roles", F.lit("unmapped")))


def capture_sessions(sessions: DataFrame, attempts: DataFrame, events: DataFrame, legs: DataFrame) -> DataFrame:
    """Sessions with attempt, event and leg counts and the latest resolved group."""
    sid = c("capture_session_id").alias("session_id")
    ota = c("leg_type") == "ap_client_ota"
    leg = legs.groupBy(sid).agg(rows_n().alias("leg_count"), count_where(ota).alias("ap_ota_leg_count"),
                                count_where(ota & c("leg_state").isin(READY_LEG_STATES)).alias("ready_ap_ota_leg_count"))
    att = attempts.groupBy(sid).agg(rows_n().alias("attempt_count"), *_audio_counts())
    ev = events.groupBy(sid).agg(rows_n().alias("event_count"), F.max("event_time").alias("latest_event_time"))
    resolved = attempts.filter(c("resolved_group_ip").isNotNull()).withColumnRenamed("capture_session_id", "session_id")
    at = F.coalesce("active_group_selected_at", "attempt_started_at", "started_at", "created_at")
    take = {"latest_resolved_attempt_id": "attempt_id", "latest_resolved_group_ip": "resolved_group_ip", "latest_resolved_group_vlan": "resolved_group_vlan",
            "latest_resolved_mgid": "resolved_mgid", "latest_resolved_vlan_context_state": "vlan_context_state", "latest_resolved_at": "active_group_selected_at"}
    d = latest_child(sessions.join(leg, "session_id", "left").join(att, "session_id", "left").join(ev, "session_id", "left"), resolved, ["session_id"],
                     [at, c("attempt_id")], take)
    return zero_fill(d, ["leg_count", "ap_ota_leg_count", "ready_ap_ota_leg_count", "attempt_count", "heard_attempt_count", "missed_attempt_count",
                         "degraded_attempt_count", "event_count"])


def _audio_counts() -> list[Column]:
    r = c("audio_result")
    return [count_where(r == "heard").alias("heard_attempt_count"), count_where(r == "missed").alias("missed_attempt_count"),
            count_where(r.isin("partial", "choppy")).alias("degraded_attempt_count")]


def passthrough(table: DataFrame) -> DataFrame:
    """Legs, session events, artifacts, findings and observations are shown as stored."""
    return table


capture_legs = capture_session_events = attempt_artifacts = attempt_findings = multicast_observations = passthrough


def broadcast_attempts(attempts: DataFrame, sessions: DataFrame, artifacts: DataFrame, snapshots: DataFrame, findings: DataFrame) -> DataFrame:
    during = c("phase") == "during"
    cols = ["receiver_ap", "receiver_bssid", "receiver_channel", "receiver_band", "receiver_rssi", "receiver_snr", "receiver_group_status", "mgid"]
    art = artifacts.groupBy("attempt_id").agg(rows_n().alias("artifact_count"), count_where(c("artifact_type").isin(CAPTURE_FILE_TYPES)).alias("pcap_artifact_count"))
    snap = snapshots.groupBy("attempt_id").agg(
        rows_n().alias("snapshot_count"), *[F.max(F.when(during, c(x))).alias(x) for x in cols],
        F.bool_or(F.when(during, c("receiver_group_member"))).alias("snapshot_receiver_group_member"))
    find = findings.groupBy("attempt_id").agg(count_where(c("severity") == "critical").alias("critical_finding_count"),
                                              count_where(c("severity") == "warning").alias("warning_finding_count"))
    ses = sessions.select(c("session_id").alias("capture_session_id"), "capture_name", "wlc_interface", "session_state")
    d = attempts.join(ses, "capture_session_id", "left").join(art, "attempt_id", "left").join(snap, "attempt_id", "left").join(find, "attempt_id", "left")
    return zero_fill(d, ["artifact_count", "pcap_artifact_count", "snapshot_count", "critical_finding_count", "warning_finding_count"])


def group_explorer(observations: DataFrame) -> DataFrame:
    """Per multicast group: when and where it was seen. Sets are gathered into cells; ``group_members`` is the long form."""
    d = observations.filter(c("group_ip").isNotNull())
    return d.groupBy("group_ip", "group_mac").agg(
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), *[set_sorted(col).alias(kind) for col, kind in GROUP_SETS.items()],
        F.bool_or("receiver_member").alias("receiver_membership_seen"), F.max("capture_confidence").alias("capture_confidence"), rows_n().alias("observation_count"))


GROUP_SETS = {"source_ip": "source_ips", "vlan": "vlans", "mgid": "mgids", "attempt_id": "associated_attempts", "ap_name": "aps_involved", "evidence_source": "evidence_sources"}


def group_members(observations: DataFrame) -> DataFrame:
    """The sets of ``group_explorer`` as rows, for groups of any size: (group_ip, group_mac, kind, member, observation_count, first_seen, last_seen).

    ``kind`` names the set, ``member`` is its value as text. Observations without a group and null members have no row.
    """
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), c(col).cast("string").alias("member")) for col, kind in GROUP_SETS.items()]),
                              lambda x: x["member"].isNotNull())).alias("_m")
    d = observations.filter(c("group_ip").isNotNull()).select("group_ip", "group_mac", "observed_at", each)
    return d.groupBy("group_ip", "group_mac", c("_m.kind").alias("kind"), c("_m.member").alias("member")).agg(
        rows_n().alias("observation_count"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def attempt_timeline(attempts: DataFrame, events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Starts, session events and snapshots of attempts as one long table."""
    a = attempts.filter(c("started_at").isNotNull()).select("attempt_id", "study_id", c("started_at").alias("event_time"), F.lit("attempt_started").alias("event_kind"),
                                                            c("verdict").alias("event_value"), c("raw_context").alias("event_context"))
    e = events.select(F.coalesce("attempt_id", "event_id").alias("attempt_id"), "study_id", "event_time", F.concat(F.lit("session_"), "event_kind").alias("event_kind"),
                      F.coalesce("audio_result", "notes", "event_kind").alias("event_value"), c("raw_context").alias("event_context"))
    fields = ["receiver_group_member", "receiver_ap", "receiver_bssid", "receiver_channel", "receiver_rssi", "receiver_snr", "group_ip", "mgid"]
    s = snapshots.select("attempt_id", F.lit(None).cast(dict(a.dtypes)["study_id"]).alias("study_id"), F.lit(None).cast("timestamp").alias("event_time"),
                         F.concat(F.lit("wlc_snapshot_"), F.coalesce("phase", F.lit("unknown"))).alias("event_kind"),
                         F.coalesce("receiver_ap", "group_ip", "receiver_group_status").alias("event_value"), json_build(**{f: c(f) for f in fields}).alias("event_context"))
    return a.unionByName(e).unionByName(s)


ATTEMPT_KEYS = ["study_id", "capture_session_id", "attempt_id", "attempt_marked_at", "audio_result", "configured_vlan", "resolved_group_vlan",
                "vlan_context_state", "verdict", "verdict_confidence"]


def attempt_matrix(attempts: DataFrame, observations: DataFrame) -> DataFrame:
    """Each attempt with the extremes and sets of its observations."""
    maxes = ["group_ip", "group_mac", "vlan", "mgid", "receiver_membership_mode", "ap_delivery_mode", "ap_tx_packets", "ap_rx_packets"]
    g = observations.groupBy("attempt_id").agg(
        *[F.max(m).alias(m) for m in maxes], F.bool_or("receiver_member").alias("receiver_member_seen"),
        F.bool_or("receiver_blocklisted").alias("receiver_blocklisted_seen"), set_sorted("evidence_source").alias("evidence_sources"))
    d = attempts.select(*ATTEMPT_KEYS).join(g, "attempt_id", "left")
    return d.withColumn("evidence_sources", F.coalesce("evidence_sources", F.array().cast("array<string>")))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    v = c("verdict")
    return attempts.groupBy("study_id", "capture_session_id").agg(
        rows_n().alias("attempt_count"), *_audio_counts(), count_where(v == "membership_failure").alias("membership_failure_count"),
        count_where(v == "media_degraded").alias("media_degraded_count"), count_where(v == "inconclusive").alias("inconclusive_count"),
        F.min("started_at").alias("first_attempt_at"), F.max("started_at").alias("latest_attempt_at"))


def attempt_ap_distribution(attempts: DataFrame, snapshots: DataFrame) -> DataFrame:
    s = snapshots.filter(c("phase") == "during").select("attempt_id", "receiver_ap", "receiver_channel", "receiver_band")
    d = attempts.select("attempt_id", "study_id", "audio_result", "verdict").join(s, "attempt_id")
    return d.groupBy("study_id", "receiver_ap", "receiver_channel", "receiver_band").agg(
        rows_n().alias("attempt_count"), count_where(c("audio_result") == "missed").alias("missed_audio_count"),
        count_where(c("verdict") == "membership_failure").alias("membership_failure_count"))

