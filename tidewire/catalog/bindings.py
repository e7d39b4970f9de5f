"""Domain tables derived from the input tables.

Each is one SELECT in the SQL that Spark and the checking database share, so both
sides of a comparison start from the same rows: captures from orders, streams
from lineitem, studies from customer, projects from nation, series from events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidewire.tables import SCHEMAS, Tables

SELECTS = {
    "streams": """
        select
          cast(l_orderkey as string) || ':' || cast(l_linenumber as string) || ':' || cast(l_partkey as string)
            || ':' || cast(l_suppkey as string) as stream_id,
          l_orderkey as capture_id,
          case when l_linestatus = 'O' then 'rtp' when l_tax > 0.05 then 'rtp_candidate_rejected'
               when l_tax > 0.02 then 'udp_interarrival_only' else 'unknown_udp' end as measurement_mode,
          case l_returnflag when 'A' then 'control' when 'R' then 'test' else 'unmapped' end as device_role,
          case when l_returnflag = 'N' then 'unmapped' else 'dev-' || cast(l_linenumber as string) end as device_name,
          case when l_returnflag = 'N' then 'unmapped' else 'cfg-' || l_linestatus end as device_config,
          '10.0.' || cast(l_linenumber as string) || '.' || cast(l_suppkey % 200 as string) as src_ip,
          '10.9.0.' || cast(l_partkey % 200 as string) as dst_ip,
          cast(20000 + l_partkey % 1000 as int) as src_port,
          cast(30000 + l_suppkey as int) as dst_port,
          l_partkey as ssrc,
          cast(case when l_linenumber <= 2 then 0 when l_linenumber <= 4 then 8 else 96 + l_linenumber end as int) as payload_type,
          cast(case when l_discount > 0.05 then 46 else 0 end as int) as dscp,
          cast(l_quantity as bigint) as packet_count,
          cast(floor(l_extendedprice) as bigint) as byte_count,
          cast(l_quantity as bigint) + cast(round(l_discount * 100) as bigint) as expected_packets,
          case when l_linenumber = 7 then null else cast(round(l_discount * 100) as bigint) end as lost_packets,
          case when l_linenumber = 7 then null else l_discount end as loss_ratio,
          cast(round(l_tax * 100) as bigint) as duplicate_packets,
          cast(l_linenumber as bigint) as out_of_order_packets,
          case when l_linenumber = 6 then null else l_tax * 500 end as jitter_ms,
          l_quantity / 2 as interarrival_p50_ms,
          l_quantity as interarrival_p95_ms,
          l_extendedprice / 1000 as interarrival_max_ms,
          l_discount < 0.02 as dscp_mismatch,
          case when l_tax < 0.02 then true when l_tax > 0.07 then false else null end as accepted,
          case when l_linenumber = 1 then 'accepted' when l_linenumber = 2 then 'excluded'
               when l_linenumber = 3 then 'needs_review' when l_linenumber = 4 then null else 'unreviewed' end as review_status,
          case when l_suppkey % 10 = 0 then 'noise' when l_suppkey % 10 = 1 then 'voice' else '' end as stream_classification,
          l_shipdate as sample_time,
          l_suppkey as server_key,
          l_partkey as part_key
        from {lineitem}""",
    "captures": """
        select
          o_orderkey as capture_id,
          o_custkey as study_id,
          'cap_' || cast(o_orderkey as string) || '.pcap' as source_name,
          '/in/' || o_orderpriority || '/cap_' || cast(o_custkey as string) || '.pcap' as source_path,
          cast(floor(o_totalprice) as bigint) as source_size_bytes,
          case when o_orderpriority = '1-URGENT' then 'sha' || cast(o_custkey % 50 as string)
               when o_orderpriority = '2-HIGH' then '' else null end as source_sha256,
          cast(o_orderkey as bigint) as source_mtime_ns,
          case when o_orderpriority = '4-NOT SPECIFIED' then null else o_orderdate end as capture_time,
          o_orderdate as parsed_at,
          'site' || substr(o_orderpriority, 1, 1) as site,
          'cp' || o_orderstatus as capture_point,
          case o_orderstatus when 'F' then 'complete' when 'O' then 'registered' else 'failed' end as capture_status,
          case when o_orderstatus = 'F' then o_orderpriority <> '3-MEDIUM' when o_orderstatus = 'O' then null else false end as parse_success,
          cast(case when o_orderstatus = 'F' then 0 when o_orderstatus = 'P' then 2 else null end as int) as parse_exit_code,
          cast(case when o_orderstatus = 'P' then 'bad header' else null end as string) as parse_error,
          cast(floor(o_totalprice / 100) as bigint) as packets_read,
          cast(floor(o_totalprice / 200) as bigint) as udp_packets_seen,
          cast(case when o_orderpriority = '5-LOW' then o_orderdate else null end as timestamp) as deleted_at
        from {orders}""",
    "studies": """
        select c_custkey as study_id, c_nationkey as project_id, c_name as study_name,
          case when c_acctbal > 5000 then 'closed' else 'active' end as study_status,
          case when c_mktsegment = 'MACHINERY' then 'rf' else 'media_qoe' end as study_type,
          case when c_mktsegment = 'MACHINERY' then 'badge' else 'media_qoe' end as study_scope,
          cast('2024-01-01 00:00:00' as timestamp) as created_at,
          cast('2024-02-01 00:00:00' as timestamp) as updated_at,
          cast(case when c_acctbal < 0 then '2024-03-01 00:00:00' else null end as timestamp) as deleted_at
        from {customer}""",
    "projects": """
        select n_nationkey as project_id, n_name as project_name,
          case when n_regionkey = 0 then 'rf' when n_regionkey = 1 then 'mixed' else 'media_qoe' end as project_type,
          'about ' || n_name as description, 'site' || cast(n_regionkey as string) as site,
          cast('2024-01-01 00:00:00' as timestamp) as created_at, cast('2024-02-01 00:00:00' as timestamp) as updated_at,
          cast(case when n_nationkey = 24 then '2024-03-01 00:00:00' else null end as timestamp) as deleted_at
        from {nation}""",
    "parse_runs": """
        select o_orderkey as parse_run_id, case when o_orderstatus = 'P' then null else o_custkey end as study_id,
          case when o_orderpriority = '2-HIGH' then null else o_orderkey end as capture_id, o_orderdate as started_at, o_orderstatus as status
        from {orders}""",
    "sessions": """
        select c_custkey as session_id, c_nationkey as study_id, c_name as capture_name, 'if' || cast(c_nationkey as string) as wlc_interface,
          case when c_acctbal > 3000 then 'stopped' else 'running' end as session_state
        from {customer}""",
    "attempts": """
        select o_orderkey as attempt_id, o_custkey as capture_session_id, o_custkey % 25 as study_id,
          case when o_orderpriority = '5-LOW' then null else o_orderdate end as started_at,
          o_orderdate as attempt_started_at, o_orderdate as created_at, o_orderdate as attempt_marked_at,
          cast(case when o_orderstatus = 'F' then o_orderdate else null end as timestamp) as active_group_selected_at,
          case o_orderpriority when '1-URGENT' then 'heard' when '2-HIGH' then 'missed' when '3-MEDIUM' then 'partial'
            when '4-NOT SPECIFIED' then 'choppy' else 'unknown' end as audio_result,
          case when o_custkey % 4 = 0 then null else '230.230.1.' || cast(o_custkey % 200 as string) end as resolved_group_ip,
          cast(o_custkey % 9 as int) as resolved_group_vlan, cast(o_custkey % 7 as int) as configured_vlan, o_custkey % 4096 as resolved_mgid,
          case when o_custkey % 9 = o_custkey % 7 then 'resolved_confirmed' else 'configured_group_mismatch' end as vlan_context_state,
          case o_orderstatus when 'F' then 'membership_failure' when 'O' then 'media_degraded' else 'inconclusive' end as verdict,
          case o_orderstatus when 'F' then 'high' else 'low' end as verdict_confidence,
          'ctx' || cast(o_orderkey as string) as raw_context
        from {orders}""",
    "session_events": """
        select event_id, user_id as capture_session_id, user_id % 25 as study_id, case when value > 30 then null else event_id % 1000 end as attempt_id,
          ts as event_time, event_type as event_kind, case when event_type = 'click' then 'heard' else null end as audio_result,
          case when event_type = 'view' then 'seen' else null end as notes, props as raw_context
        from {events}""",
    "legs": """
        select l_suppkey as capture_session_id, case when l_returnflag = 'A' then 'ap_client_ota' else 'wlc_epc' end as leg_type,
          case l_linenumber when 1 then 'ready' when 2 then 'running' when 3 then 'parsed' else 'draft' end as leg_state
        from {lineitem}""",
    "artifacts": """
        select l_orderkey as attempt_id, case l_linenumber when 1 then 'wlc_epc' when 2 then 'ap_packet_capture' else 'transcript' end as artifact_type
        from {lineitem}""",
    "snapshots": """
        select l_orderkey as attempt_id, l_linenumber as snapshot_no,
          case l_returnflag when 'A' then 'during' when 'R' then 'after' else null end as phase,
          case when l_suppkey % 3 = 0 then null else 'ap' || cast(l_suppkey as string) end as receiver_ap, 'b' || cast(l_suppkey as string) as receiver_bssid,
          cast(l_linenumber * 4 + 32 as int) as receiver_channel, case when l_linenumber > 3 then '5ghz' else '24ghz' end as receiver_band,
          cast(-l_quantity as int) as receiver_rssi, cast(l_quantity as int) as receiver_snr,
          case when l_tax < 0.03 then true when l_tax > 0.06 then false else null end as receiver_group_member,
          case when l_linestatus = 'O' then 'ok' else 'none' end as receiver_group_status,
          case when l_linestatus = 'O' then '230.230.0.' || cast(l_linenumber as string) else null end as group_ip, l_partkey as mgid
        from {lineitem}""",
    "findings": """
        select l_orderkey as attempt_id, case when l_discount > 0.07 then 'critical' when l_discount > 0.03 then 'warning' else 'info' end as severity
        from {lineitem}""",
    "observations": """
        select case when l_tax = 0 then null else l_orderkey end as attempt_id,
          case when l_suppkey % 11 = 0 then null else '230.230.0.' || cast(l_suppkey % 40 as string) end as group_ip,
          'm' || cast(l_suppkey % 40 as string) as group_mac, case when l_linenumber = 7 then null else '10.1.1.' || cast(l_linenumber as string) end as source_ip,
          cast(l_linenumber * 10 as int) as vlan, cast(l_suppkey % 5 as int) as mgid, l_shipdate as observed_at,
          case when l_linestatus = 'O' then l_quantity > 40 else null end as receiver_member, l_quantity > 48 as receiver_blocklisted,
          case when l_linenumber < 4 then 'static' else 'igmp' end as receiver_membership_mode, case when l_returnflag = 'A' then 'unicast' else 'multicast' end as ap_delivery_mode,
          cast(l_quantity as bigint) as ap_tx_packets, cast(l_linenumber as bigint) as ap_rx_packets, 'ap' || cast(l_suppkey % 7 as string) as ap_name,
          case when l_returnflag = 'N' then 'wlc_cli' else 'pcap' end as evidence_source, case when l_linenumber > 5 then 'low' else 'medium' end as capture_confidence
        from {lineitem}""",
    "x_projects": """
        select r_regionkey as project_id, r_name as project_name, 'mixed' as project_type, 'all of ' || r_name as description, 'hq' as site,
          cast('2024-01-01 00:00:00' as timestamp) as created_at, cast('2024-01-02 00:00:00' as timestamp) as updated_at,
          cast(case when r_regionkey = 4 then '2024-03-01 00:00:00' else null end as timestamp) as deleted_at
        from {region}""",
    "x_studies": """
        select n_nationkey as study_id, n_regionkey as project_id, n_name as study_name, 'rf' as study_type, case when n_nationkey % 2 = 0 then 'open' else 'closed' end as study_status,
          case when n_nationkey % 3 = 0 then null else 'badge' end as study_scope, cast('2024-01-01 00:00:00' as timestamp) as created_at,
          cast(case when n_nationkey % 12 = 5 then '2024-03-01 00:00:00' else null end as timestamp) as deleted_at
        from {nation}""",
    "x_runs": """
        select case when c_custkey % 3 = 0 then 'ipad_' else 'run_' end || cast(c_custkey as string) as test_run_id, c_nationkey as study_id,
          case when c_acctbal > 1000 then c_name else null end as run_name, case when c_acctbal > 5000 then 'executed' else null end as run_status,
          case when c_mktsegment = 'FURNITURE' then 'n1' else null end as run_notes, case when c_mktsegment = 'MACHINERY' then 'n2' else null end as notes,
          case when c_nationkey % 2 = 0 then 'America/Chicago' else 'Asia/Tokyo' end as timezone, cast(c_custkey % 5 * 900 + 60 as bigint) as default_match_window_seconds,
          cast('2024-01-01 00:00:00' as timestamp) as created_at, cast(case when c_acctbal < 0 then '2024-03-01 00:00:00' else null end as timestamp) as deleted_at
        from {customer}""",
    "x_events": """
        select event_id, case when user_id % 3 = 0 then 'ipad_' else 'run_' end || cast(user_id as string) as test_run_id, ts as event_time from {events} where event_type = 'click'""",
    "x_points": """
        select event_id as point_id, case when user_id % 3 = 0 then 'ipad_' else 'run_' end || cast(user_id as string) as test_run_id, ts as measured_at from {events} where event_type = 'view'""",
    "x_candidates": """
        select l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey as id, case when l_suppkey % 3 = 0 then 'ipad_' else 'run_' end || cast(l_suppkey as string) as test_run_id,
          date_trunc('month', l_shipdate) as survey_time, case when l_linenumber > 3 then 'AA:' else 'aa:' end || cast(l_partkey % 50 as string) as bssid, l_quantity > 40 as badge_selected,
          case when l_linenumber = 2 then null else l_discount end as badge_score, -l_quantity as badge_rssi_dbm,
          case when l_returnflag = 'A' then 'pending' else 'complete' end as manual_entry_status
        from {lineitem}""",
    "x_matches": """
        select l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey as id, l_orderkey as observation_id,
          case when l_suppkey % 3 = 0 then 'ipad_' else 'run_' end || cast(l_suppkey as string) as test_run_id, date_trunc('year', l_shipdate) as survey_time,
          case when l_linenumber > 3 then 'AA:' else 'aa:' end || cast(l_partkey % 5 as string) as bssid, 'ap' || cast(l_partkey % 50 as string) as ap_name,
          cast(case when l_linenumber = 7 then null else l_linenumber * 4 + 32 end as int) as channel,
          case when l_linenumber = 1 then '2.4GHz' when l_linenumber = 2 then null when l_linenumber = 3 then '' else '5GHz' end as band,
          case when l_returnflag = 'A' then 'F1' when l_returnflag = 'R' then 'F2' else null end as floor,
          case when l_discount = 0 then null else 'mac' || cast(l_suppkey % 3 as string) end as badge_mac, -floor(l_quantity / 10) * 10e0 as badge_rssi_dbm, case when l_tax > 0.04 then -40e0 else -60e0 end as survey_rssi_dbm,
          l_quantity - l_tax * 1000 as calibrated_delta_db, abs(l_quantity - l_tax * 1000) as absolute_calibrated_delta_db,
          case when l_quantity > 20 then 'exact_1s' else 'close_5s' end as match_quality,
          case when l_linestatus = 'O' then 'complete' when l_tax > 0.04 then 'missing_vendor_offset' else 'pending' end as manual_entry_status, l_shipdate as created_at
        from {lineitem}""",
    "x_observations": """
        select o_orderkey as id, case when o_custkey % 3 = 0 then 'ipad_' else 'run_' end || cast(o_custkey as string) as test_run_id,
          case when o_orderstatus = 'F' then 'note' || cast(o_orderkey as string) else null end as notes, 'user' || cast(o_custkey % 5 as string) as entered_by,
          cast(case when o_orderpriority = '1-URGENT' then null else o_orderdate end as timestamp) as created_at
        from {orders}""",
    "x_files": """
        select p_partkey as input_file_id, 'badge' as study_scope, p_type as source_type, '/in/' || cast(p_partkey as string) as file_path,
          case when p_size > 30 then p_name else null end as display_name, case when p_size > 10 then p_brand else null end as file_name, p_size < 45 as is_available, p_name as notes
        from {part}""",
    "x_run_files": """
        select l_partkey as input_file_id, case when l_suppkey % 3 = 0 then 'ipad_' else 'run_' end || cast(l_suppkey as string) as test_run_id, l_shipdate as selected_at,
          case l_linenumber when 1 then 'badge_log' when 2 then 'survey_json' when 3 then 'manual_csv' when 4 then 'client_detail' else 'other' end as source_role
        from {lineitem}""",
    "x_archives": """
        select s_suppkey as archive_id, case when s_nationkey % 2 = 0 then 'badge' else 'ipad' end as study_scope,
          case when s_nationkey % 5 = 0 then 'Checkpoint before restoring x' when s_nationkey % 5 = 1 then null else s_name end as archive_label,
          cast('2024-01-01 00:00:00' as timestamp) as archived_at,
          case when s_nationkey % 3 = 0 then '{{"combined_from": [1, 2, 3]}}' else '{{"tables": 4}}' end as payload
        from {supplier}""",
    "x_meta": """
        select case when n_nationkey = 0 then 'badge' else 'elsewhere' || cast(n_nationkey as string) end as study_scope, n_name as study_name from {nation}""",
    "x_manual_samples": """
        select o_orderkey as sample_id, o_custkey % 30 as study_id, o_orderpriority as label, -(o_totalprice / 10000) as survey_rssi_dbm, o_orderdate as created_at from {orders}""",
}


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", SELECTS[name])


def frame(t: Tables, name: str) -> DataFrame:
    """A derived table (or an input table) as a DataFrame."""
    if name in SCHEMAS:
        return getattr(t, name)
    args = {n: frame(t, n) for n in _needs(name)}
    return t.spark.sql(SELECTS[name], **args)


def ctes(*names: str) -> str:
    """The same derived tables as a WITH prefix for the checking database."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in SCHEMAS or name in done:
            return
        for n in _needs(name):
            add(n)
        done[name] = SELECTS[name].format(**{n: n for n in _needs(name)})

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in done.items()) + "\n"
