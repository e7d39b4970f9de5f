"""Recording rules: a table of named vector computations, run in order at one instant.

A rule is a function of an evaluator ``e``; later rules read earlier results by
name. The input of a run is one instant vector per raw metric, computed once and
shared. Results that several rules read are written once, so no rule recomputes
another's inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators import timeseries as T
from tidewire.operators.setops import union_all
from tidewire.session import checkpointed

# Label sets.
AP = ["wlc", "ap_name", "site_tag", "policy_tag", "rf_tag", "slot_id", "band", "client_generation"]
AP_AC = [*AP[:7], "access_category", "client_generation"]
SITE = ["wlc", "site_tag", "band"]
RF = ["wlc", "ap_name", "site_tag", "policy_tag", "rf_tag", "band", "source", "channel_family"]
CLIENT = ["wlc", "ssid", "site_tag", "band", "device_group", "badge_model", "client_mac"]
CLIENT_LABELS = CLIENT[:6]
COHORT = CLIENT[:5]
AP_INFO = ["ap_name", "site_tag", "policy_tag", "rf_tag", "model", "ap_location"]
RADIO = ["source", "ap_mac", "ap_name", "site_tag", "policy_tag", "rf_tag", "slot_id", "model", "ap_location"]
PROCESS = ["source", "subscription", "chassis", "chassis_state", "high_availability_state", "slot", "bay", "fru", "control_process_status"]
LOAD = ["load_average_stats_load_average_status", "load_avg_minutes_load_avg_minute_status_condition",
        "load_avg_minutes_load_avg_minute_status_threshold_status"]

# Raw metric names of the controller's telemetry, by their common prefixes.
CLI_AC = "wireless_ap_ac_latency_"
CLIENT_OPER = "Cisco_IOS_XE_wireless_client_oper:client_oper_data_"
AP_OPER = "Cisco_IOS_XE_wireless_access_point_oper:access_point_oper_data_"
PLATFORM_OPER = "Cisco_IOS_XE_platform_software_oper:cisco_platform_software_control_processes_control_process_"
CPU_OPER = "Cisco_IOS_XE_process_cpu_oper:cpu_usage_cpu_utilization_one_minute"
CLIENT_SSID = CLIENT_OPER + "dot11_oper_data_dot11k_rm_beacon_meas_req_parameters_current_ssid"
RUN_LATENCY = CLIENT_OPER + "mm_if_client_history_mobility_history_entry_run_latency"
FRESH_SECONDS = 4500


@dataclass(frozen=True)
class Settings:
    """Deployment names that the rules put into labels."""
    voice_ssid: str = "voice"
    device_group: str = "badge"


Rule = tuple[str, Callable]


def ap_voice_latency(s: Settings) -> list[Rule]:
    p = "wireless_ap_voice_latency_"
    voice = ("access_category", "=", "voice")

    def avg(e):
        return e.gt(e.m(CLI_AC + "avg_us_cli", voice), 0)

    def active(e):
        return e.gt(e.m(CLI_AC + "active_clients_cli", voice), 0)

    def fresh(e):
        return e.lt(e.age(e.m(CLI_AC + "sample_end_timestamp_seconds", voice)), FRESH_SECONDS)

    def weighted(by):
        return lambda e: e.op(e.agg(e.op(e.m(p + "avg_ms"), "*", e.m(p + "packets"), AP), "sum", by), "/", e.agg(e.m(p + "packets"), "sum", by))

    def by_site(how):
        return lambda e: e.agg(e.m(p + "avg_ms"), how, SITE)

    def ap_quantile(q):
        return lambda e: e.quantile(e.m(p + "packet_weighted_mean_ms_by_ap"), q, SITE)

    def bound(sign):
        return lambda e: e.op(e.m(p + "mean_ms_by_site"), sign, e.scale(e.m(p + "sem_ms_by_site"), 1.96))

    return [
        (p + "avg_us", lambda e: e.agg(e.both(e.both(avg(e), active(e), AP_AC), fresh(e), AP_AC), "max", AP)),
        (p + "avg_ms", lambda e: e.scale(e.m(p + "avg_us"), 0.001)),
        (p + "active_clients", lambda e: e.agg(e.both(e.both(active(e), avg(e), AP_AC), fresh(e), AP_AC), "max", AP)),
        (p + "fresh_sample", fresh),
        (p + "avg_ms_fresh", lambda e: e.m(p + "avg_ms")),
        (p + "p95_ms_by_site", lambda e: e.quantile(e.m(p + "avg_ms"), 0.95, SITE)),
        (p + "packets", lambda e: e.both(e.agg(e.gt(e.m(CLI_AC + "packets_cli", voice), 0), "sum", AP), e.m(p + "avg_ms"), AP)),
        (p + "packets_fresh", lambda e: e.m(p + "packets")),
        (p + "packet_weighted_mean_ms_by_site", weighted(SITE)),
        (p + "packet_weighted_mean_ms_by_ap", weighted(["wlc", "ap_name", "site_tag", "band"])),
        (p + "packet_weighted_mean_ms_median_by_site", ap_quantile(0.5)),
        (p + "packet_weighted_mean_ms_p05_by_site", ap_quantile(0.05)),
        (p + "packet_weighted_mean_ms_p95_by_site", ap_quantile(0.95)),
        (p + "ranked_ms", lambda e: e.agg(e.m(p + "avg_ms"), "max", AP)),
        (p + "sample_count_by_site", lambda e: e.agg(e.agg(e.both(avg(e), active(e), AP_AC), "max", AP), "count", SITE)),
        (p + "fresh_sample_count_by_site", by_site("count")),
        (p + "stale_sample_count_by_site", lambda e: e.agg(e.agg(e.unless(e.both(avg(e), active(e), AP_AC), fresh(e), AP_AC), "max", AP), "count", SITE)),
        (p + "mean_ms_by_site", by_site("avg")),
        (p + "stddev_ms_by_site", by_site("stddev")),
        (p + "sem_ms_by_site", lambda e: e.op(e.m(p + "stddev_ms_by_site"), "/", e.sqrt(e.m(p + "fresh_sample_count_by_site")))),
        (p + "ci95_low_ms_by_site", bound("-")),
        (p + "ci95_high_ms_by_site", bound("+")),
        (p + "very_high_packets", lambda e: e.agg(e.both(e.gt(e.m(CLI_AC + "packets_cli", voice, ("latency_level", "=", "very_high")), 0), e.m(p + "avg_ms"), AP),
                                                  "sum", ["wlc", "ap_name", "site_tag", "slot_id", "band", "client_generation"])),
    ]


def badge_client(s: Settings) -> list[Rule]:
    p = "wireless_badge_client_"
    identity = p + "mdt_identity"
    on = ["source", "client_mac"]

    def carrier(e, *more, **fixed):
        v = e.m(CLIENT_SSID, ("vap_ssid", "=", s.voice_ssid), *more)
        named = {"site_tag": s.voice_ssid, "band": "all", "device_group": s.device_group, "badge_model": "unknown", **fixed}
        return e.const(e.relabel(v, {"client_mac": "ms_mac_address", "wlc": "source", "ssid": "vap_ssid"}, named), 1.0)

    def ft(e, op, state):
        return e.agg(carrier(e, ("ms_wifi_auth_key_mgmt", op, ".*ft.*"), ("ms_wifi_auth_key_mgmt", "!=", ""), ft_state=state), "max", [*CLIENT, "ft_state"])

    def ft_all(e):
        # a client without a key-management label still passes the negative match, but has no state to copy
        return e.either(ft(e, "=~", "ft"), e.either(ft(e, "!~", "non_ft"), e.agg(carrier(e, ("ms_wifi_auth_key_mgmt", "=", "")), "max", [*CLIENT, "ft_state"])))

    def with_mac(e, v):
        return e.relabel(v, {"client_mac": "ms_mac_address"})

    def enriched(e, v):
        return e.agg(e.enrich(v, e.m(identity), on, CLIENT_LABELS), "max", CLIENT)

    def counter(name):
        return lambda e: enriched(e, e.agg(with_mac(e, e.clamp(e.increase(CLIENT_OPER + "traffic_stats_" + name, 300), 0)), "sum", on))

    def gauge(name):
        return lambda e: enriched(e, with_mac(e, e.m(CLIENT_OPER + "traffic_stats_most_recent_" + name)))

    def zero(e):
        return e.scale(e.m(identity), 0.0)

    def alias(name):
        return lambda e: e.m(p + name)

    def q(name, quantile=0.95):
        return lambda e: e.quantile(e.m(p + name), quantile, COHORT)

    def present(e):
        return e.agg(e.agg(e.m(p + "present_cc"), "max", [*COHORT, "client_mac"]), "count", COHORT)

    def current_ap(e):
        ap = e.top1(e.agg(e.m(CLIENT_OPER + "common_oper_data_ms_ap_slot_id", ("co_state", "=", "client-status-run")), "max", [*on, "ap_name"]), on)
        return e.agg(e.enrich(e.enrich(e.m(identity), ap, on, ["ap_name"]), e.m(p + "ft_state"), CLIENT, ["ft_state"]), "max", [*CLIENT, "ap_name", "ft_state"])

    def retry_avg(e):
        attempts = e.agg(e.m(p + "tx_retry_attempts_5m"), "sum", COHORT)
        pct = e.op(e.scale(e.agg(e.m(p + "tx_retries_5m"), "sum", COHORT), 100), "/", e.clamp(attempts, 1))
        return e.both(pct, e.gt(attempts, 0), COHORT)

    def retry(e):
        attempts = e.m(p + "tx_retry_attempts_5m")
        return e.both(e.op(e.scale(e.m(p + "tx_retries_5m"), 100), "/", e.clamp(attempts, 1)), e.gt(attempts, 0), CLIENT)

    return [
        (identity, lambda e: e.agg(carrier(e), "max", ["source", "client_mac", *CLIENT_LABELS])),
        (p + "present", alias("mdt_identity")),
        (p + "ft_state", ft_all),
        (p + "current_ap_info", current_ap),
        (p + "rssi_dbm", gauge("rssi")),
        (p + "snr_db", gauge("snr")),
        (p + "tx_retries_5m", counter("data_retries")),
        (p + "tx_packets_5m", counter("pkts_rx")),
        (p + "tx_retry_attempts_5m", lambda e: e.op(e.m(p + "tx_packets_5m"), "+", e.m(p + "tx_retries_5m"))),
        (p + "tx_retry_pct", retry),
        (p + "rx_retries_5m", alias("tx_retries_5m")),
        (p + "rx_packets_5m", alias("tx_packets_5m")),
        (p + "rx_retry_attempts_5m", alias("tx_retry_attempts_5m")),
        (p + "rx_retry_pct", alias("tx_retry_pct")),
        (p + "run_state_latency_us", lambda e: enriched(e, e.scale(e.m(RUN_LATENCY), 1000))),
        (p + "max_roaming_duration_ms", lambda e: enriched(e, e.m(RUN_LATENCY))),
        (p + "average_auth_duration_ms", zero),
        (p + "average_assoc_duration_ms", zero),
        (p + "average_dhcp_duration_ms", zero),
        (p + "session_duration_s", zero),
        (p + "onboarding_attempts", lambda e: enriched(e, e.m(CLIENT_OPER + "mm_if_client_stats_mblty_stats_intra_wncd_roam_count"))),
        (p + "active_total", present),
        (p + "ft_adoption_ratio", lambda e: e.op(e.agg(e.m(p + "ft_state_cc", ("ft_state", "=", "ft")), "sum", COHORT), "/", e.clamp(present(e), 1))),
        (p + "run_state_latency_p95_us", q("run_state_latency_us")),
        (p + "tx_retry_pct_avg", retry_avg),
        (p + "tx_retry_pct_median", q("tx_retry_pct", 0.5)),
        (p + "tx_retry_pct_p05", q("tx_retry_pct", 0.05)),
        (p + "tx_retry_pct_p95", q("tx_retry_pct")),
        (p + "rx_retry_pct_avg", alias("tx_retry_pct_avg")),
        (p + "rx_retry_pct_median", alias("tx_retry_pct_median")),
        (p + "rx_retry_pct_p05", alias("tx_retry_pct_p05")),
        (p + "rx_retry_pct_p95", alias("tx_retry_pct_p95")),
        (p + "roam_duration_p95_ms", q("max_roaming_duration_ms")),
        (p + "auth_duration_p95_ms", q("average_auth_duration_ms")),
        (p + "assoc_duration_p95_ms", q("average_assoc_duration_ms")),
        (p + "dhcp_duration_p95_ms", q("average_dhcp_duration_ms")),
    ]


def rf_observability(s: Settings) -> list[Rule]:
    p = "wireless_ap_"
    info = p + "mdt_info"

    def cli(name, how="max"):
        return (p + name, lambda e: e.agg(e.m(f"{p}{name}_cli"), how, RF))

    def site(name, how, src):
        return (p + name, lambda e: e.agg(e.m(p + src), how, SITE))

    def enriched(e, v):
        return e.enrich(v, e.m(info), ["source", "ap_mac"], AP_INFO)

    def frames(name, src):
        return (f"{p}radio_{name}_5m", lambda e: e.agg(enriched(e, e.rate(f"{AP_OPER}radio_oper_stats_{src}", 300)), "sum", RADIO))

    def radio_gauge(name, src):
        return (f"{p}radio_{name}", lambda e: e.agg(enriched(e, e.m(f"{AP_OPER}radio_oper_stats_{src}")), "max", RADIO))

    def per_100(name, part, whole):
        return (f"{p}radio_{name}_5m", lambda e: e.op(e.scale(e.m(f"{p}radio_{part}_5m"), 100), "/", e.clamp(e.m(f"{p}radio_{whole}_5m"), 1)))

    def mdt_info(e):
        tags = {f"{t}_tag": f"tag_info_resolved_tag_info_resolved_{t}_tag" for t in ("site", "policy", "rf")}
        copies = {"ap_mac": "wtp_mac", "ap_name": "name", **tags, "model": "device_detail_static_info_ap_models_model",
                  "ap_location": "ap_location_location", "stationing_type": "ap_stationing_type"}
        v = e.m(AP_OPER + "capwap_data_device_detail_static_info_wtp_model_type")
        return e.agg(e.const(e.relabel(v, copies), 1.0), "max", ["source", "ap_mac", *AP_INFO, "stationing_type"])

    count = "neighbor_count"
    return [
        cli(count), site("neighbor_count_mean_by_site", "avg", count), site("neighbor_count_stddev_by_site", "stddev", count),
        site("neighbor_count_min_by_site", "min", count), site("neighbor_count_max_by_site", "max", count),
        cli("neighbor_rssi_mean_dbm"), cli("neighbor_strongest_rssi_dbm"), cli("neighbor_weakest_rssi_dbm", "min"),
        (p + "neighbor_high_rssi_total", lambda e: e.agg(e.m(p + "neighbor_high_rssi_total_cli"), "max", HIGH_RSSI)),
        cli("neighbor_unique_channels"), cli("current_channel"), cli("channel_width_mhz"), cli("receive_utilization_pct"),
        cli("transmit_utilization_pct"), cli("channel_utilization_pct"), cli("channel_is_dfs"),
        site("dfs_channel_count_by_site", "sum", "channel_is_dfs"),
        (p + "dfs_ap_on_dfs_ratio", lambda e: e.op(e.agg(e.m(p + "channel_is_dfs"), "sum", SITE), "/", e.clamp(e.agg(e.m(p + "channel_is_dfs"), "count", SITE), 1))),
        cli("dfs_cac_running"), site("dfs_cac_running_count_by_site", "sum", "dfs_cac_running"), cli("dfs_radar_changes_total"),
        (p + "dfs_radar_changes_24h", lambda e: e.increase(p + "dfs_radar_changes_total", 86400)),
        cli("zero_wait_dfs_enabled"), (info, mdt_info),
        frames("tx_frame_rate", "tx_frame_count"), frames("rx_frame_rate", "rx_data_frame_count"), frames("retry_rate", "retry_count"),
        frames("multiple_retry_rate", "multiple_retry_count"), frames("failed_frame_rate", "failed_count"),
        frames("fcs_error_rate", "fcs_error_count"), frames("rx_error_frame_rate", "rx_error_frame_count"),
        per_100("retry_per_100_tx", "retry_rate", "tx_frame_rate"), per_100("failure_per_100_tx", "failed_frame_rate", "tx_frame_rate"),
        per_100("fcs_per_100_rx", "fcs_error_rate", "rx_frame_rate"),
        radio_gauge("stuck_resets_total", "ap_radio_stats_num_radio_stuck_reset"), radio_gauge("noise_floor_dbm", "noise_floor"),
    ]


def control_plane(s: Settings) -> list[Rule]:
    p = "wireless_wlc_"
    memory, load = PLATFORM_OPER + "memory_stats_used_percent", PLATFORM_OPER + "load_avg_minutes_load_avg_minute_average"
    mem_status = "memory_stats_memory_status"

    def health(e):
        both = e.enrich(e.at_least_zero(e.m(memory)), e.at_least_zero(e.m(load)), PROCESS, LOAD)
        return e.agg(both, "min", [*PROCESS, mem_status, *LOAD])

    return [
        (p + "cpu_one_minute_pct", lambda e: e.agg(e.m(CPU_OPER), "max", ["source", "subscription"])),
        (p + "control_process_cpu_average_pct", lambda e: e.agg(e.m(PLATFORM_OPER + "per_core_stats_per_core_stat_cpu_average"), "max", PROCESS)),
        (p + "control_process_memory_used_pct", lambda e: e.agg(e.m(memory), "max", [*PROCESS, mem_status])),
        (p + "control_process_load_average", lambda e: e.agg(e.m(load), "max", [*PROCESS, *LOAD])),
        (p + "control_process_health", health),
    ]


def platform_health(s: Settings) -> list[Rule]:
    ns = ["namespace"]
    dep = ["namespace", "deployment"]
    queue = "prometheus_remote_storage_"

    def pods(e):
        return e.m("kube_pod_status_ready", ("condition", "=", "true"))

    def nodes(e):
        return e.m("kube_node_status_condition", ("condition", "=", "Ready"), ("status", "=", "true"))

    def ratio(vec, by):
        return lambda e: e.op(e.agg(vec(e), "sum", by), "/", e.clamp(e.agg(vec(e), "count", by), 1))

    def missing(vec, by):
        return lambda e: e.op(e.agg(vec(e), "count", by), "-", e.agg(vec(e), "sum", by))

    def replicas(kind):
        return lambda e: e.agg(e.m(f"kube_deployment_status_replicas_{kind}"), "sum", dep)

    def total_rate(name):
        return lambda e: e.agg(e.rate(name, 300), "sum", [])

    def first(*makers):
        def run(e):
            out = makers[0](e)
            for make in makers[1:]:
                out = e.either(out, make(e))
            return out
        return run

    def lag(name):
        return lambda e: e.age(e.agg(e.m(queue + name), "max", []))

    def both_spellings(name, how):
        return first(*[how(f"{x}_{name}") for x in ("cortex", "mimir")])

    def job_rate(name):
        return lambda e: e.agg(e.rate(name, 300), "sum", ["job"])

    def latency(name):
        return lambda e: e.bucket_quantile(e.agg(e.rate(name, 300), "sum", ["job", "le"]), 0.95)

    def total(name):
        return lambda e: e.agg(e.m(name), "sum", [])

    p = "platform_"
    return [
        (p + "target_up_ratio", lambda e: e.agg(e.m("up"), "avg", [])),
        (p + "alerts_firing_total", lambda e: e.or_zero(e.agg(e.m("ALERTS", ("alertstate", "=", "firing")), "sum", []))),
        (p + "kube_pod_ready_total", lambda e: e.agg(pods(e), "sum", ns)),
        (p + "kube_pod_ready_ratio", ratio(pods, ns)),
        (p + "kube_pod_not_ready_total", missing(pods, ns)),
        (p + "kube_pod_restarts_rate_5m", lambda e: e.agg(e.rate("kube_pod_container_status_restarts_total", 300), "sum", ns)),
        (p + "kube_pod_waiting_total", lambda e: e.agg(e.m("kube_pod_container_status_waiting_reason"), "sum", ["namespace", "reason"])),
        (p + "kube_node_ready_ratio", ratio(nodes, [])),
        (p + "kube_node_not_ready_total", missing(nodes, [])),
        (p + "deployment_available_ratio", lambda e: e.op(replicas("available")(e), "/", e.clamp(e.agg(e.m("kube_deployment_spec_replicas"), "sum", dep), 1))),
        (p + "deployment_unavailable_replicas", replicas("unavailable")),
        (p + "deployment_available_replicas", replicas("available")),
        (p + "remote_write_pending_samples", total(queue + "pending_samples")),
        (p + "remote_write_failed_samples_rate_5m", total_rate(queue + "failed_samples_total")),
        (p + "remote_write_retried_samples_rate_5m", total_rate(queue + "retried_samples_total")),
        (p + "remote_write_lag_seconds", first(lag("highest_timestamp_in_seconds"), lag("queue_highest_sent_timestamp_seconds"))),
        (p + "mimir_request_rate_5m", both_spellings("request_duration_seconds_count", job_rate)),
        (p + "mimir_request_latency_p95_seconds", both_spellings("request_duration_seconds_bucket", latency)),
        (p + "mimir_ingested_samples_rate_5m", both_spellings("distributor_received_samples_total", total_rate)),
        (p + "mimir_discarded_samples_rate_5m", both_spellings("distributor_discarded_samples_total", total_rate)),
        (p + "mimir_active_series", first(*[total(f"{x}_ingester_{k}_series") for k in ("memory", "active") for x in ("cortex", "mimir")])),
    ]


def cluster_base(s: Settings) -> list[Rule]:
    def share(name, label, value, *base):
        return lambda e: e.op(e.agg(e.m(name, *base, (label, "=", value)), "sum", []), "/", e.clamp(e.agg(e.m(name, *base), "sum", []), 1))

    return [
        ("platform:prometheus_remote_write_failure_rate5m", lambda e: e.rate("prometheus_remote_storage_samples_failed_total", 300)),
        ("platform:k8s_pod_running_ratio", share("kube_pod_status_phase", "phase", "Running")),
        ("platform:mimir_ingest_rate5m", lambda e: e.rate("mimir_distributor_received_samples_total", 300)),
        ("platform:node_ready_ratio", share("kube_node_status_condition", "status", "true", ("condition", "=", "Ready"))),
    ]


HIGH_RSSI = [*RF, "threshold_dbm"]

GROUPS: dict[str, Callable[[Settings], list[Rule]]] = {
    "ap_voice_latency": ap_voice_latency, "badge_client": badge_client, "rf_observability": rf_observability,
    "control_plane": control_plane, "platform_health": platform_health, "cluster_base": cluster_base,
}


class _Reads:
    """Records which names the rules of a group read, by running them on a stand-in."""

    def __init__(self):
        self.instant: Counter = Counter()
        self.ranged: set[str] = set()

    def m(self, name, *matchers):
        self.instant[name] += 1
        return self

    def rate(self, name, window):
        self.ranged.add(name)
        return self

    increase = rate

    def __getattr__(self, _name):
        return lambda *args, **kwargs: self


class Evaluator:
    """Vector operations of rules on DataFrames at one instant."""

    def __init__(self, samples: DataFrame, now: Column, extrapolate: bool):
        self.samples, self.now, self.extrapolate = samples, now, extrapolate
        self.current: DataFrame | None = None
        self.recorded: dict[str, DataFrame] = {}

    def m(self, name, *matchers):
        source = self.recorded.get(name)
        if source is not None:
            return T.select_series(source, None, matchers).select("labels", "value")
        return T.select_series(self.current, name, matchers).select("labels", "value")

    def _counter(self, name, window, per_second):
        rows = self.samples.filter(F.col("metric") == name)
        return T.increase(rows, window, self.now, self.extrapolate, per_second).select("labels", "value")

    def rate(self, name, window):
        return self._counter(name, window, True)

    def increase(self, name, window):
        return self._counter(name, window, False)

    def agg(self, v, how, by):
        return T.series_agg(v, how, by)

    def quantile(self, v, q, by):
        return T.quantile_by(v, q, by)

    def op(self, a, sign, b, on=None):
        return T.vec_op(a, b, sign, on)

    def enrich(self, many, one, on, extra):
        return T.vec_enrich(many, one, on, extra)

    def both(self, a, b, on):
        return T.vec_and(a, b, on)

    def unless(self, a, b, on):
        return T.vec_unless(a, b, on)

    def either(self, a, b):
        return T.vec_or(a, b)

    def gt(self, v, x):
        return T.compare(v, ">", x)

    def lt(self, v, x):
        return T.compare(v, "<", x)

    def scale(self, v, k):
        return T.scale(v, k)

    def const(self, v, k):
        return v.withColumn("value", F.col("value") * 0 + F.lit(float(k)))

    def age(self, v):
        return v.withColumn("value", F.unix_micros(self.now) / F.lit(1e6) - F.col("value"))

    def clamp(self, v, floor):
        return T.clamp(v, floor)

    def sqrt(self, v):
        return v.withColumn("value", F.sqrt("value"))

    def relabel(self, v, copies, fixed=None):
        return T.rename_labels(v, copies, fixed)

    def top1(self, v, by):
        return T.topk_by(v, by, 1)

    def at_least_zero(self, v):
        from tidewire.functions.predicates import compare_bool
        return compare_bool(v, ">=", 0)

    def or_zero(self, v):
        return T.or_default(v, 0.0)

    def bucket_quantile(self, v, q):
        return T.histogram_quantile(v, q)


def run_rules(samples: DataFrame, rules: list[Rule], now: Column, lookback: float = 300.0, extrapolate: bool = True) -> DataFrame:
    """All rules of a group as ``(metric, labels, value)``.

    Only the metrics that the rules read are scanned. The shared instant vector
    and results read more than once are checkpointed: they are not recomputed,
    plans stay short, and a lost executor does not undo them.
    """
    reads = _Reads()
    for _, fn in rules:
        fn(reads)
    names = {n for n, _ in rules}
    e = Evaluator(samples, now, extrapolate)
    raw = [n for n in reads.instant if n not in names]
    e.current = checkpointed(T.instant(samples.filter(F.col("metric").isin(raw)), now, lookback))
    outs = []
    for name, fn in rules:
        vec = fn(e)
        if reads.instant[name] > 1:
            vec = checkpointed(vec)
        e.recorded[name] = vec
        outs.append(vec.select(F.lit(name).alias("metric"), "labels", "value"))
    return union_all(*outs)


def rule_table(settings: Settings | None = None) -> list[tuple[str, str]]:
    """(group, rule) of every recording rule."""
    s = settings or Settings()
    return [(g, name) for g, make in GROUPS.items() for name, _ in make(s)]
