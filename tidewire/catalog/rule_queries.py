"""Recording rules over samples derived from events.

Every event becomes one sample of one of the raw metrics of a rule group, its
labels follow from the user, and a month of events is folded into five minutes
so that the rules' own windows apply.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.registry import query
from tidewire.catalog.rule_sql import as_map, rule_sql
from tidewire.operators import timeseries as T
from tidewire.plans import rules as R

NOW = "2024-01-31 00:00:00"
FOLD = 8640
LABELS = {
    "ap_voice_latency": {
        "wlc": "'wlc' || cast(u % 2 as string)", "ap_name": "'ap' || cast(u as string)", "site_tag": "'site' || cast(u % 5 as string)", "policy_tag": "'pol'",
        "rf_tag": "'rf' || cast(u % 2 as string)", "slot_id": "cast(u % 2 as string)", "band": "case when u % 2 = 0 then '24ghz' else '5ghz' end",
        "client_generation": "case when u % 3 = 0 then 'wifi6' else 'non_wifi6' end", "access_category": "case when u % 11 = 0 then 'video' else 'voice' end",
        "latency_level": "case when m like '%packets_cli' then case when e % 4 < 2 then 'low' else 'very_high' end else '' end"},
    "badge_client": {
        "source": "'wlc' || cast(u % 2 as string)", "ms_mac_address": "case when m like '%_cc' then '' else 'mac' || cast(u as string) end",
        "client_mac": "case when m like '%current_ssid' or m like '%traffic_stats%' then '' else 'mac' || cast(u as string) end",
        "vap_ssid": "case when m like '%current_ssid' then case when u % 13 = 0 then 'guest' else 'voice' end else '' end",
        "ms_wifi_auth_key_mgmt": "case when m like '%current_ssid' and u % 5 > 0 then case when u % 2 = 0 then 'psk-ft' else 'psk' end else '' end",
        "ap_name": "case when m like '%ms_ap_slot_id' then 'ap' || cast(e % 3 as string) else '' end",
        "co_state": "case when m like '%ms_ap_slot_id' then case when u % 7 = 0 then 'idle' else 'client-status-run' end else '' end",
        "ft_state": "case when m like '%ft_state_cc' then case when u % 2 = 0 then 'ft' else 'non_ft' end else '' end",
        "wlc": "case when m like '%_cc' then 'wlc' || cast(u % 2 as string) else '' end", "ssid": "case when m like '%_cc' then 'voice' else '' end",
        "site_tag": "case when m like '%_cc' then 'voice' else '' end", "band": "case when m like '%_cc' then 'all' else '' end",
        "device_group": "case when m like '%_cc' then 'badge' else '' end"},
    "rf_observability": {
        "wlc": "case when m like '%_cli' then 'wlc' || cast(u % 2 as string) else '' end", "ap_name": "case when m like '%_cli' then 'ap' || cast(u as string) else '' end",
        "site_tag": "case when m like '%_cli' then 'site' || cast(u % 5 as string) else '' end", "policy_tag": "case when m like '%_cli' then 'pol' else '' end",
        "rf_tag": "case when m like '%_cli' then 'rf' else '' end", "band": "case when m like '%_cli' then case when u % 2 = 0 then '24ghz' else '5ghz' end else '' end",
        "source": "'wlc' || cast(u % 2 as string)", "channel_family": "case when m like '%_cli' then 'fam' || cast(u % 3 as string) else '' end",
        "threshold_dbm": "case when m like '%high_rssi%' then case when e % 2 = 0 then '-65' else '-75' end else '' end",
        "wtp_mac": "case when m like '%wtp_model_type' then 'm' || cast(u as string) else '' end", "ap_mac": "case when m like '%radio_oper_stats%' then 'm' || cast(u as string) else '' end",
        "slot_id": "case when m like '%radio_oper_stats%' then cast(u % 2 as string) else '' end", "name": "case when m like '%wtp_model_type' then 'ap' || cast(u as string) else '' end",
        "tag_info_resolved_tag_info_resolved_site_tag": "case when m like '%wtp_model_type' then 'site' || cast(u % 5 as string) else '' end",
        "tag_info_resolved_tag_info_resolved_rf_tag": "case when m like '%wtp_model_type' then 'rf' else '' end",
        "device_detail_static_info_ap_models_model": "case when m like '%wtp_model_type' then 'model' || cast(u % 4 as string) else '' end",
        "ap_location_location": "case when m like '%wtp_model_type' and u % 3 > 0 then 'loc' || cast(u % 9 as string) else '' end"},
    "control_plane": {
        "source": "'wlc' || cast(u as string)", "subscription": "'sub1'", "chassis": "'1'", "chassis_state": "'ok'", "slot": "cast(u % 2 as string)",
        "control_process_status": "case when u % 4 = 0 then 'warning' else 'healthy' end",
        "memory_stats_memory_status": "case when m like '%memory%' then 'ok' else '' end",
        "load_average_stats_load_average_status": "case when m like '%load_avg%' then 'ok' else '' end",
        "load_avg_minutes_load_avg_minute_status_condition": "case when m like '%load_avg%' then 'c' || cast(u % 2 as string) else '' end"},
    "platform_health": {
        "namespace": "case when m like 'kube%' then 'ns' || cast(u % 6 as string) else '' end", "deployment": "case when m like 'kube_deployment%' then 'd' || cast(u % 9 as string) else '' end",
        "pod": "'p' || cast(u as string)", "condition": "case when m like 'kube_pod_status_ready' then 'true' when m like 'kube_node%' then 'Ready' else '' end",
        "status": "case when m like 'kube_node%' then case when u % 6 = 0 then 'false' else 'true' end else '' end",
        "reason": "case when m like '%waiting_reason' then 'r' || cast(u % 3 as string) else '' end", "alertstate": "case when m = 'ALERTS' then case when u % 2 = 0 then 'firing' else 'pending' end else '' end",
        "job": "'job' || cast(u % 2 as string)",
        "le": "case when m like '%_bucket' then case u % 5 when 0 then '0.1' when 1 then '0.5' when 2 then '1' when 3 then '5' else '+Inf' end else '' end"},
}
LABELS["cluster_base"] = {**LABELS["platform_health"], "phase": "case when m like '%phase' then case when u % 4 = 0 then 'Pending' else 'Running' end else '' end"}
VALUE = """case when m like '%timestamp%' then 1706659200 - v * 60 when m = 'up' or m like '%_ready' or m like 'kube_node%' or m like '%is_dfs%' or m like '%running%' then case when v > 20 then 1e0 else 0e0 end
  when m like '%cortex_distributor_received%' then null else v end"""
ABSENT = {"platform_health": ["cortex_distributor_received_samples_total", "cortex_ingester_memory_series", "prometheus_remote_storage_highest_timestamp_in_seconds"]}


def raw_metrics(group: str) -> list[str]:
    """Raw metrics of a group, without those left out to exercise the fallbacks."""
    reads = R._Reads()
    rules = R.GROUPS[group](R.Settings())
    for _, fn in rules:
        fn(reads)
    own = {n for n, _ in rules}
    extra = {"wireless_ap_dfs_radar_changes_total"} & own
    return sorted(({*reads.instant, *reads.ranged} - own | extra) - set(ABSENT.get(group, [])))


def rule_samples(t, group: str):
    names = raw_metrics(group)
    folded = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.floor((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("ts")) / F.lit(FOLD))
    d = t.events.select(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names)).cast("int") + 1).alias("m"),
                        F.col("user_id").alias("u"), F.floor(F.col("event_id") / len(names)).alias("e"), F.col("value").alias("v"), F.timestamp_micros(folded).alias("ts"))
    d = d.select("m", "ts", F.expr(VALUE).alias("value"), *[F.expr(x).alias(k) for k, x in LABELS[group].items()])
    return d.select(F.col("m").alias("metric"), T.label_map(list(LABELS[group])).alias("labels"), "ts", "value")


def sample_sql(group: str) -> str:
    names = raw_metrics(group)
    cols = ", ".join(f'{x} as "{k}"' for k, x in LABELS[group].items())
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""select m as metric, {as_map(list(LABELS[group]))} as labels, ts, value from (select m, ts, {VALUE} as value, {cols} from
      (select ([{listed}])[event_id % {len(names)} + 1] as m, user_id as u, event_id // {len(names)} as e, value as v,
        make_timestamp(epoch_us(timestamp '{NOW}') - (epoch_us(timestamp '{NOW}') - epoch_us(ts)) // {FOLD}) as ts from events))"""


def _register(group: str) -> None:
    rules = R.GROUPS[group](R.Settings())

    @query(f"t15_rules_{group}", rule_sql(sample_sql(group), rules, NOW, 300))
    def run(t):
        out = R.run_rules(rule_samples(t, group), rules, F.lit(NOW).cast("timestamp"))
        return out.select("metric", T.series_key("labels").alias("labels"), F.round("value", 9).alias("value"))


for _group in R.GROUPS:
    _register(_group)
