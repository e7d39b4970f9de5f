"""Registered queries against their SQL twins. TIDEWIRE_ALL=1 runs every one of them."""

import os

import duckdb
import pytest

import check_queries
from tidewire import catalog

FAST = ["f06_parse_timestamp", "f10_multicast", "p10_stream_severity", "j05_nearest_join", "j06_nearest_fallback", "j12_contains_join", "a15_ordered_parts", "a15_distinct_parts", "a35_group_members", "s01_read_folder", "s04_read_folder", "j22_range_join", "a04_pctl_cont", "a06_pctl_nearest_rank",
        "a10_describe_study", "a25_histogram_quantile", "a26_tolerance_sweep", "w04_duplicates", "w10_outliers_sql", "w12_counter_delta", "w16_uniquify", "w17_downsample", "t02_range_eval",
        "t03_rate_extrapolated", "t15_rules_control_plane", "v12_device_summary", "v32_pending_manual_entry", "v44_run_alignment", "r04_sequence_stats", "r05_jitter", "s07_scan_events",
        "s12_client_detail", "g06_graph_depth", "m07_apply_entries", "m09_reconcile", "x02_stability_stream", "x05_stream_rate"]
NAMES = sorted(catalog.queries()) if os.environ.get("TIDEWIRE_ALL") else FAST


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, data, name):
    msg, _, _, ok = check_queries.compare(spark, con, name, catalog.queries()[name], catalog.oracles().get(name), data)
    assert ok, msg


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry_has_rows(spark):
    import __spark_entry__
    assert __spark_entry__.entry(spark).count() > 0
