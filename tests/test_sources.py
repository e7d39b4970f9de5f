import datetime as dt

from tablerows import rows
from pyspark.sql import functions as F

from tidewire.sources import exposition as X
from tidewire.sources import files as S
from tidewire.sources import textjobs as T


def lines(spark, text, path="f"):
    return spark.createDataFrame([(path, i, v) for i, v in enumerate(text.split("\n"), 1)], "path string, line_no long, value string")


LOG = """03/04/26 08:00:00.250 drv: roam_reason = LOW_RSSI[1]
drv: Found 2 total APs and 1 roam candidate APs
2026-03-04 08:00:01 drv: [0*] [aa:bb:cc:00:00:01] [Channel: 140] [RSSI = -46] [CU = 3%] [Score = 100]
2026-03-04 08:00:01 drv: [1] [aa:bb:cc:00:00:02] [Channel: 1] [RSSI = -69] [CU = 12%] [Score = 68]
2026-03-04 08:00:02 NCI : Connected to network, channel=140,bssid=aa:bb:cc:00:00:02,ssid='net'
drv: Found 5 total APs and 1 roam candidate APs
2026-03-04 08:00:03 drv: [0] [aa:bb:cc:00:00:03] [Channel: 36] [RSSI = -50] [CU = 3%] [Score = 90]
2026-03-04 08:00:04 wlan0: RRM-NEIGHBOR-REP-RECEIVED bssid=aa:bb:cc:00:00:04 info=0x2f7 op_class=133 chan=5 phy_type=7"""


def test_scan_log(spark):
    out = T.scan_events_job(lines(spark, LOG))
    ev = {r["event_no"]: r for r in out["events"].collect()}
    assert len(ev) == 2 and ev[1]["total_aps"] == 2 and ev[1]["candidate_count"] == 2 and ev[2]["total_aps"] == 5
    assert ev[1]["event_time"] == dt.datetime(2026, 3, 4, 8, 0, 0, 250000) and ev[2]["event_time"] == dt.datetime(2026, 3, 4, 8, 0, 2)
    assert any("differs from selected" in w for w in ev[1]["warnings"])
    assert any("selected_candidate_count=0" in w for w in ev[2]["warnings"]) and any("less than total_aps" in w for w in ev[2]["warnings"])
    assert rows(out["rrm_neighbors"], "bssid", "band") == [("aa:bb:cc:00:00:04", "6GHz")]


def test_scan_report_takes_the_section_only(spark):
    text = """Client MAC Address : aabb.cc00.00ff
Client Scan Reports
  Time : 01/02/2026 03:04:05 UTC
  Last Report @: 01/02/2026 03:05:00 UTC
  aabb.cc00.0001   36   -55 dBm   SNR: 30 dB
  aabb.cc00.0001   36   -50 dBm
  BSSID: aa:bb:cc:00:00:02
    Channel : 11
    RSSI : -60 dBm
    SNR : 25 dB
Nearby AP Statistics:
  aabb.cc00.0009   36   -20 dBm
Client Scan Reports
  aabb.cc00.0008   36   -20 dBm"""
    out = T.scan_report_job(lines(spark, text))
    assert rows(out["candidates"], "bssid", "channel", "rssi_dbm") == [("aa:bb:cc:00:00:01", 36, -50.0), ("aa:bb:cc:00:00:02", 11, -60.0)]
    assert out["report_time"].first()["report_time"] == dt.datetime(2026, 1, 2, 3, 5)


def test_controller_dump(spark):
    text = """# wireless_rf_collection_commands_total: 9
AP Name   AP Mac   Site Tag Name   Policy Tag Name   RF Tag Name
-----------------
AP-A 0011.2233.4455 ST_1 POL RF1
AP-B ST_2 POL2 RF2 No Static

show ap name AP-A auto-rf dot11 5ghz
AP Name: AP-A
Nearby APs
N1 00:11:22:33:44:66 36 -60
N2 00:11:22:33:44:77 40 -68
Radar Information
Current Channel: 100#
Channel Width: 80
show wireless stats ap name AP-B traffic-distribution slot 0 latency access-category voice
WiFi6
Average Latency (us)  123
Very High  4"""
    ls = lines(spark, text)
    out = T.rf_dump_job(ls)
    snap = {r["ap_name"]: r for r in out["snapshots"].collect()}
    assert snap["AP-A"]["current_channel"] == 100 and snap["AP-A"]["cac_running"] and snap["AP-A"]["site_tag"] == "ST_1" and snap["AP-A"]["ap_mac"] == "00:11:22:33:44:55"
    assert snap["AP-B"]["has_auto_rf"] is False and snap["AP-B"]["site_tag"] == "ST_2" and snap["AP-B"]["band"] == "2.4ghz"
    assert rows(out["neighbors"], "neighbor_ap", "channel", "rssi_dbm") == [("N1", 36, -60), ("N2", 40, -68)]
    assert rows(out["latencies"], "client_generation", "avg_latency_us", "packets_very_high") == [("wifi6", 123.0, 4)]
    st = T.collection_stats(ls, out).first()
    assert (st["commands_total"], st["ap_count"], st["latency_samples"]) == (9, 2, 1)


def test_ping_forms(spark):
    replies = "64 bytes: time=10.0 ms\n64 bytes: time=20.0 ms\n2 packets transmitted, 2 received, 0% packet loss, time 1ms"
    summary = "5 packets transmitted, 4 received, 20% packet loss\nrtt min/avg/max/mdev = 1.0/2.0/4.0/0.5 ms"
    d = T.ping_log_job(spark.createDataFrame([("a", replies), ("b", summary), ("c", "nothing")], "run_id string, output string"))
    got = {r["run_id"]: r for r in d.collect()}
    assert (got["a"]["rtt_p95_ms"], got["a"]["rtt_mdev_ms"], got["a"]["pdv_p95_ms"]) == (20.0, 5.0, 10.0)
    assert (got["b"]["rtt_p95_ms"], got["b"]["rtt_mdev_ms"], got["b"]["loss_pct"], got["b"]["pdv_p95_ms"]) == (4.0, 0.5, 20.0, None)
    assert got["c"]["error"] == "no ping replies parsed" and got["c"]["loss_pct"] == 100.0


def test_client_json_aliases_and_units(spark):
    doc = '{"detail": {"hostMac": "AABB.CC00.0001", "latencyVoiceMs": "1.5 ms", "rssi": "-61 dBm", "radioBand": "2.4 GHz", "akm": "WPA2 FT", "averageAuthDuration": -3}}'
    d = S.client_detail_job(spark.createDataFrame([("1", doc), ("2", '{"mac": "bad"}'), ("3", "{oops")], "id string, j string"), "id", "j", {"ssid": "voice"})
    r = d.collect()
    assert len(r) == 1 and r[0]["latency_voice_us"] == 1500.0 and r[0]["rssi_dbm"] == -61.0 and r[0]["band"] == "24ghz" and r[0]["ft_state"] == "ft" and r[0]["ssid"] == "voice"
    assert r[0]["average_auth_duration_ms"] is None


def test_throughput_folder(spark, tmp_path):
    raw = tmp_path / "dev9" / "raw"
    raw.mkdir(parents=True)
    (raw / "downstream-20240102-030405.json").write_text('{"iperf3": {"end": {"sum_received": {"bits_per_second": 5, "jitter_ms": 0.5}, "sum": {"bits_per_second": 9}}}}')
    (raw / "x.json").write_text('{"error": "unable to connect", "end": {}}')
    (raw / "y.json").write_text("{broken")
    got = {r["path"].rsplit("/", 1)[1]: r for r in S.read_iperf_json(spark, str(tmp_path)).collect()}
    r = got["downstream-20240102-030405.json"]
    assert (r["device"], r["direction"], r["bits_per_second"], r["up"], r["ts"]) == ("dev9", "downstream", 5.0, 1, dt.datetime(2024, 1, 2, 3, 4, 5))
    assert got["x.json"]["up"] == 0 and got["x.json"]["error"] == "unable to connect" and got["y.json"]["parse_error"]


def test_manual_csv_and_template_round_trip(spark, tmp_path):
    head = ",".join(n for n, _ in S.TEMPLATE)
    row = {"survey_time": "2024-01-02T03:04:05+00:00", "bssid": "AA-BB-CC-00-00-01", "channel": "36", "survey_rssi_dbm": "-55"}
    text = [",".join(row.get(n, "") for n, _ in S.TEMPLATE), ",".join({**row, "survey_rssi_dbm": ""}.get(n, "") for n, _ in S.TEMPLATE)]
    (tmp_path / "m.csv").write_text("\n".join([head, *text]))
    d = S.read_manual_csv(spark, str(tmp_path / "m.csv"))
    assert rows(d, "bssid", "band", "rssi_dbm", "survey_time") == [("aa:bb:cc:00:00:01", "5GHz", -55.0, dt.datetime(2024, 1, 2, 3, 4, 5))]


def test_log_files_plain_and_gzip(spark, tmp_path):
    import gzip
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(1, 1001)))
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("one\ntwo\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")  # several splits per file
    try:
        d = S.read_log_lines(spark, str(tmp_path)).cache()
        assert d.filter(F.col("path").endswith("a.log") & (F.col("value") != F.concat(F.lit("line "), F.col("line_no").cast("string")))).count() == 0
        assert rows(d.filter(F.col("path").endswith(".gz")), "line_no", "value") == [(1, "one"), (2, "two")] and d.count() == 1002
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_exposition_escapes(spark):
    d = spark.createDataFrame([("m", {"b": 'q"\\', "a": "x\ny"}, 2.0), ("m", {}, None), ("n", {}, 0.5)], "metric string, labels map<string,string>, value double")
    out = rows(X.exposition_lines(d), "line")
    assert out == [('m{a="x\\ny",b="q\\"\\\\"} 2',), ("n 0.5",)]
    back = X.read_exposition(spark.createDataFrame([(out[0][0],), ("# HELP m x",), ("bad line",)], "value string")).collect()
    assert len(back) == 1 and back[0]["labels"] == {"a": "x\ny", "b": 'q"\\'}


def test_transcript(spark):
    text = "junk\nwlc#terminal length 0\nwlc#show wireless multicast group 230.230.0.9 vlan 7\n! Attempt: at-1\nClient List\naabb.cc00.0001 joined\nwlc#terminal length 0\nwlc#monitor capture X start"
    b = T.transcript_blocks_job(lines(spark, text))
    got = {r["block_index"]: r for r in b.collect()}
    assert got[0]["phase"] == "resolved_group" and got[0]["attempt_ids"] == ["at-1"] and got[1]["phase"] == "capture_start"
    s = {r["block_index"]: r for r in T.snapshot_extract_job(b, receiver_mac="aa:bb:cc:00:00:01", expected_vlan=8).collect()}
    assert s[0]["group_ip"] == "230.230.0.9" and s[0]["receiver_group_member"] is True and s[0]["vlan_context_state"] == "configured_group_mismatch"
    assert s[1]["group_ip"] is None and s[1]["receiver_group_member"] is None
