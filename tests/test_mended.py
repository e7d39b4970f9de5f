"""Cases that earlier versions lost or got wrong."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tablerows import rows
from tidewire.operators import graph, quantiles, timeseries as T
from tidewire.plans import maintenance as M
from tidewire.sources import files as S, textjobs as X
from tidewire.streaming import jobs as J


def nested(doc, depth):
    for i in range(depth):
        doc = {"k": 1, "more": doc} if i % 2 else {"list": [0, doc]}
    return json.dumps(doc)


def test_survey_points_at_any_depth_and_floor_names(spark):
    files = spark.createDataFrame([("a", nested({"timestamp": "2024-01-01T00:00:00Z", "id": "p", "floor": "f1", "x": 2}, 12))], "path string, content string")
    plans = spark.createDataFrame([("f1", "First floor")], "id string, name string")
    assert rows(S.survey_points(files, floor_plans=plans), "survey_id", "floor", "x_m") == [("p", "First floor", 2.0)]


def test_client_details_at_any_depth_in_document_order(spark):
    deep = nested({"macAddress": "aa:bb:cc:00:00:01", "rssi": -40}, 12)
    order = '{"z": {"ssid": "first", "mac": "aabb.cc00.0002"}, "a": {"ssid": "second"}, "more": {"rssi": "-50 dBm"}}'
    own = '{"inner": {"ssid": "inner"}, "ssid": "own", "mac": "aabb.cc00.0003", "band": ""}'
    long = json.dumps({"list": [{"n": i} for i in range(100_002)] + [{"ssid": "late", "mac": "aabb.cc00.0004"}], "tail": {"ssid": "later"}})
    d = spark.createDataFrame([("1", deep), ("2", order), ("3", own), ("4", long), ("5", "{broken"), ("6", None)], "id string, content string")
    got = {r["id"]: r for r in S.client_detail_job(d, "id", "content").collect()}
    assert set(got) == {"1", "2", "3", "4"}
    assert [got[k]["ssid"] for k in "1234"] == ["unknown", "first", "own", "late"] and got["1"]["rssi_dbm"] == -40 and got["2"]["rssi_dbm"] == -50


def test_depth_of_a_long_chain(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "source string, target string")
    roots = spark.createDataFrame([("0",)], "id string")
    assert graph.graph_depth(edges, roots).agg(F.max("depth")).first()[0] == 12


@pytest.mark.parametrize("way", ["ordinary", "heavy", "one of four heavy"])
def test_percentiles_of_odd_values(spark, way):
    epoch = [1.7e9 + i for i in range(1, 2001)]
    data = [("epoch", v) for v in epoch] + [("ends", v) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("nan"))] + [("same", 5.0)] * 300 + [("none", None)]
    d = spark.createDataFrame(data, "g string, v double")
    large = {"ordinary": None, "heavy": d.select("g").distinct(), "one of four heavy": d.select("g").distinct().filter("g = 'epoch'")}[way]
    specs = {"lo": ("v", 0.0, "cont"), "mid": ("v", 0.5, "cont"), "p9": ("v", 0.9, "nearest"), "hi": ("v", 1.0, "cont")}
    got = {r["g"]: r for r in quantiles.percentiles(d, ["g"], specs, large).collect()}
    assert got["epoch"]["mid"] == 1.7e9 + 1000.5 and got["epoch"]["p9"] == 1.7e9 + 1800 and got["epoch"]["hi"] == 1.7e9 + 2000
    assert got["ends"]["lo"] == float("-inf") and got["ends"]["mid"] == 2.0 and math.isnan(got["ends"]["hi"])
    assert got["same"]["mid"] == 5.0 and "none" not in got


def test_percentiles_of_several_columns_agree_both_ways(spark):
    d = spark.range(3000).selectExpr("id % 7 as g", "if(id % 5 = 0, null, cast(id * 37 % 101 as int)) as a", "sin(id) as b", "id % 2 as c")
    specs = {"a5": ("a", 0.05, "cont"), "a9": ("a", 0.9, "floor"), "b5": ("b", 0.5, "cont"), "b99": ("b", 0.99, "nearest"), "c3": ("c", 0.3, "floor")}
    for by in (["g"], ["g", "c"], []):
        plain = quantiles.percentiles(d, by, specs, None)
        large = d.select(*(by or [F.lit(1).alias("_all")])).distinct()
        refined = quantiles.percentiles(d, by, specs, large)
        assert plain.columns == refined.columns and sorted(plain.collect()) == sorted(refined.collect()) and plain.count() == {0: 1, 1: 7, 2: 14}[len(by)]


def vector(spark, *series):
    return spark.createDataFrame([(labels, value) for labels, value in series], "labels map<string,string>, value double")


def test_label_sets_keep_apart(spark):
    samples = spark.createDataFrame(
        [("m", {"a": "1,b=2"}, 1.0), ("m", {"a": "1", "b": "2"}, 2.0), ("m", {"a": "x\\,y"}, 3.0), ("m", {"a": "x\\", "y": ""}, 4.0)], "metric string, labels map<string,string>, value double"
    ).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert sorted(r["value"] for r in T.instant(samples, now).collect()) == [1.0, 2.0, 3.0, 4.0]
    kept = {r["value"]: r["labels"] for r in T.quantile_over_time(samples, 0.5, 300.0, now).collect()}
    assert kept[1.0] == {"a": "1,b=2"} and kept[3.0] == {"a": "x\\,y"}


def test_ambiguous_matches_fail(spark):
    one = vector(spark, ({"k": "1", "i": "a"}, 2.0), ({"k": "1", "i": "b"}, 3.0))
    many = vector(spark, ({"k": "1"}, 5.0))
    for run in (lambda: T.vec_op(many, one, "*", ["k"]), lambda: T.vec_op(one, many, "*", ["k"]), lambda: T.vec_enrich(many, one, ["k"], ["i"])):
        with pytest.raises(Exception, match="several series match"):
            run().collect()
    assert T.vec_enrich(one, many, ["k"], []).count() == 2
    assert [r["value"] for r in T.topk_by(one, ["k"], 2).collect()] == [3.0, 2.0]


def test_reload_keeps_rows_without_a_run(spark):
    target = spark.createDataFrame([(None, 1), ("r1", 2), ("r2", 3)], "run string, v int")
    assert rows(M.reload_run(target, "run", "r1", spark.createDataFrame([("r1", 9)], target.schema)), "v") == [(1,), (3,), (9,)]


def test_upsert_without_an_order_wants_unique_updates(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="several updates"):
        M.upsert(target, spark.createDataFrame([(1, "b"), (1, "c")], target.schema), ["k"]).collect()
    assert rows(M.upsert(target, spark.createDataFrame([(1, "b"), (2, "c")], target.schema), ["k"])) == [(1, "b"), (2, "c")]


def test_streamed_averages_have_all_windows_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, k string, v double"
    for hour, v in ((30, 4.0), (1, 2.0), (31, 6.0), (1, 4.0)):  # not in the order of time
        spark.createDataFrame([(hour, v)], "h int, v double").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit("a").alias("k"), "v").coalesce(1).write.mode("append").parquet(src)
    log = M.BatchLog(spark, str(tmp_path / "log"))
    q = J.stream_sums(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "ckpt"), log, ["k"], "ts", "v", "1 day")
    q.awaitTermination()
    assert rows(J.merged_avg(log.read(), ["k"]), "avg_value", "n") == [(3.0, 2), (5.0, 2)]


def test_scan_report_header_and_syslog_time(spark):
    text = ["# collected_at: 2024-05-01T10:00:00Z", "Client Scan Reports", "aa:bb:cc:00:00:01 channel 36 -60 dBm"]
    lines = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(text)], "path string, line_no long, value string")
    assert str(X.scan_report_job(lines)["collected_at"].first()["collected_at"]) == "2024-05-01 10:00:00"
    log = spark.createDataFrame([("f", 1, "May  3 10:00:01.250 host x")], "path string, line_no long, value string")
    assert str(X.timed_lines(log, year=2024).first()["event_time"]) == "2024-05-03 10:00:01"


def test_a_large_partition_value_is_split(spark, tmp_path):
    from pyspark.sql import SparkSession  # noqa: F401

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        d = spark.range(200_000).select(F.lit("a").alias("p"), "id", F.rand(1).alias("x")).repartition(16)
        S.write_table(d, str(tmp_path / "t"), ["p"], ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "t" / "p=a").glob("*.parquet"))) > 4


def test_device_from_an_address_in_the_capture_path(spark):
    from tidewire.operators import flows
    dev = spark.createDataFrame([("10.0.0.1", "00:11:22:33:44:55", "one", "r", "c"), (None, "aabb.ccdd.ee01", "two", "r", "c"), (None, None, "none", "r", "c")], "ip string, mac string, name string, role string, config string")
    s = spark.createDataFrame([(1, "10.0.0.1", "x", "/in/aa-bb-cc-dd-ee-01/f"), (2, "y", "x", "/in/AABBCCDDEE01.pcap"), (3, "y", "x", "/in/plain")], "id int, src_ip string, dst_ip string, file string")
    assert rows(flows.device_labels(s, dev, "file"), "id", "device_name", "peer_device_name") == [(1, "one", "unmapped"), (2, "two", "unmapped"), (3, "unmapped", "unmapped")]


def test_manual_entries_stay_in_their_run(spark):
    cand = spark.createDataFrame([(1, "r1", "AA", 5, True, 1.0, -50.0, "5GHz", "pending"), (2, "r2", "aa", 5, True, 1.0, -60.0, "5GHz", "pending")],
                                 "id long, test_run_id string, bssid string, t long, badge_selected boolean, badge_score double, badge_rssi_dbm double, band string, manual_entry_status string").withColumn("survey_time", F.timestamp_seconds("t"))
    entry = spark.createDataFrame([("r1", "aa", 5, -55.0, None, 1.0)], "test_run_id string, bssid string, t long, survey_rssi_dbm double, survey_snr_db double, entered_at double").withColumn("survey_time", F.timestamp_seconds("t"))
    matches = spark.createDataFrame([(2, "r2", "aa", 5)], "candidate_match_id long, test_run_id string, bssid string, t long").withColumn("survey_time", F.timestamp_seconds("t")).drop("t")
    cands, kept = M.apply_entries(entry, cand, matches)
    assert rows(cands, "id", "manual_entry_status") == [(1, "complete"), (2, "pending")] and rows(kept, "candidate_match_id") == [(1,), (2,)]
    obs = spark.createDataFrame([(7, "r1", "aA", 5, -1.0), (8, "r2", "aa", 5, -2.0)], "id long, test_run_id string, bssid string, t long, rssi_dbm double").withColumn("survey_time", F.timestamp_seconds("t")).drop("t")
    assert rows(M.apply_observations(entry, cand, obs), "id", "rssi_dbm") == [(1, -55.0), (8, -2.0)]
    refer = spark.createDataFrame([(7,)], "observation_id long")
    assert rows(M.reset_observations(entry, obs, refer.filter("false"), "id", "observation_id"), "id") == [(8,)] and M.reset_observations(entry, obs, refer, "id", "observation_id").count() == 2
