"""Cases of the fourth review's findings: disk that must not grow with text nobody asked for."""

import time

import pytest
from pyspark.sql import functions as F

from tablerows import rows
from test_round3 import dump_tables
from tidewire.catalog import source_queries as Q
from tidewire.operators import blocked, windows
from tidewire.operators import graph as G
from tidewire.operators.aggregates import neighbor_stats
from tidewire.operators.windows import uniquify
from tidewire.session import store, written
from tidewire.sources import textjobs as T


def shuffle_files(spark):
    """Sizes of the shuffle files that the session now has on disk, by name."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    out = {}
    for i in range(files.size()):
        f = files.apply(i)
        if f.getName().startswith("shuffle_") and f.getName().endswith(".data"):
            out[f.getName()] = f.length()
    return out


def shuffled(spark, run):
    """Bytes shuffled by ``run`` and still on disk."""
    before = set(shuffle_files(spark))
    run()
    return sum(v for k, v in shuffle_files(spark).items() if k not in before)


def test_what_a_stored_table_was_shuffled_for_is_deleted(spark):
    before = set(shuffle_files(spark))
    kept = store(spark.range(100_000).select(F.xxhash64("id").alias("h"), "id").repartition(4, "h").groupBy("h").agg(F.max("id").alias("m")), "test")
    until = time.time() + 20
    while (left := set(shuffle_files(spark)) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and kept.count() == 100_000


def test_columns_that_parquet_cannot_hold_are_checkpointed(spark):
    d = spark.sql("select 1 as a, null as b union all select 2, null")
    assert rows(written(d, "test")) == [(1, None), (2, None)] and rows(written(d.select("a"), "test")) == [(1,), (2,)]


BLOCK = ["x#show ap name A{0} auto-rf dot11 5ghz", "AP Name: A{0}", "Nearby APs", "N1 00:11:22:33:44:66 36 -60", "Radar Information", "Current Channel: 100#",
         "show wireless stats ap name A{0} traffic-distribution slot 1 latency access-category voice", "WiFi6", "Average Latency (us)  12{0}", "Time Period : Ending at 05/21/2026 09:47:05"]


@pytest.fixture
def wordy(spark):
    """Dumps of 40 blocks, each with 100 lines of long text that says nothing."""
    filler = F.concat_ws(" ", *[F.conv(F.substring(F.sha2(F.concat(F.col("id"), F.lit(f"-{i}")), 256), 1, 15), 16, 10) for i in range(40)])
    text = spark.createDataFrame([(i * 1000 + j, s.format(i)) for i in range(40) for j, s in enumerate(BLOCK)], "line_no long, value string")
    noise = spark.range(4000).select((F.floor(F.col("id") / 100) * 1000 + F.lit(20) + F.col("id") % 100).alias("line_no"), filler.alias("value"))
    return text.unionByName(noise).select(F.lit("d").alias("path"), "line_no", "value")


@pytest.mark.parametrize("part", ["snapshots", "neighbors", "latencies", "stats"])
@pytest.mark.parametrize("heavy", [40, 4_000_000])
def test_text_without_part_in_a_job_is_not_shuffled(spark, monkeypatch, wordy, part, heavy):
    monkeypatch.setattr(blocked, "HEAVY_KEY_ROWS", heavy)
    got = {}

    def run():
        out = T.rf_dump_job(wordy)
        got["rows"] = (T.collection_stats(wordy, out) if part == "stats" else out[part]).collect()

    assert shuffled(spark, run) < 200_000  # the text is 2.7 MB
    assert len(got["rows"]) == (1 if part == "stats" else 40)


def mixed(spark):
    """Two files and one without a name; tables, sections and blocks that reach across borders of 3 lines."""
    tags = ["AP Name AP Mac Site Tag Name Policy Tag Name RF Tag Name", "---", *[f"A{i} 0011.2233.445{i % 10} S{i} P{i} R{i}" for i in range(8)], "", "A1 0011.2233.4459 late late late"]
    text = [s.format(i) for i in range(7) for s in BLOCK]
    # a generation named in one block must not reach the next, nor past its own head
    reset = ["show wireless stats ap name B1 traffic-distribution slot 1 latency access-category voice", "WiFi6  Non-WiFi6", "Good 5 6",
             "show wireless stats ap name B2 traffic-distribution slot 0 latency access-category video", "Good 7", "Wi-Fi 6", "Good 8", "x#show ap name B3 auto-rf dot11 5ghz", "Good 9", "Nearby APs"]
    lines = [(p, i + 1, v) for p in ("d", "e", None) for i, v in enumerate([*tags, *text, *reset, *([None] if p else [])])]
    return spark.createDataFrame(lines, "path string, line_no bigint, value string")


def test_a_dump_cut_anywhere_gives_the_same_tables(spark, monkeypatch):
    names = ["snapshots", "neighbors", "latencies", "tags"]
    lines = mixed(spark)
    whole = {n: rows(T.rf_dump_job(lines)[n]) for n in names}
    monkeypatch.setattr(T, "LINES", blocked.Order("line_no", step=3))
    for heavy in (4_000_000, 93, 40):  # no file, those of 94 lines, all of them
        monkeypatch.setattr(blocked, "HEAVY_KEY_ROWS", heavy)
        out = T.rf_dump_job(lines)
        assert {n: rows(out[n]) for n in names} == whole
    some = out["latencies"].filter("path = 'd' and ap_name in ('B1', 'B2')")
    assert rows(some, "ap_name", "client_generation", "packets_good") == [("B1", "non_wifi6", 6), ("B1", "wifi6", 5), ("B2", "all", 7), ("B2", "wifi6", 8)]
    tags = {r["ap_name"]: r["site_tag"] for r in out["tags"].filter("path = 'e'").collect()}
    assert tags == {f"A{i}": f"S{i}" for i in range(8)}


def test_lines_of_one_large_value_are_numbered_alike(spark, monkeypatch):
    t = dump_tables(spark)
    whole = rows(Q.dump_lines(t))
    monkeypatch.setattr(Q, "HEAVY_KEY_ROWS", 21)  # values of 22 lines count as large, others as small
    t.lineitem = t.lineitem.unionByName(t.lineitem.filter("l_orderkey % 2 = 0"))
    both = rows(Q.dump_lines(t))
    monkeypatch.setattr(Q, "HEAVY_KEY_ROWS", 4_000_000)
    monkeypatch.setattr(Q, "FILE_LINES", 100)
    assert rows(Q.dump_lines(t)) == both and len(both) == len(whole) + 70


def test_channels_of_a_radio_are_counted_in_one_shuffle(spark):
    d = spark.createDataFrame([("a", -60, 36), ("a", -70, 36), ("a", -50, 40), ("b", -80, None)], "ap string, rssi int, ch int")
    out = neighbor_stats(d, ["ap"], "rssi", "ch", [-65])
    assert rows(out, "ap", "neighbor_count", "unique_channels", "channel_list") == [("a", 3, 2, "36,40"), ("b", 1, 0, "")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_ids_that_cannot_clash_are_not_looked_up(spark):
    d = spark.createDataFrame([("x", 1), ("x", 2), ("y-1", 3), ("y-02", 4), (None, 5), (None, 6)], "b string, o int")
    out = uniquify(d, "b", blocked.Order("o"))
    assert rows(out, "o", "unique_id") == [(1, "x"), (2, "x-2"), (3, "y-1"), (4, "y-02"), (5, None), (6, None)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


@pytest.mark.parametrize("few", [0, 100])
def test_ids_clash_with_any_number(spark, monkeypatch, few):
    monkeypatch.setattr(windows, "FEW_RANGES", few, raising=False)
    d = spark.createDataFrame([("x", i) for i in range(1, 13)] + [("x-2", 20), ("x-2", 21), ("x-12", 22), ("x-1", 23), ("x-2\n", 24)], "b string, o int")
    got = {r["o"]: r["unique_id"] for r in uniquify(d, "b", blocked.Order("o")).collect()}
    assert len(set(got.values())) == 17 and {o for o, v in got.items() if len(v) > 12} == {2, 12}
    assert (got[1], got[3], got[20], got[21], got[22], got[23], got[24]) == ("x", "x-3", "x-2", "x-2-2", "x-12", "x-1", "x-2\n")


def topology(spark, n):
    nodes = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s2")], "id string, site_id string").select("id", F.col("id").alias("label"), F.lit("").alias("ip"), F.lit("").alias("family"), F.lit("").alias("role"), "site_id")
    text = ["id", "uuid", "ip", "hostname", "family", "role", "reachability", "management_state", "collection_status", "location"]
    devices = spark.range(0).select(*[F.col("id").cast("string").alias(x) for x in text])
    sites = spark.createDataFrame([("s1", "S1"), ("s2", "S2")], "id string, name string")
    ends = F.when(F.col("id") % 1000 == 0, "a").otherwise("b"), F.when(F.col("id") % 1000 == 1, "x").when(F.col("id") % 1000 == 2, " ").otherwise("c")
    links = spark.range(0, n, 1, 4).select(F.lit("").alias("id"), ends[0].alias("source"), ends[1].alias("target"), *[F.lit("").alias(x) for x in ("start_port", "end_port", "speed")], F.lit("10 Gbps").alias("start_speed"),
                                           F.lit("1 Gbps").alias("end_speed"), F.lit("up").alias("status"), F.col("id").alias("o"))
    return nodes, links, devices, sites


def test_ends_of_links_are_told_apart_before_they_are_shuffled(spark):
    nodes = G.build_nodes(*topology(spark, 4_000))
    assert "LeftAnti" not in nodes._jdf.queryExecution().optimizedPlan().toString()  # the planner moves it below the distinct ends
    assert rows(nodes, "id", "family", "site_id") == [("a", "network_device", "S1"), ("b", "network_device", "S2"), ("c", "network_device", "S2"), ("x", "link-only", "unknown")]


def test_links_of_a_subgraph_are_shuffled_once(spark):
    """And what they were shuffled for is gone when the subgraph is asked for."""
    parts, got = topology(spark, 40_000), {}
    nodes = G.build_nodes(*parts)

    def run():
        edges = G.build_edges(parts[1], nodes, blocked.Order("o"))
        got["exchanges"] = edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got["made"] = G.visible_subgraph(nodes, edges, site="S1")
        time.sleep(2)

    assert shuffled(spark, run) < 20_000 and got["exchanges"] == 1
    vis, shown = got["made"]
    assert rows(vis, "id") == [("a",), ("c",)] and rows(vis.select("site_id")) == [("S1",), ("S2",)]
    ids = rows(shown, "id", "site_id", "mainstat", "confidence")
    assert len(ids) == 40 and ids[0] == ("a|c", "inter-site", "10 Gbps", "high") and ("a|c-40", "inter-site", "10 Gbps", "high") in ids
