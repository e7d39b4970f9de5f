"""Cases of the third round's findings: work that must not grow beyond its input."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablerows import rows
from tidewire.catalog import source_queries as Q
from tidewire.functions import scalars
from tidewire.operators import blocked, joins
from tidewire.sources import textjobs as T
from tidewire.tables import Tables


@pytest.fixture
def all_heavy(monkeypatch):
    """Every key with over 40 rows counts as heavy, and no heavy key may be dealt out and written before it is numbered."""
    def refuse(*_):
        raise AssertionError("rows were sorted into ranges and written")

    monkeypatch.setattr(blocked, "HEAVY_KEY_ROWS", 40)
    monkeypatch.setattr(blocked, "SMALL_BYTES", 0)
    monkeypatch.setattr(blocked, "in_ranges", refuse)


def dump_tables(spark):
    orders = spark.range(70).select(F.expr("if(id = 69, null, id)").alias("o_orderkey"))
    lineitem = spark.range(140).select((F.col("id") % 70).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 3).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"))
    return SimpleNamespace(spark=spark, orders=orders, lineitem=lineitem)


def test_long_dumps_are_numbered_and_cut_without_a_written_sort(spark, all_heavy):
    lines = Q.dump_lines(dump_tables(spark))
    numbered = lines.groupBy("path").agg(F.count("*").alias("n"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"), F.count_distinct("line_no").alias("d"))
    assert all(r["lo"] == 1 and r["hi"] == r["n"] == r["d"] for r in numbered.collect())
    out = T.rf_dump_job(lines)
    assert out["snapshots"].filter("has_auto_rf").count() == 69 and out["latencies"].count() == 2 * 69
    heard = {r["ap_name"]: r["n"] for r in out["neighbors"].groupBy("ap_name").agg(F.count("*").alias("n")).collect()}
    assert heard["AP1"] == 2 and sum(heard.values()) == 138


def test_sections_end_with_their_block_in_long_dumps(spark, all_heavy, monkeypatch):
    monkeypatch.setattr(T, "LINES", blocked.Order("line_no", step=3))
    block = ["x#show ap name A{0} auto-rf dot11 5ghz", "AP Name: A{0}", "Nearby APs", "N1 00:11:22:33:44:66 36 -60"]
    other = ["show ap name B{0} auto-rf dot11 5ghz", "N2 00:11:22:33:44:77 40 -68"]  # not in a section of its own
    text = [s.format(i) for i in range(20) for s in (*block, *other)]
    lines = spark.createDataFrame([("d", i + 1, v) for i, v in enumerate(text)], "path string, line_no bigint, value string")
    assert rows(T.rf_dump_job(lines)["neighbors"], "ap_name", "neighbor_ap") == sorted((f"A{i}", "N1") for i in range(20))


def test_an_address_is_parsed_once_a_row(spark):
    d = spark.createDataFrame([("10.0.2.9",), ("10.0.3.255",), ("10.0.4.0",), ("10.0.5.300",), ("10.0.5.7",), ("10.0.5.007",), ("x",), (None,)], "ip string")
    found = joins.in_any_cidr(d, "ip", [scalars.cidr_bounds("10.0.2.0/23"), scalars.cidr_bounds("10.0.5.0/24")])
    assert rows(found) == [("10.0.2.9",), ("10.0.3.255",), ("10.0.5.7",)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1


def one_file(spark, path, name, frame):
    frame.coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_rows_of_one_small_file_are_worked_on_by_several_tasks(spark, tmp_path):
    one_file(spark, tmp_path, "customer", spark.range(40).select(F.col("id").alias("c_custkey"), F.lit("n").alias("c_name"), (F.col("id") % 3).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("m").alias("c_mktsegment")))
    out = Q.s15f(Tables(spark, str(tmp_path)))
    assert out.rdd.getNumPartitions() > 1
    assert out.count() == 40 and out.filter("receiver_ap = concat('ap', c_custkey % 3)").count() == 40


def test_a_folder_of_results_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    one_file(spark, tmp_path, "supplier", spark.range(40).select(F.col("id").alias("s_suppkey"), F.lit("n").alias("s_name"), F.lit(2).alias("s_nationkey"), F.col("id").cast("double").alias("s_acctbal")).union(spark.sql("select 7L, 'n', 2, 7e0")))
    one_file(spark, tmp_path, "region", spark.range(3).select(F.col("id").cast("int").alias("r_regionkey"), F.lit("r").alias("r_name")))
    folder = str(tmp_path / "out")
    monkeypatch.setattr(Q, "place", lambda *_: folder)
    assert rows(Q.s01f(Tables(spark, str(tmp_path))), "s_suppkey", "bits_per_second") == sorted(((i, float(i)) for i in range(40)), key=lambda r: tuple((False, str(v)) for v in r))
    written = [p.name for p in (tmp_path / "out").rglob("*.json")]
    assert len(written) == 40 and len({n.split("-")[1] for n in written}) > 1
