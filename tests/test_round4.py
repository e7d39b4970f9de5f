"""Cases of this round's findings: memory of one task must not grow with the input."""

import pytest
from pyspark.sql import functions as F

from tidewire.operators import blocked, quantiles

SPECS = {"lo": ("x", 0.05, "cont"), "hi": ("x", 0.95, "nearest"), "y": ("y", 0.5, "floor")}


@pytest.mark.parametrize("rows_each", [2, 40])
def test_percentiles_of_many_groups_are_dealt_into_tasks_of_bounded_size(spark, monkeypatch, rows_each):
    """Before, adaptive execution put all groups into a few tasks, whatever their number."""
    monkeypatch.setattr(blocked, "SMALL_BYTES", -1)
    monkeypatch.setattr(quantiles, "TASK_VALUES", 100, raising=False)
    d = spark.range(0, 2000, 1, 4).select(
        F.expr(f"if(id < {rows_each}, null, id div {rows_each})").alias("g"), F.expr("if(id % 7 = 0, null, concat('k', id % 2))").alias("h"),
        F.expr("case when id % 11 = 0 then null when id % 13 = 0 then double('NaN') else double(id * 37 % 101) end").alias("x"), F.expr("id % 5").alias("y"))
    by = ["g", "h"]
    out = quantiles.percentiles(d, by, SPECS)
    plain = quantiles.percentiles(d, by, SPECS, None)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(out) == same(plain)
    assert out.rdd.getNumPartitions() == 40


def test_heavy_keys_are_told_apart_from_the_load_of_the_others(spark, monkeypatch):
    monkeypatch.setattr(blocked, "SMALL_BYTES", -1)
    monkeypatch.setattr(blocked, "HEAVY_KEY_ROWS", 50)
    d = spark.range(0, 300, 1, 3).select(F.expr("if(id < 100, null, if(id < 200, 1, id))").alias("g"), F.lit("a").alias("h"), F.col("id").cast("double").alias("x"))
    heavy, *load = blocked.counted_load(d, ["g", "h"])
    assert sorted(map(str, heavy.collect())) == ["Row(g=1, h='a')", "Row(g=None, h='a')"] and load == [100, 100, 1]
    assert blocked.counted_load(d.filter("id >= 200"), ["g", "h"]) == (None, 100, 100, 1)
    assert blocked.counted_load(d.filter("id < 0"), ["g", "h"]) == (None, 0, 0, 0)
    got = {(r["g"], r["m"]) for r in quantiles.percentiles(d, ["g"], {"m": ("x", 0.5, "cont")}).collect()}
    assert got == {(None, 49.5), (1, 149.5)} | {(i, float(i)) for i in range(200, 300)}


def test_one_large_group_among_small_ones_is_counted_before_it_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(blocked, "SMALL_BYTES", -1)
    monkeypatch.setattr(quantiles, "TASK_VALUES", 300)
    dealt = []
    monkeypatch.setattr(quantiles, "_ordinary", lambda *a, whole=quantiles._ordinary: dealt.append(a[4:]) or whole(*a))
    d = spark.range(0, 2000, 1, 4).select(F.expr("if(id < 400, 0, id)").alias("g"), F.expr("double(id % 5)").alias("x"))
    for some in (d, d.filter("g > 0")):
        got = quantiles.percentiles(some, ["g"], {"m": ("x", 0.5, "cont")}).collect()
        assert len(got) == some.select("g").distinct().count() and all(r["m"] == (r["g"] % 5 if r["g"] else 2) for r in got)
    assert dealt == [(7, False), (6, True)]
