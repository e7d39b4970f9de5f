"""Exact percentiles of groups of any size.

Most groups have few rows: their values are counted, with map-side combining, and one window per group and column runs over the distinct values.
Groups with more rows than one task should sort go through histogram refinement; both ways give the same numbers.

There, pass one counts values per (group, bucket), with map-side combining; the buckets
are narrow logarithmic steps, so they follow value order. The counts tell which
bucket holds each wanted rank. Pass two keeps only the rows of those buckets and
counts them in equal steps between the bucket's least and greatest value; pass
three counts the values of the steps that hold a rank. No group is ever
collected, and the answer is exact. NaN sorts above all numbers.

Three rank rules are kept apart by name:

``cont``     linear interpolation at position (n-1)*q
``nearest``  element ceil(q*n), 1-based
``floor``    element int(n*q), 0-based
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.blocked import counted_load, is_small, join_back, split_heavy

STEPS_PER_OCTAVE = 4096
SUB_STEPS = 65_536
_TOP = 30_000_000
#: Values, of all columns together, that a task of a counted input sorts; so its memory doesn't grow with the input.
TASK_VALUES = 200_000
#: Groups of fewer rows on average, none of them large, are not counted before the shuffle: hardly a value would be repeated.
FEW_ROWS = 4


def value_bucket(value: Column) -> Column:
    """Integer step function of a number that never decreases with it. Infinities have the end buckets, NaN is above all."""
    size = F.lit(10_000_000) + F.floor(F.log2(F.abs(value)) * STEPS_PER_OCTAVE)
    ends = F.when(F.isnan(value), _TOP).when(value == float("inf"), _TOP - 1).when(value == float("-inf"), 1 - _TOP)
    return ends.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _sub_bucket(value: Column, low: Column, high: Column) -> Column:
    """Equal steps between a bucket's least and greatest value; 0 where it has one value only."""
    wide = ~F.isnan(high) & (F.abs(high) < float("inf")) & (high > low)
    return F.when(wide, F.least(F.floor((value - low) / (high - low) * SUB_STEPS), F.lit(SUB_STEPS - 1))).otherwise(F.lit(0)).cast("bigint")


def _ranks(n: Column, q: float, mode: str) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank (1-based) and interpolation weight."""
    if mode == "cont":
        pos = (n - 1) * F.lit(float(q))
        return F.floor(pos) + 1, F.ceil(pos) + 1, pos - F.floor(pos)
    if mode == "nearest":
        rank = F.greatest(F.lit(1), F.least(n, F.ceil(n * F.lit(float(q)))))
    elif mode == "floor":
        rank = F.least(n, F.floor(n * F.lit(float(q))) + 1)
    else:
        raise ValueError(mode)
    return rank, rank, F.lit(0.0)


def _long(df: DataFrame, by: list[str], sources: list[str]) -> DataFrame:
    """(by, _m, _v): one row per non-null value, ``_m`` the number of its column. One column needs no explode."""
    value = lambda col: F.col(col).cast("double")
    if len(sources) == 1:
        return df.select(*by, F.lit(0).alias("_m"), value(sources[0]).alias("_v")).filter(F.col("_v").isNotNull())
    pairs = F.array(*[F.struct(F.lit(i).alias("m"), value(c).alias("v")) for i, c in enumerate(sources)])
    return df.select(*by, F.explode(pairs).alias("_p")).select(*by, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v")).filter(F.col("_v").isNotNull())


def _ordinary(df: DataFrame, by: list[str], specs: dict[str, tuple[str, float, str]], sources: list[str], tasks: int = 0, early: bool = False) -> DataFrame:
    """Percentiles of groups that a task can sort: running counts over the distinct values.

    ``tasks``: into how many partitions whole groups are dealt (0: Spark's choice), ``early``: before their values are counted.
    """
    keys = [*by, "_m"]
    df = df.repartition(tasks, *by) if tasks and early else df
    counted = _long(df, by, sources).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.repartition(tasks, *by) if tasks and not early else counted
    along = Window.partitionBy(*keys).orderBy("_v")  # one order for both sums, so rows are sorted once
    total = F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = counted.select(*keys, "_v", "_c", total.alias("_n"), F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"))
    outs = []
    for out, (src, q, mode) in specs.items():
        mine = F.col("_m") == sources.index(src)
        lo, hi, frac = _ranks(F.col("_n"), q, mode)
        at = lambda r: mine & (r > F.col("_cum") - F.col("_c")) & (r <= F.col("_cum"))  # noqa: B023, E731
        low, high, weight = F.max(F.when(at(lo), F.col("_v"))), F.max(F.when(at(hi), F.col("_v"))), F.max(F.when(mine, frac))
        outs.append(F.when((weight == 0) | (high == low), low).otherwise(low + (high - low) * weight).alias(out))
    return placed.groupBy(*by).agg(*outs)


def percentiles(df: DataFrame, by: list[str], specs: dict[str, tuple[str, float, str]], heavy: DataFrame | None = ...) -> DataFrame:
    """One row per group with a column per spec ``out -> (column, q, mode)``.

    Nulls are skipped; a group without any value yields no row. ``heavy`` lists the groups that are too large for one task, if they
    are known (None: there are none); else they are counted.
    """
    sources = list(dict.fromkeys(col for col, _, _ in specs.values()))
    if not by:
        one = percentiles(df.select(F.lit(1).alias("_all"), *sources), ["_all"], specs, heavy)
        return one.drop("_all")
    df = df.select(*by, *[c for c in sources if c not in by])
    tasks, early = 0, False
    if heavy is ...:
        heavy, n, groups, most = (None, 0, 0, 0) if is_small(df) else counted_load(df, by)
        tasks, early = -(-n * len(sources) // TASK_VALUES), n < FEW_ROWS * groups and most * len(sources) <= TASK_VALUES
    rows, large = split_heavy(df, by, heavy)
    done = _ordinary(rows, by, specs, sources, tasks, early)
    return done if large is None else done.unionByName(_refined(large, by, specs, sources))


def _refined(df: DataFrame, by: list[str], specs: dict[str, tuple[str, float, str]], sources: list[str]) -> DataFrame:
    """Percentiles of groups of any size, by histogram refinement."""
    long = _long(df, by, sources).withColumn("_b", value_bucket(F.col("_v")))
    keys = [*by, "_m"]
    along = Window.partitionBy(*keys).orderBy("_b")
    hist = (
        long.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_cum", F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    )
    wanted = F.array()
    for i, col in enumerate(sources):
        ranks = []
        for src, q, mode in specs.values():
            if src == col:
                lo, hi, _ = _ranks(F.col("_n"), q, mode)
                ranks += [lo.cast("bigint"), hi.cast("bigint")]
        mine = F.array(*ranks)
        wanted = mine if i == 0 else F.when(F.col("_m") == i, mine).otherwise(wanted)
    inside = lambda r: (r > F.col("_cum") - F.col("_c")) & (r <= F.col("_cum"))
    cand = (
        hist.withColumn("_r", F.array_distinct(F.filter(wanted, inside)))
        .filter(F.size("_r") > 0)
        .select(*keys, "_b", "_lo", "_hi", "_r", "_n", (F.col("_cum") - F.col("_c")).alias("_before"))
    )
    # Buckets without a wanted rank go before anything is counted.
    near = join_back(long, cand, [*keys, "_b"]).filter(F.col("_r").isNotNull()).withColumn("_s", _sub_bucket(F.col("_v"), F.col("_lo"), F.col("_hi")))
    place = [*keys, "_b", "_s"]
    once = [F.first(x).alias(x) for x in ("_r", "_n", "_before")]
    counted = near.groupBy(*place, "_v").agg(F.count(F.lit(1)).alias("_k"), *once)
    step = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    steps = counted.groupBy(*place).agg(F.sum("_k").alias("_c"), *once).withColumn("_cum", F.col("_before") + F.sum("_c").over(step))
    held = steps.withColumn("_r", F.filter("_r", inside)).filter(F.size("_r") > 0).select(*place, F.col("_r").alias("_rs"), (F.col("_cum") - F.col("_c")).alias("_from"))
    hits = join_back(counted, held, place).filter(F.col("_rs").isNotNull())
    inner = Window.partitionBy(*place).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_c", F.col("_k")).withColumn("_cum", F.col("_from") + F.sum("_k").over(inner))
    picks = hits.select(*keys, "_n", "_v", F.explode(F.filter("_rs", inside)).alias("_rank"))

    outs = []
    for out, (src, q, mode) in specs.items():
        mine = F.col("_m") == sources.index(src)
        lo, hi, frac = _ranks(F.col("_n"), q, mode)
        low = F.max(F.when(mine & (F.col("_rank") == lo), F.col("_v")))
        high = F.max(F.when(mine & (F.col("_rank") == hi), F.col("_v")))
        weight = F.max(F.when(mine, frac))
        outs.append(F.when((weight == 0) | (high == low), low).otherwise(low + (high - low) * weight).alias(out))
    return picks.groupBy(*by).agg(*outs)


def with_percentiles(grouped: DataFrame, df: DataFrame, by: list[str], specs: dict[str, tuple[str, float, str]]) -> DataFrame:
    """Attach percentile columns to an aggregate over the same groups."""
    pcts = percentiles(df, by, specs)
    if not by:
        return grouped.join(pcts, F.lit(True), "left")
    return join_back(grouped, pcts, by)
