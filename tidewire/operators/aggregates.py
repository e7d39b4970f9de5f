"""Grouped aggregates. All are partial-then-final: rows combine before the shuffle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalars import clamp_min, safe_ratio
from tidewire.operators.blocked import Order, join_back, scan
from tidewire.operators.quantiles import percentiles, with_percentiles

# The two normal quantiles in use, kept apart by name.
Z95_SHORT = 1.96
Z95_FULL = 1.959963984540054


def basic(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Count of rows; sum, mean, least and greatest of a column."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"), F.avg(col).alias("mean"),
        F.min(col).alias("low"), F.max(col).alias("high"),
    )


def count_where(cond: Column) -> Column:
    """FILTERed count: rows for which the condition is true."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def sum_where(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value))


def agg_if(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])


def count_distinct(df: DataFrame, by: list[str], col: str, where: Column | None = None, out: str = "distinct_count") -> DataFrame:
    value = F.col(col) if where is None else F.when(where, F.col(col))
    return df.groupBy(*by).agg(F.count_distinct(value).alias(out))


def pctl_cont(df: DataFrame, by: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles ``out -> q``."""
    return percentiles(df, by, {o: (col, q, "cont") for o, q in qs.items()})


def pctl_nearest_rank(df: DataFrame, by: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    return percentiles(df, by, {o: (col, q, "nearest") for o, q in qs.items()})


def pctl_floor_index(df: DataFrame, by: list[str], col: str, qs: dict[str, float]) -> DataFrame:
    return percentiles(df, by, {o: (col, q, "floor") for o, q in qs.items()})


def stddev_sample(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_samp(col).alias("sd"))


def stddev_population(df: DataFrame, by: list[str], col: str) -> DataFrame:
    return df.groupBy(*by).agg(F.stddev_pop(col).alias("sd"))


def mean_ci(df: DataFrame, by: list[str], col: str, z: float, population: bool) -> DataFrame:
    """Mean, standard error and confidence bounds; the deviation kind and z are explicit."""
    sd = F.stddev_pop(col) if population else F.stddev_samp(col)
    g = df.groupBy(*by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), sd.alias("sd"))
    sem = F.col("sd") / F.sqrt("n")
    return g.select(*by, "n", "mean", "sd", sem.alias("sem"), (F.col("mean") - z * sem).alias("ci_low"),
                    (F.col("mean") + z * sem).alias("ci_high"))


def describe_metric(df: DataFrame, by: list[str], col: str, flavour: str = "study") -> DataFrame:
    """Summary statistics of a column per group.

    ``study``: full z, no deviation for one value, everything rounded to 6 places.
    ``rf``: short z, zero deviation for one value, unrounded, with p90.
    """
    study = flavour == "study"
    g = df.groupBy(*by).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"),
        F.var_samp(col).alias("variance"), F.min(col).alias("low"), F.max(col).alias("high"),
    )
    if not study:
        for c in ("sd", "variance"):
            g = g.withColumn(c, F.when(F.col("n") > 0, F.coalesce(F.col(c), F.lit(0.0))))
    qs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95} if study else \
         {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    g = with_percentiles(g, df, by, {o: (col, q, "cont") for o, q in qs.items()})
    z = Z95_FULL if study else Z95_SHORT
    sem = F.col("sd") / F.sqrt("n")
    out = {c: F.col(c) for c in ("mean", "sd", "variance", "low", "high", *qs)}
    out["range"] = F.col("high") - F.col("low")
    out["iqr"] = F.col("p75") - F.col("p25")
    out["sem"] = sem
    out["ci_low"] = F.col("mean") - z * sem
    out["ci_high"] = F.col("mean") + z * sem
    if study:
        out = {k: F.round(v, 6) for k, v in out.items()}
    return g.select(*by, "n", *[c.alias(n) for n, c in out.items()])


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, out: str = "weighted_mean") -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias(out))


def any_true(df: DataFrame, by: list[str], cond: Column, out: str = "seen") -> DataFrame:
    return df.groupBy(*by).agg(F.bool_or(cond).alias(out))


def string_list(df: DataFrame, by: list[str], col: str, sep: str = ", ", out: str = "items") -> DataFrame:
    """Distinct values in order, joined; duplicates go before the values of a group meet."""
    pairs = df.select(*by, col).distinct()
    return pairs.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(col)), sep).alias(out))


def ordered_lines(df: DataFrame, by: list[str], text: Column, order: list[str], where: Column, out: str) -> DataFrame:
    """Texts of the rows that satisfy a condition, in order, one per line."""
    item = F.when(where, F.struct(*order, text.alias("_text")))
    rows = F.array_sort(F.collect_list(item))
    return df.groupBy(*by).agg(F.nullif(F.array_join(F.transform(rows, lambda r: r["_text"]), "\n"), F.lit("")).alias(out))


def ordered_parts(df: DataFrame, by: list[str], text: Column, order: Order, where: Column | None = None, size: int = 1000, sep: str = "\n") -> DataFrame:
    """Long form of an ordered list: (``by``, part, first_item, n_items, items), at most ``size`` texts a part, parts numbered from 0.

    Texts are numbered within their group by a scan, which deals out heavy groups by ranges, and gathered part by part, so a cell is bounded
    whatever the size of its group. Equal places go by text. Rows that fail the condition and null texts have no place; a group without any has no part.
    """
    if size < 1:
        raise ValueError("a part holds at least one text")
    kept = df if where is None else df.filter(where)
    places = [order.col, *[t.removeprefix("-") for t in order.ties]]
    named = kept.select(*by, *[c for c in places if c not in by], text.alias("_text")).filter(F.col("_text").isNotNull())
    numbered = scan(named, by, replace(order, ties=(*order.ties, "_text")), number="_no")
    part = F.floor((F.col("_no") - 1) / size).cast("bigint").alias("part")
    cell = F.array_sort(F.collect_list(F.struct("_no", "_text")))
    return numbered.groupBy(*by, part).agg(
        F.min("_no").alias("first_item"), F.count(F.lit(1)).alias("n_items"), F.array_join(F.transform(cell, lambda x: x["_text"]), sep).alias("items"))


def distinct_parts(df: DataFrame, by: list[str], col: str, size: int = 1000, sep: str = ", ") -> DataFrame:
    """Long form of ``string_list``: the distinct values in order, in parts as of ``ordered_parts``."""
    return ordered_parts(df.filter(F.col(col).isNotNull()).select(*by, col).distinct(), by, F.col(col).cast("string"), Order(col), size=size, sep=sep)


def set_sorted(col: str | Column) -> Column:
    """Sorted distinct values without null."""
    return F.array_sort(F.collect_set(col))


def pivot_roles(df: DataFrame, by: list[str], role: str, roles: list[str], cols: list[str]) -> DataFrame:
    """One column ``{role}_{col}`` per role and measure."""
    aggs = [F.max(F.when(F.col(role) == r, F.col(c))).alias(f"{r}_{c}") for c in cols for r in roles]
    return df.groupBy(*by).agg(*aggs)


def control_test_delta(wide: DataFrame, metrics: list[tuple[str, str, float]], control: str = "control", test: str = "test") -> DataFrame:
    """Long table of (metric, control, test, delta) from a pivoted row; each metric has a scale."""
    items = F.array(*[
        F.struct(
            F.lit(label).alias("metric"),
            (F.col(f"{control}_{col}").cast("double") * scale).alias("control_value"),
            (F.col(f"{test}_{col}").cast("double") * scale).alias("test_value"),
        )
        for label, col, scale in metrics
    ])
    long = wide.select(F.explode(items).alias("m")).select("m.*")
    return long.withColumn("delta", F.col("test_value") - F.col("control_value"))


def staged_rollup(df: DataFrame, by: list[str], sums: list[str], mins: list[str] = (), maxs: list[str] = (), members: str = "members") -> DataFrame:
    """One step up a hierarchy: counts add, first times take the least, last times the greatest."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias(members),
        *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs],
    )


def scope_panel(spark, scopes: list[str], frames: list[DataFrame], zeros: list[str], key: str = "scope") -> DataFrame:
    """A fixed list of scopes, each with its aggregates; counts of empty scopes read zero."""
    panel = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in scopes])).alias(key))
    for frame in frames:
        panel = panel.join(frame, key, "left")
    return panel.withColumns({z: F.coalesce(F.col(z), F.lit(0)) for z in zeros})


def mode_first(df: DataFrame, by: list[str], col: str, arrival: str, out: str = "mode") -> DataFrame:
    """Most frequent value; among equals, the one that arrived first."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"), F.min(arrival).alias("_first"))
    return counted.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("_n"), F.col("_first"))).alias(out))


def count_unique_by(df: DataFrame, by: list[str], col: str, out: str = "unique_count") -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(col).alias(out))


def adoption_ratio(df: DataFrame, by: list[str], member: str, adopted: Column, out: str = "adoption_ratio") -> DataFrame:
    """Adopted members over all members, each counted once; the denominator is at least 1."""
    g = df.groupBy(*by).agg(F.count_distinct(F.when(adopted, F.col(member))).alias("_a"), F.count_distinct(member).alias("_n"))
    return g.select(*by, (F.col("_a") / clamp_min(F.col("_n"), 1)).alias(out))


def histogram(df: DataFrame, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins over a domain; values outside go to the edge bins, empty bins read zero."""
    spark = df.sparkSession
    width = (hi - lo) / bins
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin")).withColumns(
        {"x0": F.lit(float(lo)) + F.col("bin") * width, "x1": F.lit(float(lo)) + (F.col("bin") + 1) * width})
    if hi == lo:
        slot = F.lit(0)
    else:
        slot = F.least(F.greatest(F.floor((F.col(col) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    counts = df.filter(F.col(col).isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float, le: str = "le", value: str = "value", out: str = "quantile") -> DataFrame:
    """Quantile from cumulative buckets with linear interpolation.

    A rank in the +Inf bucket gives the highest finite bound; a group without
    observations or without a +Inf bucket gives null. The buckets of one group
    are the few configured bounds.
    """
    bound = F.when(F.lower(F.col(le)).isin("+inf", "inf"), F.lit(float("inf"))).otherwise(F.col(le).cast("double"))
    merged = buckets.groupBy(*by, bound.alias("_le")).agg(F.sum(value).alias("_c"))
    arr = F.array_sort(F.collect_list(F.struct("_le", "_c")))
    g = merged.groupBy(*by).agg(arr.alias("_a"))
    total = F.element_at("_a", -1)["_c"]
    rank = total * q
    hit = F.element_at(F.filter("_a", lambda b: b["_c"] >= rank), 1)
    below = F.filter("_a", lambda b: b["_le"] < hit["_le"])
    start = F.when(F.size(below) > 0, F.element_at(below, -1)["_le"]).otherwise(F.lit(0.0))
    prev = F.when(F.size(below) > 0, F.element_at(below, -1)["_c"]).otherwise(F.lit(0.0))
    inside = F.when((F.size(below) == 0) & (hit["_le"] <= 0), hit["_le"]).otherwise(
        start + (hit["_le"] - start) * F.try_divide(rank - prev, hit["_c"] - prev))
    valid = (F.element_at("_a", -1)["_le"] == float("inf")) & (F.size("_a") > 1) & (total > 0)
    value_out = F.when(valid, F.when(hit["_le"] == float("inf"), start).otherwise(inside))
    return g.select(*by, value_out.alias(out))


def normalize_windows(windows: list, current: float | None = None) -> list[int]:
    """Sorted distinct whole-second windows of at least 1, with the current one."""
    found = set()
    for raw in [*windows, *([current] if current is not None else [])]:
        try:
            number = round(float(raw))
        except (TypeError, ValueError):
            continue
        if number >= 1:
            found.add(int(number))
    return sorted(found)


def tolerance_sweep(nearest: DataFrame, windows: list, delta: str, event: str, by: list[str] = ()) -> DataFrame:
    """Per window: matched points, near-edge points, and points whose event serves several points.

    The event counts come from a two-step aggregate, so an event that serves very
    many points is combined on the map side.
    """
    steps = normalize_windows(windows)
    size = F.abs(delta)
    wide = nearest.filter(F.col(delta).isNotNull()).select(
        *by, F.col(event).alias("_ev"), size.alias("_d"),
        F.explode(F.filter(F.array(*[F.lit(w) for w in steps]), lambda w: w >= size)).alias("window_seconds"))
    per_event = wide.groupBy(*by, "window_seconds", "_ev").agg(
        F.count(F.lit(1)).alias("_n"), count_where(F.col("_d") > 0.8 * F.col("window_seconds")).alias("_edge"))
    found = per_event.groupBy(*by, "window_seconds").agg(
        F.sum("_n").alias("matched_points"), F.sum("_edge").alias("near_edge_points"),
        F.sum(F.when(F.col("_ev").isNotNull() & (F.col("_n") > 1), F.col("_n")).otherwise(0)).alias("ambiguous_points"))
    keys = nearest.select(*by).distinct() if by else nearest.sparkSession.range(1).select()
    spine = keys.select("*", F.explode(F.array(*[F.lit(w) for w in steps])).alias("window_seconds"))
    zeros = ["matched_points", "near_edge_points", "ambiguous_points"]
    return join_back(spine, found, [*by, "window_seconds"]).withColumns({z: F.coalesce(F.col(z), F.lit(0)) for z in zeros})


def sweep_summary(nearest: DataFrame, delta: str, by: list[str] = ()) -> DataFrame:
    """Count, least, median and p90 of absolute deltas, and the signed median."""
    by = list(by)
    d = nearest.filter(F.col(delta).isNotNull()).withColumn("_abs", F.abs(delta))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("point_count"), F.min("_abs").alias("abs_min"))
    return with_percentiles(g, d, by, {"abs_median": ("_abs", 0.5, "cont"), "abs_p90": ("_abs", 0.9, "cont"),
                                       "signed_median": (delta, 0.5, "cont")})


def completion_percent(done: Column, pending: Column) -> Column:
    d, p = F.coalesce(done, F.lit(0)), F.coalesce(pending, F.lit(0))
    return F.when(d + p > 0, F.round(F.lit(100.0) * d / (d + p), 1))


def change_direction(low: Column, high: Column) -> Column:
    return (F.when(low.isNull() | high.isNull(), "changed").when(high > low, "increased")
            .when(high < low, "decreased").otherwise("held steady"))


def run_comparison(runs: DataFrame, matches: DataFrame, outliers: DataFrame, key: str, value: str) -> DataFrame:
    """Runs side by side: match statistics, outliers, completion percent."""
    stats = matches.groupBy(key).agg(F.avg(value).alias("mean_delta"), F.stddev_samp(value).alias("stddev_delta"),
                                     F.min(value).alias("min_delta"), F.max(value).alias("max_delta"))
    stats = with_percentiles(stats, matches, [key], {"p95_delta": (value, 0.95, "cont")})
    bad = outliers.groupBy(key).agg(F.count(F.lit(1)).alias("outlier_count"))
    out = runs.join(stats, key, "left").join(bad, key, "left")
    return out.withColumns({
        "outlier_count": F.coalesce("outlier_count", F.lit(0)),
        "completion_percent": completion_percent(F.col("completed_count"), F.col("pending_count")),
    })


def comparison_trend(compared: DataFrame, by: list[str], window: str, run: str) -> DataFrame:
    """How candidates and outliers move from the narrowest to the widest window of a study."""
    usable = compared.filter(F.col(window).isNotNull())
    g = usable.groupBy(*by).agg(
        F.count_distinct(window).alias("window_count"),
        F.min_by(F.struct("candidate_count", "outlier_count"), F.struct(window, run)).alias("_lo"),
        F.min_by(F.struct("candidate_count", "outlier_count"), F.struct(-F.col(window), F.col(run))).alias("_hi"))
    many = F.col("window_count") >= 2
    return g.select(
        *by, "window_count",
        F.when(many, change_direction(F.col("_lo.candidate_count"), F.col("_hi.candidate_count"))).alias("candidate_direction"),
        F.when(many, change_direction(F.col("_lo.outlier_count"), F.col("_hi.outlier_count"))).alias("outlier_direction"))


def explode_reasons(df: DataFrame, reasons: str, out: str = "reason") -> DataFrame:
    """One row per reason; a row without reasons, or with a blank one, reads 'unspecified'."""
    return df.withColumn(out, F.explode_outer(reasons)).withColumn(
        out, F.coalesce(F.nullif(F.col(out), F.lit("")), F.lit("unspecified"))).drop(reasons)


def neighbor_stats(df: DataFrame, by: list[str], rssi: str, channel: str, thresholds: list[int]) -> DataFrame:
    """Neighbour levels per radio: extremes, mean, counts at thresholds, and the distinct channels."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("neighbor_count"), F.max(rssi).alias("strongest_dbm"), F.min(rssi).alias("weakest_dbm"),
        F.avg(rssi).alias("mean_dbm"),
        *[count_where(F.col(rssi) >= t).alias(f"ge_neg{abs(t)}") for t in thresholds],
        # the list has each channel once: a count of distinct ones would shuffle every pair of radio and channel
        F.size(set_sorted(channel)).cast("bigint").alias("unique_channels"),
        F.array_join(F.transform(set_sorted(channel), lambda c: c.cast("string")), ",").alias("channel_list"))


def state_counts(df: DataFrame, state: str, ts: str, success: list[str]) -> DataFrame:
    """Rows per state, and when the last success was."""
    return df.groupBy(F.coalesce(F.col(state), F.lit("unknown")).alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col(state).isin(success), F.col(ts))).alias("last_success"))


def compare_counters(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset difference both ways: rows whose counts differ."""
    both = left.select(*keys, F.lit(1).alias("_d"), F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(-1).alias("_d"), F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    g = both.groupBy(*keys).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"), F.sum("_d").alias("difference"))
    return g.filter(F.col("difference") != 0)


def downsample(df: DataFrame, order: Order, size: int, by: list[str] = ()) -> DataFrame:
    """Evenly spaced rows: of n > size rows those at index floor(i*n/size)."""
    d = scan(df, list(by), order, number="_i", total="_n")
    idx = F.col("_i") - 1
    # index k is taken when some i has floor(i*n/size) = k; the candidate i is ceil(k*size/n)
    cand = F.ceil(idx * size / F.col("_n"))
    take = (F.col("_n") <= size) | ((cand < size) & (F.floor(cand * F.col("_n") / size) == idx))
    return d.filter(take).drop("_i", "_n")


__all__ = [n for n in dir() if not n.startswith("_")] + ["safe_ratio"]
