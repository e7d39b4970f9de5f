"""Time-series operators over samples and instant vectors.

Samples are ``(metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE)``.
An instant vector is ``(labels MAP<STRING,STRING>, value DOUBLE)`` with one row per
label set. A label that is absent equals the empty string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalars import clamp_min
from tidewire.operators.aggregates import histogram_quantile as _bucket_quantile
from tidewire.operators.blocked import Order, scan
from tidewire.operators.quantiles import percentiles


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\,=])", r"\\$1")


def series_key(labels: Column | str) -> Column:
    """Canonical text of a label set: sorted ``name=value`` entries, commas, equals signs and backslashes in them escaped."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(_escaped(e["key"]), F.lit("="), _escaped(e["value"]))), ",")


def label(name: str) -> Column:
    return F.coalesce(F.col("labels")[name], F.lit(""))


def label_map(names: list[str]) -> Column:
    """Labels from columns of the same names, without the empty ones."""
    if not names:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names]))
    return F.map_filter(pairs, lambda k, v: v != "")


def without(labels: Column, name: str) -> Column:
    return F.map_filter(labels, lambda k, v: k != name)


def label_cols(vec: DataFrame, names: list[str]) -> DataFrame:
    return vec.select(*[label(n).alias(n) for n in names], "labels", "value")


# --- selection -------------------------------------------------------------

def select_series(samples: DataFrame, name: str | None = None, matchers: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Samples of a metric whose labels satisfy matchers (label, op, value); op is =, !=, =~ or !~ (anchored)."""
    cond = F.lit(True) if name is None else F.col("metric") == name
    for lab, op, want in matchers:
        have = label(lab)
        hit = have == want if op in ("=", "!=") else have.rlike(f"^(?:{want})$")
        cond = cond & (~hit if op.startswith("!") else hit)
    return samples.filter(cond)


def window_rows(samples: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Samples in (now - seconds, now]; the bound is a plain comparison, so it is pushed to the scan."""
    start = now - F.make_dt_interval(secs=F.lit(float(seconds)))
    return samples.filter((F.col("ts") > start) & (F.col("ts") <= now))


def instant(samples: DataFrame, now: Column, lookback: float = 300.0) -> DataFrame:
    """Latest sample per series within the lookback."""
    rows = window_rows(samples, now, lookback).withColumn("_series", series_key("labels"))
    return rows.groupBy("metric", "_series").agg(F.first("labels").alias("labels"), F.max("ts").alias("ts"),
                                                 F.max_by("value", "ts").alias("value")).drop("_series")


def range_eval(samples: DataFrame, start: Column, end: Column, step: float, lookback: float = 300.0) -> DataFrame:
    """Instant vectors on a step grid. Each sample names the few grid steps it can serve; the latest one
    per (series, step) wins, so nothing is crossed with the grid."""
    us = F.lit(1_000_000).cast("bigint")
    t, s0, s1 = F.unix_micros("ts"), F.unix_micros(start), F.unix_micros(end)
    stride = F.lit(int(step * 1_000_000)).cast("bigint")
    first = F.greatest(F.ceil((t - s0) / stride), F.lit(0))
    last = F.least(F.ceil((t + F.lit(int(lookback)) * us - s0) / stride) - 1, F.floor((s1 - s0) / stride))
    steps = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    rows = samples.withColumn("_k", F.explode(steps)).withColumn("_series", series_key("labels"))
    g = rows.groupBy("metric", "_series", "_k").agg(F.first("labels").alias("labels"), F.max_by("value", "ts").alias("value"))
    return g.select("metric", "labels", F.timestamp_micros(s0 + F.col("_k") * stride).alias("ts"), "value")


# --- counters --------------------------------------------------------------

def increase(samples: DataFrame, window: float, now: Column, extrapolate: bool = False, per_second: bool = False) -> DataFrame:
    """Counter increase per series over a window; a drop is a reset and counts the new value.

    A series needs two samples. ``extrapolate`` applies the boundary rule of the
    metric store; without it the increase is exactly what was observed.
    """
    rows = window_rows(samples, now, window).withColumn("_series", series_key("labels"))
    d = scan(rows, ["metric", "_series"], Order("ts"), lag={"_prev": "value"})
    step = F.when(F.col("value") < F.col("_prev"), F.col("value")).otherwise(F.col("value") - F.col("_prev"))
    g = d.groupBy("metric", "_series").agg(
        F.first("labels").alias("labels"), F.sum(step).alias("value"), F.count(F.lit(1)).alias("_n"),
        F.min(F.unix_micros("ts")).alias("_t0"), F.max(F.unix_micros("ts")).alias("_t1"), F.min_by("value", "ts").alias("_v0"),
    ).filter(F.col("_n") >= 2)
    value = F.col("value")
    if extrapolate:
        span = (F.col("_t1") - F.col("_t0")) / F.lit(1e6)
        mean_gap = span / (F.col("_n") - 1)
        lead = window - (F.unix_micros(now) - F.col("_t0")) / F.lit(1e6)
        trail = (F.unix_micros(now) - F.col("_t1")) / F.lit(1e6)
        lead = F.when(lead >= 1.1 * mean_gap, mean_gap / 2).otherwise(lead)
        trail = F.when(trail >= 1.1 * mean_gap, mean_gap / 2).otherwise(trail)
        to_zero = F.when((value > 0) & (F.col("_v0") >= 0), span * F.col("_v0") / value)
        lead = F.least(lead, F.coalesce(to_zero, lead))
        value = value * (span + lead + trail) / span
    if per_second:
        value = value / F.lit(float(window))
    return g.select("metric", "labels", value.alias("value"))


def rate(samples: DataFrame, window: float, now: Column, extrapolate: bool = False) -> DataFrame:
    """Per-second counter increase over a window."""
    return increase(samples, window, now, extrapolate, per_second=True)


def over_time(samples: DataFrame, how: str, window: float, now: Column) -> DataFrame:
    """``avg``, ``last``, ``max``, ``min``, ``sum`` or ``count`` of each series over a window."""
    fn = {"avg": F.avg("value"), "last": F.max_by("value", "ts"), "max": F.max("value"), "min": F.min("value"),
          "sum": F.sum("value"), "count": F.count("value").cast("double")}[how]
    rows = window_rows(samples, now, window).withColumn("_series", series_key("labels"))
    return rows.groupBy("metric", "_series").agg(F.first("labels").alias("labels"), fn.alias("value")).drop("_series")


def quantile_over_time(samples: DataFrame, q: float, window: float, at: Column) -> DataFrame:
    """Interpolated quantile of each series in a window that ends at a fixed instant."""
    rows = window_rows(samples, at, window).withColumn("_series", series_key("labels"))
    p = percentiles(rows, ["metric", "_series"], {"value": ("value", q, "cont")})
    own = rows.groupBy("metric", "_series").agg(F.first("labels").alias("labels"))
    return p.join(own, ["metric", "_series"]).select("metric", "labels", "value")


# --- aggregation across series --------------------------------------------

AGGS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop,
        "count": lambda c: F.count(c).cast("double"), "group": lambda c: F.max(F.lit(1.0))}


def series_agg(vec: DataFrame, how: str, by: list[str]) -> DataFrame:
    """Aggregate values across series, keeping the named labels; deviation is that of the population."""
    g = label_cols(vec, by).groupBy(*by).agg(AGGS[how]("value").alias("value"))
    if not by:
        g = g.filter(F.col("value").isNotNull() & (F.lit(how != "count") | (F.col("value") > 0)))
    return g.select(label_map(by).alias("labels"), "value")


def quantile_by(vec: DataFrame, q: float, by: list[str]) -> DataFrame:
    """Interpolated quantile across the series of an instant vector, for groups of any size."""
    g = percentiles(label_cols(vec, by), by, {"value": ("value", q, "cont")})
    return g.filter(F.col("value").isNotNull()).select(label_map(by).alias("labels"), "value")


def topk_by(vec: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """Greatest k samples per label group, whole label sets kept; equal values go by label text."""
    d = label_cols(vec, by).withColumn("_key", series_key("labels"))
    if k == 1:
        g = d.groupBy(*by).agg(F.min_by(F.struct("labels", "value"), F.struct(-F.col("value"), F.col("_key"))).alias("_r"))
        return g.select("_r.*")
    # Spark keeps at most k rows per group and task before it shuffles a rank that is filtered like this.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "_key"))
    return d.withColumn("_n", rank).filter(F.col("_n") <= k).select("labels", "value")


def histogram_quantile(vec: DataFrame, q: float) -> DataFrame:
    """Quantile of cumulative buckets labelled ``le``, per remaining label set."""
    rest = without(F.col("labels"), "le")
    d = vec.select(rest.alias("_rest"), series_key(rest).alias("_key"), label("le").alias("le"), "value")
    names = d.groupBy("_key").agg(F.first("_rest").alias("labels"))
    return _bucket_quantile(d, ["_key"], q, out="value").join(names, "_key").select("labels", "value").filter(F.col("value").isNotNull())


# --- label rewriting -------------------------------------------------------

def label_replace(vec: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    """Set a label from a capture of another one, only where the whole value matches; an empty result drops it."""
    have = label(src)
    made = F.regexp_replace(have, f"^(?:{regex})$", replacement)
    others = without(F.col("labels"), dst)
    changed = F.when(made == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(dst), made)))
    return vec.withColumn("labels", F.when(have.rlike(f"^(?:{regex})$"), changed).otherwise(F.col("labels")))


def rename_labels(vec: DataFrame, copies: dict[str, str], fixed: dict[str, str] | None = None) -> DataFrame:
    """Several label copies ``dst -> src`` and constant labels at once; an empty source leaves ``dst`` as it is."""
    names = [*copies, *(fixed or {})]
    values = [label(src) for src in copies.values()] + [F.lit(v) for v in (fixed or {}).values()]
    fresh = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values)), lambda k, v: v != "")
    return _overlay(vec, fresh)


def _overlay(vec: DataFrame, fresh: Column) -> DataFrame:
    """Put the entries of a map over the labels."""
    d = vec.withColumn("_new", fresh)
    kept = F.map_filter("labels", lambda k, v: ~F.array_contains(F.map_keys("_new"), k))
    return d.withColumn("labels", F.map_concat(kept, "_new")).drop("_new")


def identity_series(vec: DataFrame, by: list[str], value: float = 1.0) -> DataFrame:
    """One constant sample per label group, to carry labels into joins."""
    return label_cols(vec, by).select(*by).distinct().select(label_map(by).alias("labels"), F.lit(value).alias("value"))


def scale(vec: DataFrame, factor: float) -> DataFrame:
    return vec.withColumn("value", F.col("value") * F.lit(float(factor)))


def alias_series(samples: DataFrame, name: str) -> DataFrame:
    return samples.withColumn("metric", F.lit(name))


# --- vector matching -------------------------------------------------------

def _paired(left: DataFrame, right: DataFrame, on: list[str] | None) -> tuple[DataFrame, DataFrame]:
    def keyed(vec: DataFrame, side: str) -> DataFrame:
        key = series_key("labels") if on is None else F.concat_ws("\x1f", *[label(n) for n in on]) if on else F.lit("")
        return vec.select(key.alias("_key"), F.col("labels").alias(f"_{side}l"), F.col("value").alias(f"_{side}v"))
    return keyed(left, "l"), keyed(right, "r")


def _unique(side: DataFrame) -> DataFrame:
    """One row per key; a second one stops the job."""
    rest = [n for n in side.columns if n != "_key"]
    g = side.groupBy("_key").agg(F.first(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several series match the labels "), "_key"))).otherwise(F.col("_r"))
    return g.select("_key", one.alias("_r")).select("_key", "_r.*")


ARITH = {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "+": lambda a, b: a + b, "-": lambda a, b: a - b}


def vec_op(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None) -> DataFrame:
    """One-to-one arithmetic on matching labels; the result keeps the matched labels (all, when ``on`` is None).

    Several series of one side under the same labels are an error.
    """
    a, b = _paired(left, right, on)
    if on is not None:
        a, b = _unique(a), _unique(b)
    out = a.join(b, "_key").select(F.col("_ll").alias("labels"), ARITH[op](F.col("_lv"), F.col("_rv")).alias("value"))
    if on is None:
        return out
    return label_cols(out, on).select(label_map(on).alias("labels"), "value")


def vec_enrich(many: DataFrame, one: DataFrame, on: list[str], extra: list[str], op: str = "*") -> DataFrame:
    """Many-to-one arithmetic that copies labels from the 'one' side, on which several series under the same labels are an error."""
    a, b = _paired(many, one, on)
    j = a.join(_unique(b), "_key")
    kept = F.map_filter("_ll", lambda k, v: ~k.isin(extra))
    took = F.map_filter("_rl", lambda k, v: k.isin(extra) & (v != ""))
    return j.select(F.map_concat(kept, took).alias("labels"), ARITH[op](F.col("_lv"), F.col("_rv")).alias("value"))


def duplicate_matches(one: DataFrame, on: list[str]) -> DataFrame:
    """Label groups of a 'one' side that hold several series, which would make a match ambiguous."""
    return label_cols(one, on).groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def vec_and(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    a, b = _paired(left, right, on)
    return a.join(b, "_key", "left_semi").select(F.col("_ll").alias("labels"), F.col("_lv").alias("value"))


def vec_unless(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    a, b = _paired(left, right, on)
    return a.join(b, "_key", "left_anti").select(F.col("_ll").alias("labels"), F.col("_lv").alias("value"))


def vec_or(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Left samples, and right samples whose labels the left side lacks."""
    return left.select("labels", "value").unionByName(vec_unless(right, left, on))


def or_default(vec: DataFrame, value: float = 0.0) -> DataFrame:
    """A label-less global vector, or a constant when it is empty."""
    g = vec.agg(F.coalesce(F.max("value"), F.lit(float(value))).alias("value"))
    return g.select(F.create_map().cast("map<string,string>").alias("labels"), "value")


def compare(vec: DataFrame, op: str, scalar: float) -> DataFrame:
    from tidewire.functions.predicates import compare_filter
    return compare_filter(vec, op, scalar)


def clamp(vec: DataFrame, floor: float) -> DataFrame:
    return vec.withColumn("value", clamp_min(F.col("value"), floor))


# --- composed questions ----------------------------------------------------

def age_below(end_ts: DataFrame, now: Column, ttl: float) -> DataFrame:
    """Age in seconds of epoch-valued samples, only those younger than the limit."""
    age = F.unix_micros(now) / F.lit(1e6) - F.col("value")
    return end_ts.withColumn("value", age).filter(F.col("value") < ttl)


def fresh_gate(value: DataFrame, active: DataFrame, end_ts: DataFrame, now: Column, ttl: float, on: list[str]) -> DataFrame:
    """Positive values with a positive activity count and a sample end younger than the limit."""
    live = vec_and(compare(value, ">", 0), compare(active, ">", 0), on)
    return vec_and(live, age_below(end_ts, now, ttl), on)


def stale_count(value: DataFrame, active: DataFrame, end_ts: DataFrame, now: Column, ttl: float, on: list[str],
                unit: list[str], by: list[str]) -> DataFrame:
    """Units that are active but not fresh, counted per group."""
    live = vec_and(compare(value, ">", 0), compare(active, ">", 0), on)
    old = vec_unless(live, age_below(end_ts, now, ttl), on)
    return series_agg(series_agg(old, "max", unit), "count", by)


def retry_pct(retries: DataFrame, attempts: DataFrame, on: list[str] | None = None) -> DataFrame:
    """100 * retries / max(attempts, 1) where there were attempts."""
    pct = vec_op(scale(retries, 100), clamp(attempts, 1), "/", on)
    return vec_and(pct, compare(attempts, ">", 0), on)


def per_100(part: DataFrame, whole: DataFrame, on: list[str] | None = None) -> DataFrame:
    return vec_op(scale(part, 100), clamp(whole, 1), "/", on)


def ready_ratio(vec: DataFrame, by: list[str]) -> DataFrame:
    return vec_op(series_agg(vec, "sum", by), clamp(series_agg(vec, "count", by), 1), "/")


def not_ready(vec: DataFrame, by: list[str]) -> DataFrame:
    return vec_op(series_agg(vec, "count", by), series_agg(vec, "sum", by), "-")


def replication_lag(candidates: list[DataFrame], now: Column) -> DataFrame:
    """Present minus the greatest timestamp of the first metric that has samples."""
    lags = [series_agg(v, "max", []).withColumn("value", F.unix_micros(now) / F.lit(1e6) - F.col("value")) for v in candidates]
    return reduce(vec_or, lags)


def series_inventory(samples: DataFrame, declared: DataFrame) -> DataFrame:
    """Metrics that are declared but absent, or present but not declared."""
    seen = samples.select("metric").distinct()
    missing = declared.select("metric").distinct().join(seen, "metric", "left_anti").withColumn("finding", F.lit("declared_not_seen"))
    extra = seen.join(declared, "metric", "left_anti").withColumn("finding", F.lit("seen_not_declared"))
    return missing.unionByName(extra)


def label_values(samples: DataFrame, metric: str, name: str, matchers: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Distinct values of a label of a metric."""
    rows = select_series(samples, metric, matchers)
    return rows.select(label(name).alias("label_value")).filter(F.col("label_value") != "").distinct()
