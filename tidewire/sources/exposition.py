"""Text exposition of metrics: reading, writing, and the metric rows that jobs expose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.predicates import trusted
from tidewire.operators.aggregates import count_where, explode_reasons, sum_where
from tidewire.operators.quantiles import with_percentiles

c = F.col
SAMPLE = r'^\s*([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?\s*$'
PAIR = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'


def unescape(text: Column) -> Column:
    done = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    done = F.replace(F.replace(done, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(done, F.lit("\u0001"), F.lit("\\"))


def escape(text: Column) -> Column:
    done = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(done, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def read_exposition(lines: DataFrame, value: str = "value") -> DataFrame:
    """Samples of exposition lines; comments and unreadable lines are dropped."""
    body = F.regexp_extract(value, SAMPLE, 2)
    names, values = F.regexp_extract_all(body, F.lit(PAIR), 1), F.regexp_extract_all(body, F.lit(PAIR), 2)
    number = F.regexp_extract(value, SAMPLE, 3)
    d = lines.filter(c(value).rlike(SAMPLE) & ~c(value).startswith("#"))
    parsed = F.when(F.lower(number).isin("+inf", "inf"), F.lit(float("inf"))).when(F.lower(number) == "-inf", F.lit(float("-inf"))).otherwise(number.try_cast("double"))
    return d.select(F.regexp_extract(value, SAMPLE, 1).alias("metric"), F.map_from_arrays(names, F.transform(values, unescape)).alias("labels"), parsed.alias("value")).filter(c("value").isNotNull())


def label_text(labels: Column) -> Column:
    """Sorted, escaped label text; an empty set has no braces."""
    items = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    return F.when(F.size(items) == 0, "").otherwise(F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}")))


def number_text(value: Column) -> Column:
    """Whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def exposition_lines(samples: DataFrame) -> DataFrame:
    """One line per sample that has a value."""
    d = samples.filter(c("value").isNotNull())
    return d.select("metric", F.concat("metric", label_text(c("labels")), F.lit(" "), number_text(c("value"))).alias("line"))


def write_exposition(samples: DataFrame, path: str, helps: DataFrame | None = None) -> None:
    """Write sorted lines, one folder per metric; ``helps`` (metric, help, type) adds header lines."""
    lines = exposition_lines(samples).withColumn("_o", F.lit(1))
    if helps is not None:
        seen = lines.select("metric").distinct()
        head = helps.join(seen, "metric").select("metric", F.explode(F.array(
            F.concat(F.lit("# HELP "), "metric", F.lit(" "), "help"), F.concat(F.lit("# TYPE "), "metric", F.lit(" "), "type"))).alias("line"), F.lit(0).alias("_o"))
        lines = lines.unionByName(head)
    ordered = lines.repartitionByRange("metric", "_o", "line").sortWithinPartitions("metric", "_o", "line")
    ordered.select("metric", "line").write.mode("overwrite").partitionBy("metric").text(path)


def render_stream_metrics(streams: DataFrame, by: list[str]) -> DataFrame:
    """Stream metrics per low-cardinality label set: counts over all, quality over trusted streams."""
    ok = trusted(c("measurement_mode"), c("packet_count"))
    d = streams.withColumns({"_j": F.when(ok, c("jitter_ms")), "_p50": F.when(ok, c("interarrival_p50_ms")), "_p95": F.when(ok, c("interarrival_p95_ms"))})
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("streams"), F.sum("packet_count").cast("double").alias("packets"), F.sum("byte_count").cast("double").alias("bytes"),
        count_where(ok).cast("double").alias("trusted_streams"), sum_where(ok, c("expected_packets")).cast("double").alias("expected_packets"),
        sum_where(ok, c("lost_packets")).cast("double").alias("lost_packets"), F.max(F.when(ok, c("interarrival_max_ms"))).alias("interarrival_max_ms"),
        count_where(c("dscp_mismatch")).cast("double").alias("dscp_mismatch_streams"))
    g = with_percentiles(g, d, by, {"jitter_ms": ("_j", 0.5, "cont"), "interarrival_p50_ms": ("_p50", 0.5, "nearest"), "interarrival_p95_ms": ("_p95", 0.95, "nearest")})
    g = g.withColumn("loss_ratio", F.try_divide("lost_packets", "expected_packets"))
    names = [x for x in g.columns if x not in by]
    items = F.array(*[F.struct(F.lit(f"stream_{x}").alias("metric"), c(x).alias("value")) for x in names])
    long = g.select(*by, F.explode(items).alias("_m")).select(*by, "_m.*").filter(c("value").isNotNull())
    return long


def render_rejections(streams: DataFrame, by: list[str], reasons: str) -> DataFrame:
    d = explode_reasons(streams.filter(c("measurement_mode") == "rtp_candidate_rejected").select(*by, reasons), reasons)
    return d.groupBy(*by, "reason").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("metric", F.lit("stream_rejected"))


def unpivot_metrics(df: DataFrame, by: list[str], metrics: dict[str, str]) -> DataFrame:
    """(metric, labels..., value) rows of wide columns; absent values are left out."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), c(col).cast("double").alias("value")) for m, col in metrics.items()])
    return df.select(*by, F.explode(items).alias("_m")).select(*by, "_m.*").filter(c("value").isNotNull())


def render_rf_metrics(snapshots: DataFrame, by: list[str], metrics: dict[str, str], thresholds: dict[int, str]) -> DataFrame:
    """Radio snapshots as metric rows, with one row per level threshold."""
    base = unpivot_metrics(snapshots, by, metrics).withColumn("threshold_dbm", F.lit(""))
    items = F.array(*[F.struct(F.lit("neighbor_high_rssi_total").alias("metric"), F.lit(str(t)).alias("threshold_dbm"), c(col).cast("double").alias("value")) for t, col in thresholds.items()])
    high = snapshots.select(*by, F.explode(items).alias("_m")).select(*by, "_m.*").filter(c("value").isNotNull())
    return base.unionByName(high)


def render_client_metrics(clients: DataFrame, by: list[str], metrics: dict[str, str], state: str, states: list[str]) -> DataFrame:
    """Client snapshots as metric rows, with the state one-hot over its vocabulary."""
    base = unpivot_metrics(clients, by, metrics).withColumn("state", F.lit(""))
    items = F.array(*[F.struct(F.lit("client_state").alias("metric"), F.lit(s).alias("state"), (c(state) == s).cast("double").alias("value")) for s in states])
    hot = clients.select(*by, F.explode(items).alias("_m")).select(*by, "_m.*")
    return base.unionByName(hot)
