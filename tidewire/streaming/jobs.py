"""Incremental and streaming jobs.

Batch forms are plain functions of frames. Stream forms use Structured Streaming:
windows with watermarks where the state is a window, ``foreachBatch`` over a
versioned state table where the state is one row per key. In the latter the work
of a micro-batch is the batch function, so a busy key is spread like any other.
Batch N reads the state that batch N-1 left of its own keys, and writes the keys that
it changes as a numbered version, and its output; so a replayed batch gives the
same result, and a batch costs what it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.predicates import is_future, relabel_keep
from tidewire.operators.aggregates import count_where
from tidewire.operators.blocked import Order, scan
from tidewire.operators.windows import latest_by
from tidewire.plans.maintenance import BatchLog, KeyedStore
from tidewire.session import checkpointed

c = F.col


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that is available through a batch function, then stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- ingest ----------------------------------------------------------------

def pending_inputs(inventory: DataFrame, ledger: DataFrame, config_hash: str, version: str) -> DataFrame:
    """Files whose path, size, time, configuration and parser version are not in the ledger."""
    key = ["path", "size_bytes", "mtime", "config_hash", "parser_version"]
    keyed = inventory.withColumns({"config_hash": F.lit(config_hash), "parser_version": F.lit(version)})
    return keyed.join(ledger.select(*key).distinct(), key, "left_anti")


def ingest_new(stream: DataFrame, checkpoint: str, log: BatchLog, keys: list[str], run: int = 0) -> StreamingQuery:
    """Append new input once: rows already stored under the same keys are dropped, also when a batch is replayed.

    The keys of the log are kept beside it, cut into buckets, of which a batch opens those that its own keys fall into; the log itself is not read.
    ``run`` numbers restarts with a fresh checkpoint, whose batches count from zero again.
    """
    ledger = KeyedStore(log.spark, f"{log.root}-keys", keys, buckets=64)

    def each(batch: DataFrame, batch_id: int) -> None:
        number = (run << 40) + batch_id
        stored = log.read(except_batch=number)
        if stored is not None and not ledger.versions():  # a log from before it had a ledger
            ledger.write(stored.select(*keys).distinct(), version=0)
        batch = checkpointed(batch)
        fresh = checkpointed(idempotent_append(batch, ledger.read(at_most=number, among=batch), keys))
        log.write(fresh, number)
        ledger.write(fresh.select(*keys), version=number + 1)
    return run_available(stream, checkpoint, each)


def idempotent_append(batch: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """Rows of a batch not stored yet, one per key."""
    once = batch.dropDuplicates(keys)
    return once if stored is None else once.join(stored.select(*keys), keys, "left_anti")


def stability_decisions(observations: DataFrame, path: str, ts: str, signature: list[str], min_gap: float, tie: str | None = None) -> DataFrame:
    """Decision at each look at an upload: wait_new, wait_changed, wait_too_soon or ready.

    The clock of an unchanged file runs from the first look at its present
    signature.
    """
    order = Order(ts, (tie,) if tie else ())
    d = observations.withColumn("_sig", F.struct(*signature))
    d = scan(d, [path], order, lag={"_before": "_sig"}, number="_n")
    same = (c("_n") > 1) & c("_sig").eqNullSafe(c("_before"))
    # written once: the second carry would otherwise compute the first one again
    d = checkpointed(d.withColumns({"_same": same, "_since0": F.when(~same, c(ts))}))
    d = scan(d, [path], order, ffill={"_since": "_since0"})
    waited = (F.unix_micros(ts) - F.unix_micros("_since")) / F.lit(1e6)
    decision = F.when(c("_n") == 1, "wait_new").when(~c("_same"), "wait_changed").when(waited < min_gap, "wait_too_soon").otherwise("ready")
    return d.withColumn("decision", decision).drop("_sig", "_before", "_n", "_same", "_since0", "_since")


def _with_history(batch: DataFrame, old: DataFrame | None, sink: BatchLog, batch_id: int, keys: list[str], ts: str, tie: str) -> DataFrame:
    """A batch after ``old``, the stored last rows of its keys; ``_out`` marks the rows to write.

    A key that gets a row older than its stored one comes back with all its rows, which are judged and written again. So the outcome does
    not depend on the order in which files arrive.
    """
    new = batch.withColumn("_out", F.lit(True))
    if old is None:
        return new
    at = F.struct(ts, tie)
    mine = old.select(*batch.columns)
    marks = mine.groupBy(*keys).agg(F.max(at).alias("_last"))
    late = checkpointed(batch.join(marks, keys).filter(at <= c("_last")).select(*keys).distinct())
    if not late.limit(1).count():
        return mine.withColumn("_out", F.lit(False)).unionByName(new)
    again = sink.latest([*keys, ts, tie], before=batch_id).select(*batch.columns).join(late, keys, "left_semi").withColumn("_out", F.lit(True))
    fresh = new.join(again.select(*keys, ts, tie), [*keys, ts, tie], "left_anti")
    return mine.join(late, keys, "left_anti").withColumn("_out", F.lit(False)).unionByName(again).unionByName(fresh)


def stream_stability(stream: DataFrame, checkpoint: str, state: KeyedStore, sink: BatchLog, path: str, ts: str, signature: list[str], min_gap: float, tie: str) -> StreamingQuery:
    """Decisions over a stream of looks, to be read with ``sink.latest``. State per upload: the first and the latest look at its present signature."""
    cols = [path, ts, tie, *signature]

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = _with_history(batch.select(*cols), state.read(at_most=batch_id, among=batch), sink, batch_id, [path], ts, tie)
        judged = checkpointed(stability_decisions(rows, path, ts, signature, min_gap, tie=tie))
        sink.write(judged.filter("_out").drop("_out"), batch_id)
        start = latest_by(judged.filter(c("decision").isin("wait_new", "wait_changed")), [path], ts, tie)
        last = latest_by(judged, [path], ts, tie)
        state.write(start.select(*cols).unionByName(last.select(*cols)).distinct(), version=batch_id + 1)
    return run_available(stream, checkpoint, each)


def split_late(df: DataFrame, ts: str, now: Column, skew: float, ttl: float) -> DataFrame:
    """Tag rows: 'future' beyond the skew, 'stale' beyond the time to live, else 'ok'."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1e6)
    return df.withColumn("lateness", F.when(is_future(c(ts), now, skew), "future").when(age >= ttl, "stale").otherwise("ok"))


# --- windows ---------------------------------------------------------------

def stream_avg(stream: DataFrame, keys: list[str], ts: str, value: str, window: str = "1 hour", watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Average per key and event-time window; works on a batch as well. On a stream it gives closed windows only; see ``stream_sums``."""
    d = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = d.groupBy(w.alias("w"), *keys).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))
    return g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *keys, "avg_value", "n")


def stream_sums(stream: DataFrame, checkpoint: str, log: BatchLog, keys: list[str], ts: str, value: str, window: str = "1 hour", slide: str | None = None) -> StreamingQuery:
    """Sums and counts per key and window of each micro-batch. ``merged_avg`` adds them up, so no row is ever too late and no window left open."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)

    def each(batch: DataFrame, batch_id: int) -> None:
        g = batch.groupBy(w.alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
        log.write(g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *keys, "total", "n"), batch_id)
    return run_available(stream, checkpoint, each)


def merged_avg(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Averages of all windows from the parts that batches wrote."""
    g = parts.groupBy("window_start", "window_end", *keys).agg(F.sum("total").alias("_t"), F.sum("n").alias("n"))
    return g.select("window_start", "window_end", *keys, F.try_divide("_t", "n").alias("avg_value"), "n")


def append_table(windowed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished windows as Parquet, exactly once."""
    return windowed.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counter_increments(rows: DataFrame, keys: list[str], ts: str, value: str, tie: str | None = None) -> DataFrame:
    """Increase since the previous sample of the key; a drop counts the new value, the first sample nothing."""
    d = scan(rows, keys, Order(ts, (tie,) if tie else ()), lag={"_prev": value})
    step = F.when(c(value) < c("_prev"), c(value)).otherwise(c(value) - c("_prev"))
    return d.withColumn("increment", step).drop("_prev")


def window_rate(increments: DataFrame, keys: list[str], ts: str, window: str = "5 minutes", slide: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Summed increments per sliding window and second."""
    d = increments.withWatermark(ts, watermark) if increments.isStreaming else increments
    g = d.filter(c("increment").isNotNull()).groupBy(F.window(ts, window, slide).alias("w"), *keys).agg(F.sum("increment").alias("_s"))
    seconds = F.unix_seconds(c("w.end")) - F.unix_seconds(c("w.start"))
    return g.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *keys, (c("_s") / seconds).alias("rate"))


def stream_counter(stream: DataFrame, checkpoint: str, state: KeyedStore, sink: BatchLog, keys: list[str], ts: str, value: str, tie: str,
                   step: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Carry counters over micro-batches: ``step`` sees each batch after the last sample of its keys.

    The last sample per key is kept as state, of which a batch reads and writes its own keys. Read the result with ``sink.latest``: a late sample
    rewrites its key's rows.
    """
    cols = [*keys, ts, tie, value]

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = checkpointed(_with_history(batch.select(*cols), state.read(at_most=batch_id, among=batch), sink, batch_id, keys, ts, tie))
        sink.write(step(rows).filter("_out").drop("_out"), batch_id)
        state.write(latest_by(rows.filter(c(value).isNotNull()).select(*cols), keys, ts, tie), version=batch_id + 1)
    return run_available(stream, checkpoint, each)


def stream_rate_increments(stream: DataFrame, checkpoint: str, state: KeyedStore, sink: BatchLog, keys: list[str], ts: str, value: str, tie: str) -> StreamingQuery:
    """Counter increments of a stream, to be summed by ``window_rate``."""
    return stream_counter(stream, checkpoint, state, sink, keys, ts, value, tie, lambda rows: counter_increments(rows, keys, ts, value, tie))


def stream_counter_delta(stream: DataFrame, checkpoint: str, state: KeyedStore, sink: BatchLog, keys: list[str], ts: str, value: str, tie: str) -> StreamingQuery:
    """Increase over the last known value, never below zero, over micro-batches."""
    from tidewire.operators.windows import counter_delta
    order = Order(ts, (tie,))
    return stream_counter(stream, checkpoint, state, sink, keys, ts, value, tie, lambda rows: counter_delta(rows, keys, order, value))


def stream_latest(stream: DataFrame, checkpoint: str, state: KeyedStore, keys: list[str], ts: str, tie: str) -> StreamingQuery:
    """Keep the newest row per key."""
    def each(batch: DataFrame, batch_id: int) -> None:
        old = state.read(at_most=batch_id, among=batch)
        rows = batch if old is None else old.unionByName(batch.select(*old.columns))
        state.write(latest_by(rows, keys, ts, tie), version=batch_id + 1)
    return run_available(stream, checkpoint, each)


def stream_relabel(stream: DataFrame, regex: str) -> DataFrame:
    """The forward filter on a stream; stateless."""
    return relabel_keep(stream, regex)


# --- alerts, health, intervals --------------------------------------------

def alerts(series: DataFrame, keys: list[str], ts: str, value: str, threshold: float, hold: float, no_data: float | None = None, tie: str | None = None) -> DataFrame:
    """State of an alert at each evaluation: normal, pending, or firing once the condition has held long enough.

    The condition is a value below the threshold; a null value (no data) also
    meets it. ``no_data`` seconds without an evaluation count as a fresh start
    of the condition right after the last evaluation.
    """
    order = Order(ts, (tie,) if tie else ())
    bad = c(value).isNull() | (c(value) < threshold)
    d = scan(series.withColumn("_bad", bad), keys, order, lag={"_was": "_bad", "_at": ts})
    gap = F.lit(False) if no_data is None else F.coalesce((F.unix_micros(ts) - F.unix_micros("_at")) / F.lit(1e6) > no_data, F.lit(False))
    begins = c("_bad") & (~F.coalesce("_was", F.lit(False)) | gap)
    first = F.when(begins & gap, c("_at")).when(begins, c(ts))
    d = checkpointed(d.withColumn("_start0", first))
    d = scan(d, keys, order, ffill={"_start": "_start0"})
    held = (F.unix_micros(ts) - F.unix_micros("_start")) / F.lit(1e6)
    state = F.when(~c("_bad"), "normal").when(held >= hold, "firing").otherwise("pending")
    return d.withColumns({"state": state, "since": F.when(c("_bad"), c("_start"))}).drop("_bad", "_was", "_at", "_start0", "_start")


def ingest_health(ledger: DataFrame, state: str, ts: str, now: Column, pending: list[str], retry: list[str], success: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """Backlog of an ingest ledger, and its quarantined rows per reason."""
    s = c(state)
    age = (F.unix_micros(now) - F.unix_micros(F.min(F.when(s.isin(pending), c(ts))))) / F.lit(1e6)
    total = ledger.agg(count_where(s.isin(pending)).alias("pending"), F.greatest(age, F.lit(0.0)).alias("oldest_pending_seconds"), count_where(s.isin(retry)).alias("retry_pending"),
                       F.max(F.when(s.isin(success), c(ts))).alias("last_success"))
    bad = ledger.filter(s == "quarantined").groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return total, bad


def open_intervals(events: DataFrame, keys: list[str], ts: str, is_start: Column, is_stop: Column, tie: str) -> DataFrame:
    """Intervals from each start to the next marker of its key.

    A stop ends the open interval. A start while one is open is a violation: the
    earlier interval gets no end. A stop without an open interval is dropped.
    """
    kind = F.when(is_start, "start").when(is_stop, "stop")
    d = events.withColumn("_kind", kind).filter(c("_kind").isNotNull())
    # the marker after a row is the marker before it when time runs backwards
    d = d.withColumn("_neg", -F.unix_micros(ts)).withColumn("_ntie", -c(tie))
    d = scan(d, keys, Order("_neg", ("_ntie",)), lag={"_next": "_kind", "_end": ts})
    return d.filter(c("_kind") == "start").select(
        *keys, c(tie).alias("start_id"), c(ts).alias("started_at"), F.when(c("_next") == "stop", c("_end")).alias("ended_at"),
        F.when(c("_next") == "stop", "closed").when(c("_next") == "start", "violation").otherwise("open").alias("status"))

