"""Survey-validation views: runs, candidate and completed matches, outliers, alignment, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalars import json_has, json_length, local_date, local_text, scope_of
from tidewire.operators.aggregates import count_where, ordered_lines, scope_panel, sum_where
from tidewire.operators.blocked import Order
from tidewire.operators.joins import rollup_left, zero_fill
from tidewire.operators.nearest import min_gap, nearest_join
from tidewire.operators.quantiles import with_percentiles
from tidewire.operators.windows import annotate_outliers, duplicates, top1
from tidewire.session import checkpointed

c = F.col


def rows_n() -> Column:
    """Rows of a group."""
    return F.count(F.lit(1))


DONE = ["complete", "missing_vendor_offset"]
LOCAL_ZONE = "America/Chicago"
SCOPE_PREFIXES = {"ipad_": "ipad"}
DEFAULT_SCOPE = "badge"
FILE_ROLES = {"badge_file": "badge_log", "survey_file": "survey_json", "manual_csv": "manual_csv", "client_detail_file": "client_detail"}
CHECKPOINT_LABEL = "Checkpoint before restoring "


def run_scope(run_id: str = "test_run_id") -> Column:
    return scope_of(c(run_id), SCOPE_PREFIXES, DEFAULT_SCOPE)


def _exact(matches: DataFrame) -> DataFrame:
    return matches.filter((c("match_quality") == "exact_1s") & (c("manual_entry_status") == "complete") & c("calibrated_delta_db").isNotNull())


def _delta_stats(matches: DataFrame, by: list[str]) -> DataFrame:
    d = _exact(matches)
    v = "calibrated_delta_db"
    g = d.groupBy(*by).agg(rows_n().alias("sample_count"), F.avg(v).alias("mean_calibrated_delta_db"), F.stddev_samp(v).alias("stddev_calibrated_delta_db"))
    return with_percentiles(g, d, by, {"p05_calibrated_delta_db": (v, 0.05, "cont"), "p95_calibrated_delta_db": (v, 0.95, "cont"),
                                       "p95_abs_calibrated_delta_db": ("absolute_calibrated_delta_db", 0.95, "cont")})


def stats_by_floor_band(matches: DataFrame) -> DataFrame:
    return _delta_stats(matches, ["test_run_id", "floor", "band"])


def stats_by_bssid(matches: DataFrame) -> DataFrame:
    return _delta_stats(matches, ["test_run_id", "bssid", "ap_name", "channel", "band"])


def outliers(matches: DataFrame) -> DataFrame:
    """Complete matches against the statistics of exact matches of their run, floor and band; null and blank
    floors or bands form one group."""
    complete = matches.filter(c("manual_entry_status") == "complete")
    return annotate_outliers(complete, ["test_run_id", "floor", "band"], "calibrated_delta_db", sample=c("match_quality") == "exact_1s")


def pending_manual_entry(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Best pending candidate per (bssid, time) for which no completed match exists."""
    done = matches.filter(c("manual_entry_status").isin(DONE)).select(F.lower("bssid").alias("_key"), c("survey_time").alias("_at")).distinct()
    d = candidates.filter(c("manual_entry_status") == "pending").withColumn("_key", F.lower("bssid"))
    d = d.join(done, (d["_key"] == done["_key"]) & (d["survey_time"] == done["_at"]), "left_anti")
    best = top1(d, ["_key", "survey_time"], [("badge_selected", "desc"), ("badge_score", "desc"), ("badge_rssi_dbm", "desc"), ("id", "asc")])
    return best.withColumn("survey_time", local_text(c("survey_time"), LOCAL_ZONE)).withColumnRenamed("id", "candidate_match_id").drop("_key")


def completed_manual_entry(matches: DataFrame, observations: DataFrame) -> DataFrame:
    o = observations.select(c("id").alias("observation_id"), "notes", "entered_by", c("created_at").alias("entered_at"))
    d = matches.filter(c("manual_entry_status").isin(DONE)).join(o, "observation_id", "left")
    return d.withColumn("survey_time", local_text(c("survey_time"), LOCAL_ZONE)).withColumnRenamed("id", "match_id")


def current_study(runs: DataFrame, events: DataFrame, points: DataFrame, candidates: DataFrame, matches: DataFrame, observations: DataFrame,
                  archives: DataFrame, meta: DataFrame) -> DataFrame:
    """Totals of each study scope over its live runs."""
    alive = runs.filter(c("deleted_at").isNull())
    ids = alive.select("test_run_id")
    scope = run_scope().alias("study_scope")

    def live(df: DataFrame) -> DataFrame:
        return df.join(ids, "test_run_id", "left_semi")

    complete = (c("manual_entry_status") == "complete") & c("calibrated_delta_db").isNotNull()
    mean = lambda cond: F.avg(F.when(cond, c("calibrated_delta_db")))
    frames = [
        meta,
        alive.groupBy(scope).agg(rows_n().alias("test_run_count"), F.min("created_at").alias("first_run_created_at"), F.max("created_at").alias("last_run_created_at")),
        live(events).groupBy(scope).agg(rows_n().alias("scan_event_count"), F.min("event_time").alias("first_scan_time"), F.max("event_time").alias("last_scan_time")),
        live(points).groupBy(scope).agg(rows_n().alias("survey_point_count"), F.min("measured_at").alias("first_survey_time"), F.max("measured_at").alias("last_survey_time")),
        live(candidates).groupBy(scope).agg(rows_n().alias("candidate_match_count"), count_where(c("manual_entry_status") == "pending").alias("pending_candidate_match_count")),
        live(matches).groupBy(scope).agg(
            count_where(c("manual_entry_status").isin(DONE)).alias("completed_match_count"), count_where(c("manual_entry_status") == "complete").alias("complete_match_count"),
            count_where(c("manual_entry_status") == "missing_vendor_offset").alias("missing_vendor_offset_match_count"), mean(complete).alias("mean_calibrated_delta_db"),
            mean(complete & (c("band") == "2.4GHz")).alias("mean_24ghz_calibrated_delta_db"), mean(complete & (c("band") == "5GHz")).alias("mean_5ghz_calibrated_delta_db")),
        live(observations).groupBy(scope).agg(rows_n().alias("manual_observation_count")),
        _real_archives(archives).groupBy("study_scope").agg(rows_n().alias("archive_count"), F.max("archived_at").alias("latest_archived_at")),
    ]
    zeros = ["test_run_count", "scan_event_count", "survey_point_count", "candidate_match_count", "pending_candidate_match_count", "completed_match_count",
             "complete_match_count", "missing_vendor_offset_match_count", "manual_observation_count", "archive_count"]
    return scope_panel(runs.sparkSession, [DEFAULT_SCOPE, "ipad"], frames, zeros, key="study_scope")


def _real_archives(archives: DataFrame) -> DataFrame:
    return archives.filter(~F.coalesce("archive_label", F.lit("")).startswith(CHECKPOINT_LABEL))


def archive_selection(selections: DataFrame, archives: DataFrame) -> DataFrame:
    """Selected archives, with the number of sources of a combined one."""
    a = _real_archives(archives).drop("study_scope")
    d = selections.join(a, "archive_id")
    n = F.when(json_has(c("payload"), "combined_from"), F.coalesce(json_length(c("payload"), "$.combined_from"), F.lit(0)))
    return d.withColumn("source_archive_count", n).drop("payload")


def _display_name() -> Column:
    return F.coalesce("display_name", "file_name", "file_path")


def input_files(files: DataFrame, run_files_df: DataFrame, runs: DataFrame) -> DataFrame:
    used = run_files_df.join(runs.select("test_run_id", "deleted_at"), "test_run_id").groupBy("input_file_id").agg(
        rows_n().alias("selected_run_count"), count_where(c("deleted_at").isNull()).alias("active_selected_run_count"), F.max("selected_at").alias("last_selected_at"))
    d = rollup_left(files, used, ["input_file_id"], ["selected_run_count", "active_selected_run_count"])
    return d.withColumn("display_name", _display_name())


def run_files(run_files_df: DataFrame, runs: DataFrame, studies_df: DataFrame, files: DataFrame) -> DataFrame:
    d = run_files_df.join(runs.select("test_run_id", "study_id"), "test_run_id").join(studies_df.select("study_id", "project_id"), "study_id", "left")
    f = files.withColumn("display_name", _display_name()).withColumnRenamed("notes", "input_file_notes")
    return d.join(f, "input_file_id").withColumn("study_scope", run_scope())


RUN_COUNTS = ["scan_event_count", "survey_point_count", "candidate_match_count", "pending_candidate_match_count", "completed_match_count", "manual_observation_count"]


def runs_view(runs: DataFrame, studies_df: DataFrame, projects_df: DataFrame, files: DataFrame, run_files_df: DataFrame, events: DataFrame,
              points: DataFrame, candidates: DataFrame, matches: DataFrame, observations: DataFrame) -> DataFrame:
    """Runs with their files and the counts of every child table."""
    key = ["test_run_id"]
    sel = run_files_df.join(files.withColumn("_name", _display_name()).select("input_file_id", "_name", "file_path"), "input_file_id")
    parts = [sel.groupBy(*key).agg(rows_n().alias("selected_file_count"))]
    parts += [ordered_lines(sel, key, c("_name"), ["selected_at", "file_path"], c("source_role") == role, out) for out, role in FILE_ROLES.items()]
    parts += [
        events.groupBy(*key).agg(rows_n().alias("scan_event_count")), points.groupBy(*key).agg(rows_n().alias("survey_point_count")),
        candidates.groupBy(*key).agg(rows_n().alias("candidate_match_count"), count_where(c("manual_entry_status") == "pending").alias("pending_candidate_match_count")),
        matches.groupBy(*key).agg(count_where(c("manual_entry_status").isin(DONE)).alias("completed_match_count")),
        observations.groupBy(*key).agg(rows_n().alias("manual_observation_count"))]
    s = studies_df.select("study_id", "study_name", "study_type", "study_status", "project_id", c("study_scope").alias("_scope"))
    p = projects_df.select("project_id", "project_name", "project_type")
    d = runs.join(s, "study_id", "left").join(p, "project_id", "left")
    for part in parts:
        d = d.join(part, key, "left")
    d = d.withColumns({
        "study_scope": F.coalesce("_scope", run_scope()), "run_name": F.coalesce("run_name", "test_run_id"),
        "run_status": F.coalesce("run_status", F.when(c("deleted_at").isNotNull(), "deleted").otherwise("complete")),
        "run_notes": F.coalesce("run_notes", "notes", F.lit(""))}).drop("_scope")
    return zero_fill(d, ["selected_file_count", *RUN_COUNTS])


def studies_view(studies_df: DataFrame, projects_df: DataFrame, run_rows: DataFrame) -> DataFrame:
    alive = c("deleted_at").isNull()
    g = run_rows.groupBy("study_id").agg(
        count_where(alive).alias("active_run_count"), rows_n().alias("total_run_count"), F.min(F.when(alive, c("created_at"))).alias("first_run_created_at"),
        F.max(F.when(alive, c("created_at"))).alias("last_run_created_at"), *[sum_where(alive, c(k)).alias(k) for k in RUN_COUNTS])
    d = studies_df.join(projects_df.select("project_id", "project_name", "project_type"), "project_id")
    return rollup_left(d, g, ["study_id"], ["active_run_count", "total_run_count", *RUN_COUNTS])


def projects_view(projects_df: DataFrame, study_rows: DataFrame) -> DataFrame:
    alive = c("deleted_at").isNull()
    g = study_rows.groupBy("project_id").agg(
        count_where(alive).alias("active_study_count"), rows_n().alias("total_study_count"), sum_where(alive, c("active_run_count")).alias("active_run_count"),
        F.sum("total_run_count").alias("total_run_count"), *[sum_where(alive, c(k)).alias(k) for k in RUN_COUNTS])
    return rollup_left(projects_df, g, ["project_id"], ["active_study_count", "total_study_count", "active_run_count", "total_run_count", *RUN_COUNTS])


def project_completed_matches(matches: DataFrame, runs: DataFrame, studies_df: DataFrame, projects_df: DataFrame, observations: DataFrame) -> DataFrame:
    alive = lambda df: df.filter(c("deleted_at").isNull())
    r = alive(runs).select("test_run_id", F.coalesce("run_name", "test_run_id").alias("run_name"), "study_id")
    s = alive(studies_df).select("study_id", "study_name", "study_scope", "project_id")
    p = alive(projects_df).select("project_id", "project_name")
    o = observations.select(c("id").alias("observation_id"), "entered_by", c("created_at").alias("entered_at"))
    d = matches.filter(c("manual_entry_status").isin(DONE)).join(r, "test_run_id").join(s, "study_id").join(p, "project_id").join(o, "observation_id", "left")
    return d.withColumnsRenamed({"id": "match_id", "created_at": "match_created_at"})


def _datapoint_key() -> list[Column]:
    return [c("project_id"), c("survey_time"), F.lower("bssid"), F.coalesce("channel", F.lit(-1)), F.coalesce("badge_mac", F.lit("")),
            c("badge_rssi_dbm"), c("survey_rssi_dbm")]


DATAPOINT_ORDER = Order("entered_at", ("-match_created_at", "-match_id"), desc=True)


def project_duplicate_datapoints(completed: DataFrame) -> DataFrame:
    """Completed matches entered more than once, newest entry first."""
    d = duplicates(completed, _datapoint_key(), DATAPOINT_ORDER)
    return d.withColumn("duplicate_reason", F.lit("same_project_time_bssid_channel_badge_and_survey_rssi"))


def project_canonical_matches(completed: DataFrame) -> DataFrame:
    """The newest entry of each datapoint."""
    return duplicates(completed, _datapoint_key(), DATAPOINT_ORDER, keep="canonical").withColumnRenamed("duplicate_rank", "canonical_rank")


def run_alignment(runs: DataFrame, events: DataFrame, points: DataFrame) -> DataFrame:
    """How scan events and survey points of each run meet in time."""
    zone = runs.select("test_run_id", "timezone", "default_match_window_seconds")
    ev, pt = events.join(zone, "test_run_id"), points.join(zone, "test_run_id")

    def side(df: DataFrame, ts: str, prefix: str) -> DataFrame:
        return df.groupBy("test_run_id").agg(rows_n().alias(f"{prefix}_count"), F.min(ts).alias(f"{prefix}_first_time"), F.max(ts).alias(f"{prefix}_last_time"),
                                             F.count_distinct(local_date(c(ts), c("timezone"))).alias(f"{prefix}_date_count"))

    a = ev.withColumn("_d", local_date(c("event_time"), c("timezone"))).select("test_run_id", "_d", "event_time", c("event_id").alias("_eid"))
    b = pt.withColumn("_d", local_date(c("measured_at"), c("timezone"))).select("test_run_id", "_d", "measured_at", "default_match_window_seconds")
    # read by the counts and by both passes of the percentiles, so it is written once
    near = checkpointed(nearest_join(b, a, ["test_run_id", "_d"], point_ts="measured_at", event_ts="event_time", event_id="_eid", tz=None))
    v = "nearest_abs_delta"
    g = near.groupBy("test_run_id").agg(rows_n().alias("same_date_survey_point_count"), count_where(c(v) <= c("default_match_window_seconds")).alias("matched_survey_point_count"),
                                        F.min(v).alias("nearest_delta_min_seconds"))
    g = with_percentiles(g, near, ["test_run_id"], {"nearest_delta_p50_seconds": (v, 0.5, "cont"), "nearest_delta_p90_seconds": (v, 0.9, "cont")})
    d = zone.join(side(ev, "event_time", "scan_event"), "test_run_id", "left").join(side(pt, "measured_at", "survey_point"), "test_run_id", "left").join(g, "test_run_id", "left")
    counts = ["scan_event_count", "scan_event_date_count", "survey_point_count", "survey_point_date_count", "same_date_survey_point_count", "matched_survey_point_count"]
    d = zero_fill(d, counts)
    status = (F.when(c("scan_event_count") == 0, "no_scan_events").when(c("survey_point_count") == 0, "no_survey_points")
              .when(c("same_date_survey_point_count") == 0, "no_same_date_overlap").when(c("matched_survey_point_count") == 0, "no_points_within_match_window")
              .otherwise("matched"))
    return d.withColumn("alignment_status", status)


def alignment_summary(points: DataFrame, events: DataFrame, by: list[str], point_ts: str, event_ts: str, event_id: str, window: float, tz: str) -> DataFrame:
    """Diagnostics of a run's time alignment: ranges, shared local dates, matches, floor-index percentiles of the
    nearest same-date deltas, the least delta over all dates, and why nothing matched."""
    def side(df: DataFrame, ts: str, p: str) -> DataFrame:
        return df.groupBy(*by).agg(rows_n().alias(f"{p}_count"), F.min(ts).alias(f"{p}_first"), F.max(ts).alias(f"{p}_last"))

    near = checkpointed(nearest_join(points, events, by, point_ts=point_ts, event_ts=event_ts, event_id=event_id, tz=tz))
    d = "nearest_abs_delta"
    matched = near.groupBy(*by).agg(count_where(c(d) <= window).alias("matched_points"), F.min(d).alias("delta_min"), rows_n().alias("comparable_points"))
    matched = with_percentiles(matched, near, by, {"delta_p50": (d, 0.5, "floor"), "delta_p90": (d, 0.9, "floor")})
    days = lambda df, ts: df.select(*by, local_date(c(ts), tz).alias("_day")).distinct()
    shared = days(points, point_ts).join(days(events, event_ts), [*by, "_day"]).groupBy(*by).agg(rows_n().alias("shared_dates"))
    any_date = min_gap(points, events, by, left_ts=point_ts, right_ts=event_ts, right_id=event_id).withColumnRenamed("min_gap_seconds", "delta_any_date")
    keys = points.select(*by).unionByName(events.select(*by)).distinct()
    out = keys
    for part in (side(points, point_ts, "point"), side(events, event_ts, "event"), matched, shared, any_date):
        out = out.join(part, by, "left")
    out = zero_fill(out, ["point_count", "event_count", "matched_points", "comparable_points", "shared_dates"])
    reason = F.when(c("matched_points") == 0, F.when(c("event_count") == 0, "no_scan_events").when(c("point_count") == 0, "no_survey_points")
                    .when(c("shared_dates") == 0, "no_same_date_overlap").when(c("comparable_points") > 0, "outside_match_window").otherwise("no_comparable_points"))
    return out.withColumn("unmatched_reason", reason)


def manual_samples(samples: DataFrame, studies_df: DataFrame) -> DataFrame:
    return samples.join(studies_df.select("study_id", "study_name", "project_id"), "study_id", "left")
