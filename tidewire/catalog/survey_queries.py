"""Survey-validation views over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.aggregate_queries import rounded
from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.registry import query
from tidewire.plans import survey_views as V

EXACT = "match_quality = 'exact_1s' and manual_entry_status = 'complete' and calibrated_delta_db is not null"
STATS = """count(*) as sample_count, round(avg(calibrated_delta_db), 6) as mean_calibrated_delta_db, round(stddev_samp(calibrated_delta_db), 6) as stddev_calibrated_delta_db,
 round(quantile_cont(calibrated_delta_db, 0.05), 6) as p05_calibrated_delta_db, round(quantile_cont(calibrated_delta_db, 0.95), 6) as p95_calibrated_delta_db, round(quantile_cont(absolute_calibrated_delta_db, 0.95), 6) as p95_abs_calibrated_delta_db"""
DONE = "manual_entry_status in ('complete', 'missing_vendor_offset')"
SCOPE = "case when test_run_id like 'ipad\\_%' escape '\\' then 'ipad' else 'badge' end"


def local(ts):
    return f"strftime(({ts} at time zone 'UTC') at time zone 'America/Chicago', '%Y-%m-%d %H:%M:%S')"


@query("v29_stats_by_floor_band", ctes("x_matches") + f"select test_run_id, floor, band, {STATS} from x_matches where {EXACT} group by 1, 2, 3")
def v29(t):
    return rounded(V.stats_by_floor_band(frame(t, "x_matches")))


@query("v30_stats_by_bssid", ctes("x_matches") + f"select test_run_id, bssid, ap_name, channel, band, {STATS} from x_matches where {EXACT} group by 1, 2, 3, 4, 5")
def v30(t):
    return rounded(V.stats_by_bssid(frame(t, "x_matches")))


@query("v31_outliers", ctes("x_matches") + f"""
, s as (select test_run_id, coalesce(floor, '') as f, coalesce(band, '') as b, count(*) as n, avg(calibrated_delta_db) as m, stddev_samp(calibrated_delta_db) as sd from x_matches where {EXACT} group by 1, 2, 3)
select id, badge_rssi_dbm, n as sample_count, round((calibrated_delta_db - m) / nullif(sd, 0), 5) as z_score, case when n < 30 then 'insufficient_samples' when sd is null or sd = 0 then 'no_variance'
  when abs((calibrated_delta_db - m) / sd) > 2 then 'outlier' else 'normal' end as outlier_status
from x_matches x join s on s.test_run_id = x.test_run_id and s.f = coalesce(floor, '') and s.b = coalesce(band, '') where manual_entry_status = 'complete'""")
def v31(t):
    return V.outliers(frame(t, "x_matches")).select("id", "badge_rssi_dbm", "sample_count", F.round("z_score", 5).alias("z_score"), "outlier_status")


@query("v32_pending_manual_entry", ctes("x_candidates", "x_matches") + f"""
, p as (select *, row_number() over (partition by lower(bssid), survey_time order by badge_selected desc, badge_score desc nulls last, badge_rssi_dbm desc nulls last, id) as rn from x_candidates c where manual_entry_status = 'pending'
  and not exists (select 1 from x_matches m where lower(m.bssid) = lower(c.bssid) and m.survey_time = c.survey_time and m.{DONE}))
select test_run_id, {local('survey_time')} as survey_time, bssid, badge_score, badge_rssi_dbm, id as candidate_match_id from p where rn = 1""")
def v32(t):
    return V.pending_manual_entry(frame(t, "x_candidates"), frame(t, "x_matches")).select("test_run_id", "survey_time", "bssid", "badge_score", "badge_rssi_dbm", "candidate_match_id")


@query("v33_completed_manual_entry", ctes("x_matches", "x_observations") + f"""
select m.id as match_id, m.test_run_id, {local('m.survey_time')} as survey_time, m.bssid, m.badge_rssi_dbm, o.notes, o.entered_by, o.created_at as entered_at, m.manual_entry_status
from x_matches m left join x_observations o on o.id = m.observation_id where m.{DONE}""")
def v33(t):
    return V.completed_manual_entry(frame(t, "x_matches"), frame(t, "x_observations")).select("match_id", "test_run_id", "survey_time", "bssid", "badge_rssi_dbm", "notes", "entered_by", "entered_at", "manual_entry_status")


def _live(table, cols):
    return f"(select {SCOPE.replace('test_run_id', 'y.test_run_id')} as sc, {cols} from {table} y where y.test_run_id in (select test_run_id from x_runs where deleted_at is null) group by 1)"


@query("v34_current_study", ctes("x_runs", "x_events", "x_points", "x_candidates", "x_matches", "x_observations", "x_archives", "x_meta") + f"""
, sc as (select unnest(['badge', 'ipad']) as study_scope)
select sc.study_scope, coalesce(r.n, 0) as test_run_count, r.a as first_run_created_at, r.b as last_run_created_at, coalesce(e.n, 0) as scan_event_count, e.a as first_scan_time, e.b as last_scan_time,
 coalesce(p.n, 0) as survey_point_count, p.a as first_survey_time, p.b as last_survey_time, coalesce(k.n, 0) as candidate_match_count, coalesce(k.m, 0) as pending_candidate_match_count,
 coalesce(m.n, 0) as completed_match_count, coalesce(m.c, 0) as complete_match_count, coalesce(m.v, 0) as missing_vendor_offset_match_count, coalesce(o.n, 0) as manual_observation_count,
 m.d as mean_calibrated_delta_db, m.d2 as mean_24ghz_calibrated_delta_db, m.d5 as mean_5ghz_calibrated_delta_db, coalesce(a.n, 0) as archive_count, a.latest as latest_archived_at, x_meta.study_name
from sc left join x_meta on x_meta.study_scope = sc.study_scope
left join {_live('x_runs', 'count(*) as n, min(created_at) as a, max(created_at) as b')} r on r.sc = sc.study_scope
left join {_live('x_events', 'count(*) as n, min(event_time) as a, max(event_time) as b')} e on e.sc = sc.study_scope
left join {_live('x_points', 'count(*) as n, min(measured_at) as a, max(measured_at) as b')} p on p.sc = sc.study_scope
left join {_live('x_candidates', "count(*) as n, count(*) filter (where manual_entry_status = 'pending') as m")} k on k.sc = sc.study_scope
left join {_live('x_matches', f"count(*) filter (where {DONE}) as n, count(*) filter (where manual_entry_status = 'complete') as c, count(*) filter (where manual_entry_status = 'missing_vendor_offset') as v, round(avg(calibrated_delta_db) filter (where manual_entry_status = 'complete'), 6) as d, round(avg(calibrated_delta_db) filter (where manual_entry_status = 'complete' and band = '2.4GHz'), 6) as d2, round(avg(calibrated_delta_db) filter (where manual_entry_status = 'complete' and band = '5GHz'), 6) as d5")} m on m.sc = sc.study_scope
left join {_live('x_observations', 'count(*) as n')} o on o.sc = sc.study_scope
left join (select study_scope as k, count(*) as n, max(archived_at) as latest from x_archives where coalesce(archive_label, '') not like 'Checkpoint before restoring %' group by 1) a on a.k = sc.study_scope""")
def v34(t):
    return rounded(V.current_study(*[frame(t, n) for n in ("x_runs", "x_events", "x_points", "x_candidates", "x_matches", "x_observations", "x_archives", "x_meta")]))


@query("v35_archive_selection", ctes("x_archives") + """
, sel as (select c_custkey as selection_owner, c_custkey % 120 as archive_id, c_mktsegment as study_scope from customer)
select selection_owner, sel.study_scope, sel.archive_id, archive_label, archived_at, case when payload like '%combined_from%' then 3 end::int as source_archive_count from sel join x_archives a on a.archive_id = sel.archive_id
where coalesce(archive_label, '') not like 'Checkpoint before restoring %'""")
def v35(t):
    sel = t.customer.select(F.col("c_custkey").alias("selection_owner"), (F.col("c_custkey") % 120).alias("archive_id"), F.col("c_mktsegment").alias("study_scope"))
    return V.archive_selection(sel, frame(t, "x_archives")).select("selection_owner", "study_scope", "archive_id", "archive_label", "archived_at", "source_archive_count")


@query("v36_input_files", ctes("x_files", "x_run_files", "x_runs") + """
, s as (select rf.input_file_id, count(*) as n, count(*) filter (where r.deleted_at is null) as a, max(selected_at) as l from x_run_files rf join x_runs r on r.test_run_id = rf.test_run_id group by 1)
select f.input_file_id, source_type, coalesce(display_name, file_name, file_path) as display_name, is_available, coalesce(n, 0) as selected_run_count, coalesce(a, 0) as active_selected_run_count, l as last_selected_at
from x_files f left join s on s.input_file_id = f.input_file_id""")
def v36(t):
    return V.input_files(frame(t, "x_files"), frame(t, "x_run_files"), frame(t, "x_runs")).select(
        "input_file_id", "source_type", "display_name", "is_available", "selected_run_count", "active_selected_run_count", "last_selected_at")


@query("v37_run_files", ctes("x_files", "x_run_files", "x_runs", "x_studies") + f"""
select {SCOPE.replace('test_run_id', 'rf.test_run_id')} as study_scope, r.study_id, s.project_id, rf.test_run_id, rf.input_file_id, rf.source_role, rf.selected_at, coalesce(display_name, file_name, file_path) as display_name, f.notes as input_file_notes
from x_run_files rf join x_runs r on r.test_run_id = rf.test_run_id left join x_studies s on s.study_id = r.study_id join x_files f on f.input_file_id = rf.input_file_id""")
def v37(t):
    d = V.run_files(frame(t, "x_run_files"), frame(t, "x_runs"), frame(t, "x_studies"), frame(t, "x_files"))
    return d.select("study_scope", "study_id", "project_id", "test_run_id", "input_file_id", "source_role", "selected_at", "display_name", "input_file_notes")


RUN_TABLES = ("x_runs", "x_studies", "x_projects", "x_files", "x_run_files", "x_events", "x_points", "x_candidates", "x_matches", "x_observations")


def _files(role):
    return f"string_agg(coalesce(display_name, file_name, file_path), chr(10) order by selected_at, file_path) filter (where source_role = '{role}')"


RUNS = f"""
, fs as (select test_run_id as k, count(*) as selected_file_count, {_files('badge_log')} as badge_file, {_files('survey_json')} as survey_file, {_files('manual_csv')} as manual_csv, {_files('client_detail')} as client_detail_file
  from x_run_files rf join x_files f on f.input_file_id = rf.input_file_id group by 1),
c1 as (select test_run_id as k, count(*) as n from x_events group by 1), c2 as (select test_run_id as k, count(*) as n from x_points group by 1),
c3 as (select test_run_id as k, count(*) as n, count(*) filter (where manual_entry_status = 'pending') as m from x_candidates group by 1),
c4 as (select test_run_id as k, count(*) filter (where {DONE}) as n from x_matches group by 1), c5 as (select test_run_id as k, count(*) as n from x_observations group by 1),
vr as (select coalesce(s.study_scope, {SCOPE}) as study_scope, r.study_id, s.study_name, s.project_id, p.project_name, r.test_run_id, coalesce(run_name, test_run_id) as run_name,
  coalesce(run_status, case when r.deleted_at is not null then 'deleted' else 'complete' end) as run_status, coalesce(run_notes, notes, '') as run_notes, r.deleted_at, r.created_at, coalesce(selected_file_count, 0) as selected_file_count,
  badge_file, survey_file, manual_csv, client_detail_file, coalesce(c1.n, 0) as scan_event_count, coalesce(c2.n, 0) as survey_point_count, coalesce(c3.n, 0) as candidate_match_count, coalesce(c3.m, 0) as pending_candidate_match_count,
  coalesce(c4.n, 0) as completed_match_count, coalesce(c5.n, 0) as manual_observation_count
  from x_runs r left join x_studies s on s.study_id = r.study_id left join x_projects p on p.project_id = s.project_id left join fs on fs.k = test_run_id left join c1 on c1.k = test_run_id left join c2 on c2.k = test_run_id
  left join c3 on c3.k = test_run_id left join c4 on c4.k = test_run_id left join c5 on c5.k = test_run_id)
"""


def run_rows(t):
    return V.runs_view(*[frame(t, n) for n in RUN_TABLES])


@query("v38_runs", ctes(*RUN_TABLES) + RUNS + "select * from vr")
def v38(t):
    return run_rows(t).select("study_scope", "study_id", "study_name", "project_id", "project_name", "test_run_id", "run_name", "run_status", "run_notes", "deleted_at", "created_at", "selected_file_count",
                              "badge_file", "survey_file", "manual_csv", "client_detail_file", *V.RUN_COUNTS)


_SUMS = ", ".join(f"coalesce(sum({k}) filter (where v.deleted_at is null), 0)::bigint as {k}" for k in V.RUN_COUNTS)
STUDIES = f"""
, vst as (select s.study_id, s.project_id, p.project_name, s.study_name, s.deleted_at, coalesce(active_run_count, 0) as active_run_count, coalesce(total_run_count, 0) as total_run_count, first_run_created_at, last_run_created_at,
  {', '.join(f'coalesce(g.{k}, 0) as {k}' for k in V.RUN_COUNTS)} from x_studies s join x_projects p on p.project_id = s.project_id left join
  (select study_id, count(*) filter (where v.deleted_at is null) as active_run_count, count(*) as total_run_count, min(created_at) filter (where v.deleted_at is null) as first_run_created_at,
   max(created_at) filter (where v.deleted_at is null) as last_run_created_at, {_SUMS} from vr v group by 1) g on g.study_id = s.study_id)
"""


def study_rows(t):
    return V.studies_view(frame(t, "x_studies"), frame(t, "x_projects"), run_rows(t))


@query("v39_studies", ctes(*RUN_TABLES) + RUNS + STUDIES + "select * from vst")
def v39(t):
    return study_rows(t).select("study_id", "project_id", "project_name", "study_name", "deleted_at", "active_run_count", "total_run_count", "first_run_created_at", "last_run_created_at", *V.RUN_COUNTS)


@query("v40_projects", ctes(*RUN_TABLES) + RUNS + STUDIES + f"""
select p.project_id, p.project_name, p.site, coalesce(active_study_count, 0) as active_study_count, coalesce(total_study_count, 0) as total_study_count, coalesce(g.ar, 0) as active_run_count, coalesce(g.tr, 0) as total_run_count,
 {', '.join(f'coalesce(g.{k}, 0) as {k}' for k in V.RUN_COUNTS)} from x_projects p left join (select project_id, count(*) filter (where v.deleted_at is null) as active_study_count, count(*) as total_study_count,
 coalesce(sum(active_run_count) filter (where v.deleted_at is null), 0)::bigint as ar, sum(total_run_count)::bigint as tr, {_SUMS} from vst v group by 1) g on g.project_id = p.project_id""")
def v40(t):
    return V.projects_view(frame(t, "x_projects"), study_rows(t)).select("project_id", "project_name", "site", "active_study_count", "total_study_count", "active_run_count", "total_run_count", *V.RUN_COUNTS)


COMPLETED = f"""
, vm as (select p.project_id, p.project_name, s.study_id, s.study_scope, r.test_run_id, coalesce(run_name, r.test_run_id) as run_name, m.id as match_id, m.survey_time, m.bssid, m.channel, m.badge_mac, m.badge_rssi_dbm, m.survey_rssi_dbm, o.entered_by,
  o.created_at as entered_at, m.created_at as match_created_at from x_matches m join x_runs r on r.test_run_id = m.test_run_id join x_studies s on s.study_id = r.study_id join x_projects p on p.project_id = s.project_id
  left join x_observations o on o.id = m.observation_id where r.deleted_at is null and s.deleted_at is null and p.deleted_at is null and m.{DONE}),
kd as (select *, count(*) over w as duplicate_count, row_number() over (w order by entered_at desc nulls last, match_created_at desc, match_id desc) as rn from vm
  window w as (partition by project_id, survey_time, lower(bssid), coalesce(channel, -1), coalesce(badge_mac, ''), badge_rssi_dbm, survey_rssi_dbm))
"""
MATCH_TABLES = ("x_matches", "x_runs", "x_studies", "x_projects", "x_observations")


def completed(t):
    return V.project_completed_matches(*[frame(t, n) for n in MATCH_TABLES])


@query("v41_project_completed_matches", ctes(*MATCH_TABLES) + COMPLETED + "select * from vm")
def v41(t):
    return completed(t).select("project_id", "project_name", "study_id", "study_scope", "test_run_id", "run_name", "match_id", "survey_time", "bssid", "channel", "badge_mac", "badge_rssi_dbm", "survey_rssi_dbm",
                               "entered_by", "entered_at", "match_created_at")


@query("v42_duplicate_datapoints", ctes(*MATCH_TABLES) + COMPLETED + "select project_id, test_run_id, match_id, survey_time, badge_rssi_dbm, duplicate_count from kd where duplicate_count > 1")
def v42(t):
    return V.project_duplicate_datapoints(completed(t)).select("project_id", "test_run_id", "match_id", "survey_time", "badge_rssi_dbm", "duplicate_count")


@query("v43_canonical_matches", ctes(*MATCH_TABLES) + COMPLETED + "select project_id, match_id, survey_time, badge_rssi_dbm, duplicate_count, rn as canonical_rank from kd where rn = 1")
def v43(t):
    return V.project_canonical_matches(completed(t)).select("project_id", "match_id", "survey_time", "badge_rssi_dbm", "duplicate_count", "canonical_rank")


@query("v44_run_alignment", ctes("x_runs", "x_events", "x_points") + """
, e as (select x.*, (((event_time at time zone 'UTC') at time zone r.timezone))::date as d from x_events x join x_runs r on r.test_run_id = x.test_run_id),
p as (select x.*, (((measured_at at time zone 'UTC') at time zone r.timezone))::date as d, r.default_match_window_seconds as w from x_points x join x_runs r on r.test_run_id = x.test_run_id),
nb as (select p.test_run_id, w, abs(epoch_us(y.event_time) - epoch_us(p.measured_at)) / 1e6::double as delta from p, lateral (select e.event_time from e where e.test_run_id = p.test_run_id and e.d = p.d order by abs(epoch_us(e.event_time) - epoch_us(p.measured_at)), e.event_time limit 1) y),
n as (select test_run_id, count(*) as c, count(*) filter (where delta <= w) as m, round(min(delta), 3) as a, round(quantile_cont(delta, 0.5), 2) as b, round(quantile_cont(delta, 0.9), 2) as z from nb group by 1),
g as (select r.test_run_id, r.timezone, coalesce(ec.n, 0) as scan_event_count, ec.a as scan_event_first_time, coalesce(ec.d, 0) as scan_event_date_count, coalesce(pc.n, 0) as survey_point_count, coalesce(pc.d, 0) as survey_point_date_count,
  coalesce(n.c, 0) as same_date_survey_point_count, coalesce(n.m, 0) as matched_survey_point_count, n.a as nearest_delta_min_seconds, n.b as nearest_delta_p50_seconds, n.z as nearest_delta_p90_seconds
  from x_runs r left join (select test_run_id, count(*) as n, min(event_time) as a, count(distinct d) as d from e group by 1) ec on ec.test_run_id = r.test_run_id
  left join (select test_run_id, count(*) as n, count(distinct d) as d from p group by 1) pc on pc.test_run_id = r.test_run_id left join n on n.test_run_id = r.test_run_id)
select *, case when scan_event_count = 0 then 'no_scan_events' when survey_point_count = 0 then 'no_survey_points' when same_date_survey_point_count = 0 then 'no_same_date_overlap'
 when matched_survey_point_count = 0 then 'no_points_within_match_window' else 'matched' end as alignment_status from g""")
def v44(t):
    d = V.run_alignment(frame(t, "x_runs"), frame(t, "x_events"), frame(t, "x_points"))
    return d.select("test_run_id", "timezone", "scan_event_count", "scan_event_first_time", "scan_event_date_count", "survey_point_count", "survey_point_date_count", "same_date_survey_point_count",
                    "matched_survey_point_count", F.round("nearest_delta_min_seconds", 3).alias("nearest_delta_min_seconds"), F.round("nearest_delta_p50_seconds", 2).alias("nearest_delta_p50_seconds"),
                    F.round("nearest_delta_p90_seconds", 2).alias("nearest_delta_p90_seconds"), "alignment_status")


@query("v45_manual_samples", ctes("x_manual_samples", "x_studies") + "select s.*, st.study_name, st.project_id from x_manual_samples s left join x_studies st on st.study_id = s.study_id")
def v45(t):
    return V.manual_samples(frame(t, "x_manual_samples"), frame(t, "x_studies"))


@query("a28_alignment_summary", """
with p as (select *, ts::date as d from events where event_type = 'view'), e as (select *, ts::date as d from events where event_type = 'click'),
n as (select p.user_id, abs(epoch_us(x.ts) - epoch_us(p.ts)) / 1e6::double as delta from p, lateral (select e.ts from e where e.user_id = p.user_id and e.d = p.d order by abs(epoch_us(e.ts) - epoch_us(p.ts)), e.ts limit 1) x),
r as (select *, row_number() over (partition by user_id order by delta) as rn, count(*) over (partition by user_id) as n from n),
m as (select user_id, count(*) as comparable_points, count(*) filter (where delta <= 7200) as matched_points, min(delta) as delta_min, max(delta) filter (where rn = floor(n * 0.5::double) + 1) as delta_p50, max(delta) filter (where rn = floor(n * 0.9::double) + 1) as delta_p90 from r group by 1),
k as (select user_id from p union select user_id from e)
select k.user_id, coalesce((select count(*) from p where p.user_id = k.user_id), 0) as point_count, coalesce((select count(*) from e where e.user_id = k.user_id), 0) as event_count, coalesce(matched_points, 0) as matched_points, delta_min, delta_p50, delta_p90,
 (select min(abs(epoch_us(p.ts) - epoch_us(e.ts))) / 1e6::double from p join e on p.user_id = e.user_id where p.user_id = k.user_id) as delta_any_date,
 case when coalesce(matched_points, 0) = 0 then case when (select count(*) from e where e.user_id = k.user_id) = 0 then 'no_scan_events' when (select count(*) from p where p.user_id = k.user_id) = 0 then 'no_survey_points'
   when comparable_points is null then 'no_same_date_overlap' else 'outside_match_window' end end as unmatched_reason from k left join m on m.user_id = k.user_id""")
def a28(t):
    p = t.events.filter("event_type = 'view'").select("user_id", "ts")
    e = t.events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("ets"), "event_id")
    d = V.alignment_summary(p, e, ["user_id"], "ts", "ets", "event_id", 7200.0, "UTC")
    return d.select("user_id", "point_count", "event_count", "matched_points", "delta_min", "delta_p50", "delta_p90", "delta_any_date", "unmatched_reason")
