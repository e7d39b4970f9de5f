"""Filters and classification rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stream severity thresholds (loss ratio, jitter ms, p95 gap ms) and capture thresholds.
LOSS_WARNING, LOSS_CRITICAL = 0.01, 0.05
JITTER_WARNING_MS, JITTER_CRITICAL_MS = 10, 20
GAP_WARNING_MS, GAP_CRITICAL_MS = 25, 40
CAPTURE_LOSS_HIGH, CAPTURE_GAP_HIGH_MS = 0.03, 30
MUTED_CLASSES = ["exclude", "noise", "control"]
MIN_TRUSTED_PACKETS = 20
FUTURE_SKEW_SECONDS = 300

# Phase rules of transcript blocks, tried in order.
PHASE_RULES = [
    (r"(?i)no monitor capture|no ip access-list extended", "cleanup"),
    (r"(?is)(?=.*monitor capture)(?=.* export )", "capture_stop_export"),
    (r"(?is)(?=.*monitor capture)(?=.* start)", "capture_start"),
    (r"(?i)show\s+capwap\s+mcast\s+mgid", "ap_evidence"),
    (r"(?i)show\s+wireless\s+multicast\s+(?:group|source)\s+(?!summary\b)", "resolved_group"),
    (r"(?is)(?=.*show\s+wireless\s+multicast\s+group\s+summary)(?=.*mobility\s+history)"
     r"(?=.*show\s+monitor\s+capture\s+\S+\s+buffer\s+brief)", "post_failure"),
    (r"(?is)(?=.*show\s+wireless\s+multicast\s+group\s+summary)"
     r"(?=.*show\s+monitor\s+capture\s+\S+\s+buffer\s+brief)", "active_event"),
    (r"(?is)(?=.*show\s+wireless\s+multicast\s+group\s+summary)(?=.*(?:mobility\s+history|show\s+ap\s+multicast\s+mom))",
     "baseline"),
    (r"(?i)mobility\s+history", "post_failure"),
]
DEFAULT_PHASE = "unassigned"

OPS = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
}


def compare_filter(df: DataFrame, op: str, scalar: float, col: str = "value") -> DataFrame:
    """Keep samples for which the comparison holds."""
    return df.filter(OPS[op](F.col(col), F.lit(scalar)))


def compare_bool(df: DataFrame, op: str, scalar: float, col: str = "value") -> DataFrame:
    """Replace the value by 1 or 0; every row stays."""
    return df.withColumn(col, F.when(OPS[op](F.col(col), F.lit(scalar)), 1.0).otherwise(0.0))


def not_deleted(df: DataFrame, *cols: str) -> DataFrame:
    """Rows alive at every level of the hierarchy."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in (cols or ("deleted_at",))]))


def trusted(mode: Column, packets: Column, wanted: str = "rtp", min_n: int = MIN_TRUSTED_PACKETS) -> Column:
    """Streams whose quality figures count."""
    return F.coalesce((mode == wanted) & (packets >= min_n), F.lit(False))


def is_future(ts: Column, now: Column, skew_seconds: float = FUTURE_SKEW_SECONDS) -> Column:
    """Later than the present plus the allowed clock skew."""
    return F.unix_micros(ts) > F.unix_micros(now) + F.lit(int(skew_seconds * 1_000_000))


def effective(role: Column, own: Column, fallback: Column) -> Column:
    """A stream's own label, unless its role is unmapped and the file names a device."""
    return F.when(role != "unmapped", own).otherwise(F.coalesce(fallback, own))


def classify_phase(text: Column, rules: list[tuple[str, str]], default: str = DEFAULT_PHASE) -> Column:
    """Label of the first rule whose regex occurs."""
    out = None
    for regex, label in rules:
        out = F.when(text.rlike(regex), label) if out is None else out.when(text.rlike(regex), label)
    return out.otherwise(default)


def match_quality(delta: Column, window: Column | float) -> Column:
    """Quality bucket of a time delta; null outside the inclusive window."""
    size = F.abs(delta)
    return (F.when(size > window, None).when(size <= 1.0, "exact_1s").when(size <= 5.0, "close_5s")
            .when(size.isNotNull(), "within_window"))


def _present(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def stream_severity(loss: Column, jitter: Column, gap: Column, mismatch: Column, mode: Column, packets: Column,
                    review: Column, classification: Column) -> dict[str, Column]:
    """Level and reasons of one stream."""
    muted = (F.lower(F.coalesce(review, F.lit("unreviewed"))) == "excluded") | F.lower(
        F.coalesce(classification, F.lit(""))).isin(MUTED_CLASSES)
    mode_l = F.lower(F.coalesce(mode, F.lit("")))
    critical = _present(F.when(loss >= LOSS_CRITICAL, "Loss critical"), F.when(jitter >= JITTER_CRITICAL_MS, "Jitter critical"),
                        F.when(gap >= GAP_CRITICAL_MS, "Timing critical"))
    mark = F.when(mismatch, F.when(mode_l == "rtp", "Trusted RTP DSCP mismatch").otherwise("Non-RTP DSCP mismatch"))
    warning = _present(
        F.when((loss >= LOSS_WARNING) & (loss < LOSS_CRITICAL), "Loss warning"),
        F.when((jitter >= JITTER_WARNING_MS) & (jitter < JITTER_CRITICAL_MS), "Jitter warning"),
        F.when((gap >= GAP_WARNING_MS) & (gap < GAP_CRITICAL_MS), "Timing warning"), mark)
    good = (mode_l == "rtp") & (F.coalesce(packets, F.lit(0)) >= MIN_TRUSTED_PACKETS)
    level = (F.when(muted, "muted").when(F.size(critical) > 0, "critical").when(F.size(warning) > 0, "warning")
             .when(good, "good").otherwise("info"))
    other = F.when((mode_l != "") & (mode_l != "rtp"), "Non-RTP/unknown").otherwise("Needs classification")
    reasons = (F.when(muted, F.array(F.lit("Excluded/noise/control"))).when(F.size(critical) > 0, critical)
               .when(F.size(warning) > 0, warning).when(good, F.array(F.lit("RTP QoE stream"))).otherwise(F.array(other)))
    return {"severity": level, "reasons": reasons}


def capture_concerns(complete: Column, loss: Column, lossy: Column, jitter: Column, gap: Column, trusted_mismatch: Column,
                     other_mismatch: Column, mismatch: Column) -> Column:
    """Concern badges of a capture that parsed; missing figures count as zero."""
    z = lambda c: F.coalesce(c, F.lit(0))
    badges = _present(
        F.when(z(loss) >= CAPTURE_LOSS_HIGH, "high_loss").when((z(loss) > 0) | (z(lossy) > 0), "loss_detected"),
        F.when(z(jitter) >= JITTER_CRITICAL_MS, "high_jitter").when(z(jitter) >= JITTER_WARNING_MS, "jitter_review"),
        F.when(z(gap) >= CAPTURE_GAP_HIGH_MS, "high_interarrival").when(z(gap) >= GAP_WARNING_MS, "interarrival_review"),
        F.when(z(trusted_mismatch) > 0, "trusted_rtp_dscp_mismatch_found")
        .when(z(other_mismatch) > 0, "only_non_rtp_dscp_mismatch_found").when(z(mismatch) > 0, "dscp_mismatch_present"))
    return F.when(complete, badges).otherwise(F.array().cast("array<string>"))


def capture_usefulness(status: Column, success: Column, exit_code: Column, trusted_count: Column, concerns: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    failed = (s == "failed") | F.coalesce(~success, F.lit(False)) | F.coalesce(exit_code != 0, F.lit(False))
    done = (s == "complete") & F.coalesce(success, F.lit(False))
    return (F.when(failed, "parse_failed").when(~done, "not_parsed").when(F.coalesce(trusted_count, F.lit(0)) <= 0, "no_usable_rtp")
            .when(F.size(concerns) > 0, "needs_review").otherwise("useful_rtp"))


def search(cols: list[str], text: str) -> Column:
    """Whether any column contains the text, ignoring case; a blank text matches all."""
    needle = text.strip().lower()
    if not needle:
        return F.lit(True)
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, hits)


def filter_streams(df: DataFrame, *, text: str = "", review: str = "all", classification: str = "all", flag: str = "all") -> DataFrame:
    """Stream list filters; ``flag`` is all, rtp_qoe, dscp_mismatch, lossy, jitter_warning or interarrival_warning."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    flags = {
        "all": F.lit(True),
        "rtp_qoe": trusted(F.col("measurement_mode"), F.col("packet_count")),
        "dscp_mismatch": F.coalesce(F.col("dscp_mismatch"), F.lit(False)),
        "lossy": (z("lost_packets") > 0) | (z("loss_ratio") > 0),
        "jitter_warning": z("jitter_ms") >= JITTER_WARNING_MS,
        "interarrival_warning": z("interarrival_p95_ms") >= GAP_WARNING_MS,
    }
    cond = flags[flag] & search(["src_ip", "dst_ip", "src_port", "dst_port", "ssrc", "stream_id"], text)
    if review != "all":
        cond = cond & (F.coalesce(F.col("review_status"), F.lit("unreviewed")) == review)
    if classification != "all":
        cond = cond & (F.col("stream_classification") == classification)
    return df.filter(cond)


def filter_captures(df: DataFrame, *, text: str = "", status: str = "all", parse_state: str = "all") -> DataFrame:
    cond = search(["source_name", "capture_id", "source_path"], text)
    if status != "all":
        cond = cond & (F.lower(F.coalesce(F.col("capture_status"), F.lit("registered"))) == status)
    state = F.when(F.col("parse_success"), "success").when(~F.col("parse_success"), "failed").otherwise("not_parsed")
    if parse_state != "all":
        cond = cond & (state == parse_state)
    return df.filter(cond)


def rf_filter(df: DataFrame, *, site: str | None = None, site_regex: str | None = None, ap_regex: str | None = None,
              band: str | None = None, min_neighbors: int | None = None) -> DataFrame:
    """Radio snapshot filters: exact site, site and AP regex, band ignoring case, least neighbour count."""
    cond = F.lit(True)
    if site:
        cond = cond & (F.col("site_tag") == site)
    if site_regex:
        cond = cond & F.col("site_tag").rlike(site_regex)
    if ap_regex:
        cond = cond & F.col("ap_name").rlike(ap_regex)
    if band:
        cond = cond & (F.lower("band") == band.lower())
    if min_neighbors is not None:
        cond = cond & (F.col("neighbor_count") >= min_neighbors)
    return df.filter(cond)


def client_filter(df: DataFrame, **equals: str | None) -> DataFrame:
    """Client snapshot filters by device_group, wlc, ssid, badge_model and the like."""
    cond = F.lit(True)
    for col, want in equals.items():
        if want:
            cond = cond & (F.col(col) == want)
    return df.filter(cond)


def accepted_flags(accepted: Column, review: Column) -> dict[str, Column]:
    """Accepted means true; excluded means false or a review of 'excluded'; unknown is neither."""
    return {"is_accepted": accepted.eqNullSafe(F.lit(True)),
            "is_excluded": accepted.eqNullSafe(F.lit(False)) | review.eqNullSafe(F.lit("excluded"))}


def pass_all(col: Column, want: str) -> Column:
    """Equality with a pass-through word."""
    return F.lit(True) if want == "__all" else col == want


def visibility_class(read: Column, udp: Column, rtp: Column, pool: Column, multicast: Column, data: Column, control: Column) -> Column:
    """What a capture can show, from its packet counts; the first rule that applies wins."""
    return (F.when(read <= 0, "empty_or_unusable").when((rtp > 0) & (pool > 0), "inner_voice_visible")
            .when((pool > 0) | (multicast > 0), "inner_multicast_visible").when(data > 0, "outer_capwap_only")
            .when((control > 0) | (udp > 0), "control_plane_only").otherwise("unsupported_link_or_decode"))


def attempt_verdict(outcome: Column, has_group: Column, member: Column, capture_valid: Column) -> dict[str, Column]:
    """Verdict and confidence of an attempt from its outcome and evidence."""
    missed = outcome == "missed"
    grp, cap = F.coalesce(has_group, F.lit(False)), F.coalesce(capture_valid, F.lit(False))
    is_member, no_member = member.eqNullSafe(F.lit(True)), member.eqNullSafe(F.lit(False))
    verdict = (F.when(outcome == "heard", "baseline_success").when(missed & grp & no_member, "membership_failure")
               .when(missed & ~grp, "inconclusive").when(outcome.isin("partial", "choppy") & cap, "media_degraded")
               .otherwise("inconclusive"))
    confidence = (F.when(outcome == "heard", "medium").when(missed & grp & no_member, "high").when(missed & ~grp, "low")
                  .when(outcome.isin("partial", "choppy") & cap, "low").when(missed & is_member & cap, "medium").otherwise("low"))
    return {"verdict": verdict, "verdict_confidence": confidence}


def attempt_findings(member: Column, capture_valid: Column) -> Column:
    """Finding rows (type, severity, confidence) of an attempt, as an array to explode."""
    def finding(cond: Column, kind: str, severity: str, confidence: str) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"),
                                     F.lit(confidence).alias("confidence")))
    return _present(finding(member.eqNullSafe(F.lit(False)), "membership_missing", "critical", "high"),
                    finding(member.eqNullSafe(F.lit(True)), "membership_present", "info", "medium"),
                    finding(F.coalesce(capture_valid, F.lit(False)), "capture_container_valid", "info", "low"))


def outcome_verdict(kind: Column) -> dict[str, Column]:
    """Verdict recorded when an operator closes an attempt."""
    return {"verdict": F.when(kind == "heard", "baseline_success").when(kind == "alert_only", "alert_only_failure").otherwise("inconclusive"),
            "verdict_confidence": F.when(kind.isin("heard", "alert_only"), "medium").otherwise("low")}


def vlan_context_state(configured: Column, resolved: Column, group_ip: Column) -> Column:
    """How the VLAN of the active group relates to the configured one."""
    known = group_ip.isNotNull() & resolved.isNotNull()
    return (F.when(known & (configured != resolved), "configured_group_mismatch").when(known, "resolved_confirmed")
            .when(configured.isNotNull(), "configured_only").otherwise("unresolved"))


def relabel_keep(df: DataFrame, regex: str, metric: str = "metric") -> DataFrame:
    """Forward only metrics whose whole name matches; works on batches and streams."""
    return df.filter(F.col(metric).rlike(f"^(?:{regex})$"))
