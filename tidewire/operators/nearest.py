"""Nearest-in-time joins, in both directions, without pairing rows.

Points and events are unioned and ordered in time; each point reads the last
event before it and the first event after it. Windows run per (key, local date);
where a key is too large for a task, per range of rows in order of time, and the
last and first events of the neighbouring ranges come from a small summary. No
row blow-up either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.scalars import local_date
from tidewire.operators.blocked import in_ranges, join_back, split_heavy
from tidewire.session import checkpointed


def nearest_join(
    points: DataFrame,
    events: DataFrame,
    by: list[str],
    *,
    point_ts: str,
    event_ts: str,
    event_id: str,
    event_cols: dict[str, str] | None = None,
    tz: str | None = "UTC",
    window: float | None = None,
    how: str = "inner",
    prefix: str = "nearest_",
) -> DataFrame:
    """Each point with the event of least absolute time distance under the same key and local date.

    Ties go to the earlier event, then the smaller id. ``tz=None`` drops the date
    rule; ``window`` is inclusive and applied after the choice. Adds
    ``{prefix}ts``, ``{prefix}id``, the carried event columns, ``{prefix}delta``
    (event minus point, seconds) and ``{prefix}abs_delta``.
    """
    event_cols = event_cols or {}
    day = "_day" if tz else None
    keys = [*by, *(["_day"] if day else [])]

    def framed(df: DataFrame, ts: str) -> DataFrame:
        out = df.withColumn("_t", F.unix_micros(ts))
        return out.withColumn("_day", local_date(F.col(ts), tz)) if day else out

    carried = [F.min_by(F.col(src), F.col(event_id)).alias(f"_e_{out}") for out, src in event_cols.items()]
    ev = (
        framed(events.filter(F.col(event_ts).isNotNull()), event_ts)
        .groupBy(*keys, "_t")
        .agg(F.min(event_id).alias("_id"), *carried)
        .select(
            *keys, "_t", F.lit(0).alias("_k"),
            F.struct("_t", "_id", *[f"_e_{o}" for o in event_cols]).alias("_e"),
        )
    )
    pt = framed(points, point_ts).select(
        *keys, "_t", F.lit(1).alias("_k"), F.struct(*[points[c] for c in points.columns]).alias("_p")
    )
    both = pt.unionByName(ev, allowMissingColumns=True)
    plain, heavy = split_heavy(both, keys)
    joined = _neighbours(plain, keys).select("_t", "_p", "_prev", "_next")
    if heavy is not None:
        joined = joined.unionByName(_neighbours_over_ranges(heavy, keys).select("_t", "_p", "_prev", "_next"))
    back, ahead = F.col("_t") - F.col("_prev._t"), F.col("_next._t") - F.col("_t")
    pick = F.when(F.col("_next").isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    out = joined.select("_p.*", "_t", pick.alias("_pick"))
    delta = (F.col("_pick._t") - F.col("_t")) / F.lit(1e6)
    out = out.withColumn("_delta", delta)
    if window is not None:
        out = out.withColumn("_pick", F.when(F.abs("_delta") <= window, F.col("_pick")))
        out = out.withColumn("_delta", F.when(F.col("_pick").isNotNull(), F.col("_delta")))
    if how == "inner":
        out = out.filter(F.col("_pick").isNotNull())
    return out.select(
        *points.columns,
        F.timestamp_micros("_pick._t").alias(f"{prefix}ts"),
        F.col("_pick._id").alias(f"{prefix}id"),
        *[F.col(f"_pick._e_{o}").alias(o) for o in event_cols],
        F.col("_delta").alias(f"{prefix}delta"),
        F.abs("_delta").alias(f"{prefix}abs_delta"),
    )


def _neighbours(both: DataFrame, part: list[str]) -> DataFrame:
    """Points with the last event up to them and the first one from them on, inside ``part``."""
    w = Window.partitionBy(*part).orderBy("_t", "_k")
    return both.select(
        *part, "_t", "_k", "_p",
        F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_prev"),
        F.first("_e", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_next"),
    ).filter(F.col("_k") == 1)


def _neighbours_over_ranges(both: DataFrame, keys: list[str]) -> DataFrame:
    """The same for keys that are too large for a task: in ranges, with the events at the borders from a summary."""
    both = in_ranges(both.withColumn("_h", F.xxhash64("_p")), [*keys, "_t", "_k", "_h"])
    part = [*keys, "_blk"]
    along = Window.partitionBy(*keys).orderBy("_blk")
    summary = both.groupBy(*part).agg(F.max("_e").alias("_last"), F.min("_e").alias("_first")).select(
        *part,
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"),
    )
    joined = join_back(_neighbours(both, part), summary, part)
    return joined.withColumns({"_prev": F.coalesce("_prev", "_cp"), "_next": F.coalesce("_next", "_cn")})


def nearest_with_fallback(
    points: DataFrame,
    events: DataFrame,
    by: list[str],
    same: str,
    *,
    point_ts: str,
    event_ts: str,
    event_id: str,
    value: str,
    own: str | None = None,
    window: float = 300.0,
    tz: str | None = None,
) -> DataFrame:
    """The point's own value, else the nearest event that shares ``same``, else the nearest event.

    Adds ``matched_value``, ``matched_ts``, ``matched_delta`` and ``match_source``
    ('own', 'same', 'any' or 'none').
    """
    opts = dict(point_ts=point_ts, event_ts=event_ts, event_id=event_id, tz=tz, window=window, how="left")
    usable = events.filter(F.col(value).isNotNull())
    first = nearest_join(points, usable, [*by, same], event_cols={"_same_value": value}, prefix="_same_", **opts)
    both = nearest_join(checkpointed(first), usable, by, event_cols={"_any_value": value}, prefix="_any_", **opts)
    own_col = F.col(own) if own else F.lit(None).cast("double")
    source = (
        F.when(own_col.isNotNull(), "own")
        .when(F.col("_same_id").isNotNull(), "same")
        .when(F.col("_any_id").isNotNull(), "any")
        .otherwise("none")
    )
    zero = F.when(own_col.isNotNull(), F.lit(0.0))
    return both.select(
        *points.columns,
        F.coalesce(own_col, F.col("_same_value"), F.col("_any_value")).alias("matched_value"),
        F.coalesce(F.when(own_col.isNotNull(), F.col(point_ts)), F.col("_same_ts"), F.col("_any_ts")).alias("matched_ts"),
        F.coalesce(zero, F.col("_same_delta"), F.col("_any_delta")).alias("matched_delta"),
        source.alias("match_source"),
    )


def min_gap(left: DataFrame, right: DataFrame, by: list[str], *, left_ts: str, right_ts: str, right_id: str) -> DataFrame:
    """Least time distance per key over all dates."""
    near = nearest_join(left, right, by, point_ts=left_ts, event_ts=right_ts, event_id=right_id, tz=None)
    return near.groupBy(*by).agg(F.min("nearest_abs_delta").alias("min_gap_seconds"))
