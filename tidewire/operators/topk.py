"""Sorting, limits and top-k. Global limits compile to TakeOrdered; per-key top rows are aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.windows import top1


def sort_nulls_last(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    cols = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in order]
    return df.orderBy(*cols)


def worst_streams(df: DataFrame, n: int, tie: str) -> DataFrame:
    """Streams with most loss, then jitter, gap and packets; missing measures count as zero."""
    measures = ["loss_ratio", "jitter_ms", "interarrival_p95_ms", "packet_count"]
    return df.orderBy(*[F.coalesce(F.col(m), F.lit(0)).desc() for m in measures], F.col(tie).asc()).limit(n)


def bounded_limit(df: DataFrame, order: list[Column], requested: int | None, default: int = 500, most: int = 5000) -> DataFrame:
    """A report page: the requested size clamped to [1, most]."""
    size = max(1, min(most, requested if requested is not None else default))
    return df.orderBy(*order).limit(size)


def topk(df: DataFrame, value: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last(), *[F.col(t) for t in ties]).limit(n)


def topk_by(df: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """Greatest value per key."""
    return top1(df, by, [(value, "desc"), *[(t, "asc") for t in ties]])


def sort_desc(df: DataFrame, value: str) -> DataFrame:
    return df.orderBy(F.col(value).desc_nulls_last())


def recent_keys(df: DataFrame, key: str, ts: str, since: Column, prefixes: list[str], n: int) -> DataFrame:
    """Keys seen since an instant whose text starts with an allowed prefix, newest first."""
    text = F.col(key).cast("string")
    allowed = F.lit(not prefixes)
    for p in prefixes:
        allowed = allowed | text.startswith(p)
    seen = df.filter((F.col(ts) >= since) & allowed).groupBy(key).agg(F.max(ts).alias("last_seen"))
    return seen.orderBy(F.col("last_seen").desc(), F.col(key)).limit(n)


def capped(df: DataFrame, order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """A report page of at most ``cap`` rows, and whether more rows exist."""
    page = df.orderBy(*order).limit(cap + 1)
    return page.limit(cap), page.agg((F.count(F.lit(1)) > cap).alias("truncated"))
