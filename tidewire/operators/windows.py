"""First, latest and best rows per key, duplicates, counter deltas, fills and flags.

'Best row' questions are aggregates (``min_by``), which combine on the map side;
numbering and carrying run in blocks of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.blocked import FEW_RANGES, Order, join_back, scan
from tidewire.session import checkpointed


def order_key(df: DataFrame, order: list[tuple[str, str]]) -> Column:
    """A struct whose least value is the first row; nulls come last in both directions."""
    kinds = dict(df.dtypes)
    parts = []
    for i, (col, way) in enumerate(order):
        c, kind = F.col(col), kinds[col]
        if way == "desc":
            if kind == "timestamp":
                c = -F.unix_micros(c)
            elif kind == "boolean":
                c = ~c
            elif kind == "string":
                raise ValueError("descending text needs latest_by")
            else:
                c = -c
        parts += [F.col(col).isNull().alias(f"n{i}"), c.alias(f"k{i}")]
    return F.struct(*parts)


def top1(df: DataFrame, by: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """First row per key in the given order."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order_key(df, order)).alias("_row")).select(*by, "_row.*")


def latest_by(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """Greatest row per key by ascending comparison of the order columns; the later name wins a tie."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, "_row.*")


def latest_row(df: DataFrame, *order: Column) -> DataFrame:
    """Globally first row: a top-1, not a single-partition window."""
    return df.orderBy(*order).limit(1)


def best_per_key(df: DataFrame, by: list[str], score: str, line: str, missing: float) -> DataFrame:
    """Highest score per key, a missing score counting as ``missing``; the earlier line wins a tie."""
    d = df.withColumn("_score", F.coalesce(F.col(score), F.lit(missing)))
    return top1(d, by, [("_score", "desc"), (line, "asc")]).drop("_score")


def duplicates(df: DataFrame, key: list[Column], order: Order, *, keep: str = "duplicates") -> DataFrame:
    """Rows of each composite key with the key's row count and the row's rank.

    ``keep`` is 'duplicates' (keys with more than one row), 'canonical' (rank 1)
    or 'all'. Copies of one key are numbered in blocks, so a key that holds a
    large share of the rows is still spread.
    """
    names = [f"_key{i}" for i in range(len(key))]
    keyed = df.withColumns(dict(zip(names, key)))
    out = scan(keyed, names, order, number="duplicate_rank", total="duplicate_count").drop(*names)
    if keep == "duplicates":
        return out.filter(F.col("duplicate_count") > 1)
    if keep == "canonical":
        return out.filter(F.col("duplicate_rank") == 1)
    return out


def source_key(sha: Column, path: Column, size: Column, mtime: Column) -> Column:
    """Content hash, else path, size and mtime as text; null when all are missing."""
    def t(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    text = F.concat(F.lit("path:"), t(path), F.lit("|size:"), t(size), F.lit("|mtime:"), t(mtime))
    return F.coalesce(F.nullif(sha, F.lit("")), F.nullif(text, F.lit("path:|size:|mtime:")))


def duplicate_sources(df: DataFrame, by: list[str], key: Column, order: Order) -> DataFrame:
    """Files that share a source key within a scope, newest first."""
    d = df.withColumn("duplicate_key", key).filter(F.col("duplicate_key").isNotNull())
    return duplicates(d, [*[F.col(b) for b in by], F.col("duplicate_key")], order)


def dedupe_sources(df: DataFrame, kind: str, sha: str, path: str, name: str, stamped: Column) -> DataFrame:
    """One file per (kind, hash), preferring an unstamped, shorter, then lexically smaller name; rows
    without a hash all pass."""
    has = F.coalesce(F.col(sha), F.lit("")) != ""
    d = df.withColumns({"_stamp": stamped.cast("int"), "_len": F.length(name)})
    winners = top1(d.filter(has), [kind, sha], [("_stamp", "asc"), ("_len", "asc"), (path, "asc")])
    return winners.select(*df.columns).unionByName(df.filter(~has))


def best_snapshot(df: DataFrame, by: list[str], phase: str, preferred: str, scored: list[str], tie: str) -> DataFrame:
    """A row of the preferred phase if there is one, else any; the row with most filled fields wins."""
    filled = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in scored])
    d = df.withColumns({"_pref": F.coalesce((F.col(phase) == preferred).cast("int"), F.lit(0)), "_filled": filled})
    return top1(d, by, [("_pref", "desc"), ("_filled", "desc"), (tie, "asc")]).drop("_pref", "_filled")


def annotate_outliers(df: DataFrame, by: list[str], value: str, *, sample: Column | None = None, min_n: int = 30,
                      z: float = 2.0, keep_small_z: bool = True) -> DataFrame:
    """z-score of each row against its group, with the small-sample and no-variance guards.

    Group statistics come from the rows that satisfy ``sample``. Keys compare
    null and blank alike on both sides. ``keep_small_z=False`` blanks z where a
    guard applies.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    d = df.withColumns({k: F.coalesce(F.col(b).cast("string"), F.lit("")) for k, b in zip(keys, by)})
    rows = d.filter(F.col(value).isNotNull())
    if sample is not None:
        rows = rows.filter(sample)
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), F.avg(value).alias("mean_delta"),
                                    F.stddev_samp(value).alias("stddev_delta"))
    out = d.join(stats, keys).drop(*keys)
    sd = F.nullif(F.col("stddev_delta"), F.lit(0.0))
    score = (F.col(value) - F.col("mean_delta")) / sd
    status = (F.when(F.col("sample_count") < min_n, "insufficient_samples").when(sd.isNull(), "no_variance")
              .when(F.abs(score) > z, "outlier").otherwise("normal"))
    shown = score if keep_small_z else F.when(status.isin("outlier", "normal"), score)
    return out.withColumns({"z_score": shown, "outlier_status": status})


def flag_outliers(df: DataFrame, value: str, z: float = 2.0) -> DataFrame:
    """z against the whole column, computed from mean and deviation already rounded to 6 places."""
    stats = df.agg(F.round(F.avg(value), 6).alias("_m"), F.round(F.stddev_samp(value), 6).alias("_s"))
    d = df.join(stats, F.lit(True), "inner")
    score = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    return d.withColumns({"z_score": F.round(score, 4), "is_outlier": F.coalesce(F.abs(score) > z, F.lit(False))}).drop("_m", "_s")


def counter_delta(df: DataFrame, by: list[str], order: Order, value: str, out: str = "delta") -> DataFrame:
    """Increase over the last known value, never below zero; zero for the first and for a missing value."""
    d = scan(df, by, order, ffill_before={"_prev": value})
    return d.withColumn(out, F.coalesce(F.greatest(F.col(value) - F.col("_prev"), F.lit(0)), F.lit(0))).drop("_prev")


def gaps(df: DataFrame, by: list[str], order: Order, out: str = "gap_ms") -> DataFrame:
    """Milliseconds since the previous row of the key; null for the first."""
    now = F.unix_micros(order.col) if dict(df.dtypes)[order.col] == "timestamp" else F.col(order.col) * 1e6
    d = scan(df, by, order, lag={"_prev": order.col})
    prev = F.unix_micros("_prev") if dict(df.dtypes)[order.col] == "timestamp" else F.col("_prev") * 1e6
    gap = (now - prev) / F.lit(1000.0)
    return d.withColumn(out, F.when(gap >= 0, gap)).drop("_prev")


def ffill(df: DataFrame, by: list[str], order: Order, col: str, out: str) -> DataFrame:
    return scan(df, by, order, ffill={out: col})


def block_id(df: DataFrame, by: list[str], order: Order, starts: Column, out: str = "block_id") -> DataFrame:
    """Running count of boundary rows; rows before the first boundary are block 0."""
    d = df.withColumn("_start", F.coalesce(starts.cast("int"), F.lit(0)))
    return scan(d, by, order, running={out: "_start"}).drop("_start")


def uniquify(df: DataFrame, base: str, order: Order, out: str = "unique_id") -> DataFrame:
    """Repeated ids get -2, -3, ... in order.

    A suffixed id that equals some other row's own id would clash; those few ids
    take the hash of the row instead.
    """
    d = scan(df, [base], order, number="_i")
    made = F.when(F.col("_i") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("_i").cast("string")))
    d = d.withColumn(out, made)
    # only an id that ends like a suffixed one can equal one; mostly there is none, and rows need not be shuffled to look for it
    bases = checkpointed(df.select(F.col(base).alias(out)).filter(F.col(out).rlike(r"(?s)-([2-9]|[1-9][0-9]+)\z")).distinct().withColumn("_clash", F.lit(True)))
    n = bases.limit(FEW_RANGES + 1).count()
    d = join_back(d, F.broadcast(bases) if n <= FEW_RANGES else bases, [out]) if n else d.withColumn("_clash", F.lit(False))
    clash = (F.col("_i") > 1) & F.coalesce(F.col("_clash"), F.lit(False))
    hashed = F.concat(F.col(base), F.lit("-"), F.substring(F.sha2(F.col(out), 256), 1, 12))
    return d.withColumn(out, F.when(clash, hashed).otherwise(F.col(out))).drop("_i", "_clash")
