"""Ordered per-key computations, also for keys that are too large for one task.

Most keys have few rows: then a plain window partitioned by the key does, with one shuffle. If a count finds keys beyond ``HEAVY_KEY_ROWS``, the
rows of these keys alone are dealt out by ranges of key and order and written once; all other keys stay in the plain window. A range is a block: it holds
about equal numbers of rows whatever the key, and rows with equal leading values are split by the tie-breaking columns. Windows run inside (key,
block); a summary with one row per (key, block), prefix-summed per key, carries totals and last values across borders. Both ways give the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import checkpointed, written

#: Rows of one key that a task still sorts in a plain window.
HEAVY_KEY_ROWS = 4_000_000
#: Summaries of so many (key, range) pairs at most are broadcast to the rows they belong to, which then aren't shuffled again.
FEW_RANGES = 100_000
#: Inputs that Spark estimates below this many bytes are not counted first.
SMALL_BYTES = 64 << 20


@dataclass(frozen=True)
class Order:
    """Row order of a key: leading column, then tie-breaking columns.

    A tie written ``-name`` is descending; carried values need ascending ties. ``step`` is for a leading column of whole numbers that run
    through a key, such as line numbers: a block then holds that many of them, and rows of heavy keys need not be dealt out and written first.
    """

    col: str
    ties: tuple[str, ...] = field(default=())
    desc: bool = False
    step: int = 0

    def columns(self) -> list[Column]:
        lead = F.col(self.col).desc() if self.desc else F.col(self.col).asc()
        return [lead, *[F.col(t[1:]).desc() if t.startswith("-") else F.col(t).asc() for t in self.ties]]

    def key(self) -> Column:
        return F.struct(self.col, *self.ties)


def heavy_keys(df: DataFrame, by: list[str]) -> DataFrame | None:
    """The keys with more rows than one task should sort, written once; None if there are none. At most rows / ``HEAVY_KEY_ROWS`` keys."""
    return None if is_small(df) else counted_heavy_keys(df, by)


def is_small(df: DataFrame) -> bool:
    """Whether the planner's estimate is so low that keys need not be counted."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    except ValueError:  # an estimate of thousands of digits: joins multiply it
        return False


def counted_heavy_keys(df: DataFrame, by: list[str]) -> DataFrame | None:
    """The same, counted whatever the size."""
    found = written(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HEAVY_KEY_ROWS).drop("_n"), "heavy-keys")
    return found if found.limit(1).count() else None


def counted_load(df: DataFrame, by: list[str]) -> tuple[DataFrame | None, int, int, int]:
    """The keys with more rows than one task should sort, as ``counted_heavy_keys`` has them; rows and number of all other keys, and the most rows one has."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = F.when(F.col("_n") > HEAVY_KEY_ROWS, F.struct(*by)).alias("_key")
    found = written(counts.select(large, "_n").groupBy("_key").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_keys"), F.max("_n").alias("_most")), "heavy-keys")
    heavy = found.filter(F.col("_key").isNotNull()).select("_key.*")
    others = found.filter(F.col("_key").isNull()).first()
    load = (others["_rows"], others["_keys"], others["_most"]) if others else (0, 0, 0)
    return heavy if heavy.limit(1).count() else None, *load


def split_heavy(df: DataFrame, by: list[str], known: DataFrame | None = ...) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of heavy ones (None if there are none). The list of heavy keys is short by its definition, so it is broadcast.

    ``known`` is that list (None: there are none), where an earlier count over the same rows has found it.
    """
    keys = heavy_keys(df, by) if known is ... else known
    if keys is None:
        return df, None
    marked = join_back(df, F.broadcast(keys.withColumn("_heavy", F.lit(True))), by)
    return marked.filter(F.col("_heavy").isNull()).drop("_heavy"), marked.filter("_heavy").drop("_heavy")


def in_ranges(df: DataFrame, columns: list[Column | str]) -> DataFrame:
    """``df`` sorted into ranges of about equal size, with the number of the range as ``_blk``; written once, so numbers stay."""
    return written(df.repartitionByRange(*columns).withColumn("_blk", F.spark_partition_id()), "ranges")


def join_back(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys in which null equals null; the right-hand keys are dropped."""
    renamed = small
    cond = F.lit(True)
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__{k}")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(renamed, cond, "left").drop(*[f"__{k}" for k in keys])


def scan(
    df: DataFrame,
    by: list[str],
    order: Order,
    *,
    lag: dict[str, str] | None = None,
    ffill: dict[str, str] | None = None,
    ffill_before: dict[str, str] | None = None,
    peak_before: dict[str, str] | None = None,
    running: dict[str, str] | None = None,
    number: str | None = None,
    total: str | None = None,
    heavy: DataFrame | str | None = ...,
) -> DataFrame:
    """Add ordered per-key columns. ``heavy`` lists the heavy keys if they are known, see ``split_heavy``, or is "all".

    lag            value of the previous row
    ffill          last non-null value up to and including the row
    ffill_before   last non-null value before the row
    peak_before    greatest value before the row
    running        running sum including the row
    number, total  1-based row number; rows in the key
    """
    want = _Wanted(lag or {}, ffill or {}, ffill_before or {}, peak_before or {}, running or {}, number, total)
    if (order.desc or any(t.startswith("-") for t in order.ties)) and (want.lag or want.ffill or want.ffill_before):
        raise ValueError("carried values need an ascending order")
    if isinstance(heavy, str):
        return _over_ranges(df, by, order, want)
    plain, large = split_heavy(df, by, heavy)
    out = _in_windows(plain, by, order, want)
    return out if large is None else out.unionByName(_over_ranges(large, by, order, want))


@dataclass(frozen=True)
class _Wanted:
    """The columns that a scan adds."""

    lag: dict[str, str]
    ffill: dict[str, str]
    ffill_before: dict[str, str]
    peak_before: dict[str, str]
    running: dict[str, str]
    number: str | None
    total: str | None

    def local(self, keys: list[str], order: Order) -> list[Column]:
        """Windows over the rows of ``keys``."""
        here = Window.partitionBy(*keys).orderBy(*order.columns())
        upto = here.rowsBetween(Window.unboundedPreceding, 0)
        before = here.rowsBetween(Window.unboundedPreceding, -1)
        out = [F.row_number().over(here).alias("_rn")]
        out += [F.sum(src).over(upto).alias(f"_ws_{o}") for o, src in self.running.items()]
        out += [F.lag(src).over(here).alias(f"_wl_{o}") for o, src in self.lag.items()]
        out += [F.last(src, ignorenulls=True).over(upto).alias(f"_wf_{o}") for o, src in self.ffill.items()]
        out += [F.last(src, ignorenulls=True).over(before).alias(f"_wf_{o}") for o, src in self.ffill_before.items()]
        return out + [F.max(src).over(before).alias(f"_wp_{o}") for o, src in self.peak_before.items()]


def _in_windows(df: DataFrame, by: list[str], order: Order, want: _Wanted) -> DataFrame:
    """Each key in one window."""
    local = want.local(by, order)
    if want.total:
        local.append(F.count(F.lit(1)).over(Window.partitionBy(*by)).alias(want.total))
    final = [F.col(c) for c in df.columns]
    final += [F.col(f"_wl_{o}").alias(o) for o in want.lag] + [F.col(f"_wf_{o}").alias(o) for o in {**want.ffill, **want.ffill_before}]
    final += [F.col(f"_wp_{o}").alias(o) for o in want.peak_before]
    final += [F.coalesce(F.col(f"_ws_{o}"), F.lit(0)).alias(o) for o in want.running]
    final += [F.col("_rn").cast("long").alias(want.number)] if want.number else []
    final += [F.col(want.total)] if want.total else []
    return df.select("*", *local).select(*final)


def _over_ranges(df: DataFrame, by: list[str], order: Order, want: _Wanted) -> DataFrame:
    """Each key in ranges of rows, with what the ranges before it hand on."""
    if order.step and not order.desc:
        keyed = df.withColumn("_blk", F.col(order.col) - F.col(order.col) % order.step)
    else:
        keyed = in_ranges(df, [*by, *order.columns()])
    keys = [*by, "_blk"]
    filled = {**want.ffill, **want.ffill_before}
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(src).alias(f"_s_{o}") for o, src in want.running.items()]
    aggs += [F.max_by(F.struct(F.col(src).alias("v")), order.key()).alias(f"_l_{o}") for o, src in want.lag.items()]
    aggs += [F.max_by(src, F.when(F.col(src).isNotNull(), order.key())).alias(f"_f_{o}") for o, src in filled.items()]
    aggs += [F.max(src).alias(f"_p_{o}") for o, src in want.peak_before.items()]
    summary = keyed.groupBy(*keys).agg(*aggs)
    along = Window.partitionBy(*by).orderBy("_blk")
    prior = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_c_n")]
    if want.total:
        carried.append(F.sum("_n").over(Window.partitionBy(*by)).alias(want.total))
    carried += [F.coalesce(F.sum(f"_s_{o}").over(prior), F.lit(0)).alias(f"_cs_{o}") for o in want.running]
    carried += [F.lag(f"_l_{o}").over(along).alias(f"_cl_{o}") for o in want.lag]
    carried += [F.last(f"_f_{o}", ignorenulls=True).over(prior).alias(f"_cf_{o}") for o in filled]
    carried += [F.max(f"_p_{o}").over(prior).alias(f"_cp_{o}") for o in want.peak_before]
    carry = checkpointed(summary.select(*keys, *carried))
    carry = F.broadcast(carry) if carry.limit(FEW_RANGES + 1).count() <= FEW_RANGES else carry
    out = join_back(keyed.select("*", *want.local(keys, order)), carry, keys)

    final = [F.col(c) for c in df.columns]
    final += [F.when(F.col("_rn") > 1, F.col(f"_wl_{o}")).otherwise(F.col(f"_cl_{o}.v")).alias(o) for o in want.lag]
    final += [F.coalesce(f"_wf_{o}", f"_cf_{o}").alias(o) for o in filled]
    final += [F.greatest(f"_wp_{o}", f"_cp_{o}").alias(o) for o in want.peak_before]
    final += [(F.coalesce(F.col(f"_ws_{o}"), F.lit(0)) + F.col(f"_cs_{o}")).alias(o) for o in want.running]
    if want.number:
        final.append((F.col("_rn") + F.col("_c_n")).alias(want.number))
    if want.total:
        final.append(F.col(want.total))
    return out.select(*final)
