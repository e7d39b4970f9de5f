"""Set operations over frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.windows import latest_by


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*[f.distinct() for f in frames]).distinct()


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of each side beyond their number on the other, with the side they come from."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def common_dates(left: DataFrame, right: DataFrame, date: str) -> DataFrame:
    return left.select(date).distinct().join(right.select(date).distinct(), date, "left_semi")


def combine_snapshots(frames: list[tuple[DataFrame, str]], keys: list[str], order: str) -> DataFrame:
    """Per entity, the row of the newest of several snapshots (frame, snapshot id); needs two or more."""
    if len(frames) < 2:
        raise ValueError("combining needs at least two snapshots")
    tagged = union_all(*[f.withColumn("_snapshot", F.lit(s)) for f, s in frames])
    return latest_by(tagged, keys, order, "_snapshot").drop("_snapshot")
