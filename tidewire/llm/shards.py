"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import store


def text_size(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed overhead per row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def shard_by_bytes(rows: DataFrame, n_shards: int, order: list[str], size: str = "size") -> DataFrame:
    """Adds ``shard`` (0 to n_shards-1) and ``slot`` (0, 1, ... within the shard) to ``rows``.

    ``rows`` should be narrow: keys, sizes, checksums. They are dealt out by ranges of ``order`` and written once. Each partition's
    bytes and rows are summed; running sums over these totals, one row per partition, give where each partition starts. A row
    belongs to the shard that holds its middle byte when the bytes of all rows, in order, are cut at equal targets.
    Null keys come first; rows equal in all of ``order`` are interchangeable, so name enough columns. Sizes may be 0 or null (0).
    An empty input gives an empty result. Columns named ``shard`` or ``slot`` are replaced.
    """
    part, before, row, total = "__part", "__before", "__row", "__total"
    rows = rows.drop("shard", "slot").withColumn(size, F.coalesce(F.col(size), F.lit(0)))
    dealt = store(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "shard-rows")
    totals = dealt.groupBy(part).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n"))
    earlier, everything = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    starts = totals.select(
        part, F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.sum("b").over(everything).alias(total))
    inside = Window.partitionBy(part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per partition of the shuffle: its size is bound by the number of partitions.
    placed = (
        dealt.join(F.broadcast(starts), part)
        .withColumn(before, F.col("b0") + F.sum(size).over(upto) - F.col(size))
        .withColumn(row, F.col("n0") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ({before} + {size} div 2) div greatest(1, ceil({total} / {n_shards}))) as int)")))
    placed = store(placed.drop("b0", "n0", part, before, total), "shard-placed")
    first = placed.groupBy("shard").agg(F.min(row).alias("__first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col(row) - F.col("__first")).drop(row, "__first")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document; shards are contiguous in doc_id. Null texts count 0 bytes."""
    narrow = docs.select(
        "doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_by_bytes(narrow, n_shards, ["doc_id", "text_crc32", "size"])
