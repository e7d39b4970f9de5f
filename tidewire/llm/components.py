"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import store


def _towards_least(pairs: DataFrame, grow: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour: the greater neighbours (grow), or the node and its lesser ones."""
    if grow:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").filter(F.col("v") > F.col("u"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select("v", "m").union(least.select(F.col("u").alias("v"), "m"))
    return out.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): root is the least node that it is connected with.

    Each round is written, so lineage stays short; rounds end when the table no longer changes, after about the logarithm of
    the longest path. Minima combine before the shuffle; joins on a hub's key are left to adaptive skew splitting. Self loops
    and nulls are dropped; no edges give no rows.
    """
    pairs = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = store(pairs, "components")
    state = None
    while True:
        pairs = store(_towards_least(_towards_least(pairs, grow=True), grow=False), "components")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
