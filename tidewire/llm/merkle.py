"""Merkle manifest of a table: lag and lead windows climb one level at a time. Spark expressions only.

Rows of a tree are numbered, and cut into blocks of ``fan ** levels`` consecutive leaves, so that runs of siblings never straddle a block.
All levels of a block are windows over one sort of it; only a block's topmost node goes on, as a leaf of the next round. However
many rows one tree has, a window holds one block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import remainder, store

_PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class Shape:
    """Children per node, and levels that are climbed inside a block of ``fan ** levels`` rows."""

    fan: int = 3
    levels: int = 7


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that neighbouring values can't be confused; '-' for null. Integers are decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__idx``, from 0 in the order of its ``__tree``, and ``__n``, the rows of the tree.

    Rows are dealt out by ranges and written once, so a tree of any size spreads over tasks; running totals of the ranges give where each begins.
    """
    dealt = store(rows.repartitionByRange("__tree", *order).withColumn("__part", F.spark_partition_id()), "merkle-ranges")
    totals = dealt.groupBy("__tree", "__part").agg(F.count(F.lit(1)).alias("__k"))
    tree = Window.partitionBy("__tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__tree", "__part", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__from"), F.sum("__k").over(tree).alias("__n"))
    here = Window.partitionBy("__tree", "__part").orderBy(*order)
    placed = dealt.withColumn("__row", F.row_number().over(here)).join(starts, ["__tree", "__part"])
    return placed.withColumn("__idx", F.col("__from") + F.col("__row") - 1).drop("__part", "__row", "__from")


def climbed(nodes: DataFrame, shape: Shape) -> DataFrame:
    """``nodes`` (__tree, __idx, __n, __h and others) with ``__path`` and ``__root``.

    The path holds, level by level, the siblings left and right of the node's ancestor; a run of one has empty ones. ``__root`` is what
    remains of the tree: the digest of a lone node is its root, with an empty path.
    """
    most = nodes.agg(F.max("__n")).first()[0] or 0
    size = shape.fan ** shape.levels
    depth = 0
    while depth < shape.levels and shape.fan**depth < most:
        depth += 1
    idx, n = F.col("__idx"), F.col("__n")
    rows = nodes.withColumns({"__block": F.floor(idx / size), "__at": F.col("__h")})
    block = Window.partitionBy("__tree", "__block").orderBy("__idx")
    upto = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = lambda level: F.last(f"__s{level}", ignorenulls=True).over(upto)
    for level in range(depth):
        step = shape.fan**level
        near = {}
        for k in range(1, shape.fan):
            near[f"__lag{k}"] = F.lag("__at", k * step).over(block)
            near[f"__lead{k}"] = F.lead("__at", k * step).over(block)
        if level:  # every row gets its ancestor's siblings, which its subtree's first row knows, in the same pass as the next level's neighbours
            near[f"__s{level - 1}"] = known(level - 1)
        rows = rows.withColumns(near)
        slot = F.floor(idx / step) % shape.fan
        run = F.least(F.lit(shape.fan), F.ceil(n / step) - (F.floor(idx / step) - slot))
        left = F.concat(*[F.when(slot >= k, F.col(f"__lag{k}")).otherwise("") for k in range(shape.fan - 1, 0, -1)])
        right = F.concat(*[F.when(slot + k < run, F.col(f"__lead{k}")).otherwise("") for k in range(1, shape.fan)])
        lives, is_node, is_first = n > step, idx % step == 0, idx % (step * shape.fan) == 0
        rows = rows.withColumn(f"__s{level}", F.when(lives & is_node, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(is_first, digest(F.col("__at"), F.col(f"__s{level}.right")))
        rows = rows.withColumn("__at", F.when(lives, parent).otherwise(F.col("__at"))).drop(*[x for x in near if x.startswith("__l")])
    last = {"__root": F.first("__at").over(upto)}
    if depth:
        last[f"__s{depth - 1}"] = known(depth - 1)
    rows = rows.withColumns(last)
    levels = [F.col(f"__s{level}") for level in range(depth)]
    path = F.filter(F.array(*levels), lambda s: s.isNotNull()) if levels else F.array().cast(_PATH)
    rows = rows.withColumn("__path", path).drop(*[f"__s{level}" for level in range(depth)])
    if most <= size:
        return rows.drop("__block", "__at")
    rows = store(rows, "merkle-blocks")
    tops = rows.filter((idx % size == 0) & (n > size)).select("__tree", F.col("__block").alias("__idx"), F.ceil(n / size).alias("__n"), F.col("__at").alias("__h"))
    upper = climbed(tops, shape).select("__tree", F.col("__idx").alias("__block"), F.col("__path").alias("__up"), F.col("__root").alias("__top"))
    rows = rows.join(upper, ["__tree", "__block"], "left")
    both = F.concat("__path", F.coalesce("__up", F.array().cast(_PATH)))
    return rows.withColumns({"__path": both, "__root": F.coalesce("__top", "__root")}).drop("__block", "__at", "__up", "__top")


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["left"], at, s["right"]))


def manifest(leaves: DataFrame, tree: str, order: list[str], shape: Shape = Shape()) -> DataFrame:
    """``leaves`` (with a hex digest ``leaf``) with ``path``, ``subroot`` and ``root``.

    Each value of ``tree`` has a tree of its own, whose leaves ascend by ``order`` (nulls first) and then by ``leaf``; the trees' roots, by tree (null
    first, bytewise), are the leaves of the last tree. Equal leaves are interchangeable. An empty table gives an empty result. Columns that are
    named like the added ones are replaced.
    """
    leaves = leaves.drop("path", "subroot", "root")
    key = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))  # null sorts before all strings, also before the empty one
    rows = store(leaves.withColumns({"__tree": key, "__h": F.col("leaf"), "__id": F.monotonically_increasing_id()}), "merkle-leaves")
    low = climbed(numbered(rows, [*order, "__h", "__id"]), shape)
    low = low.select(*leaves.columns, "__tree", "__idx", F.col("__path").alias("__low"), F.col("__root").alias("subroot"))
    low = store(low, "merkle-trees")
    roots = low.filter("__idx = 0").select(F.lit("").alias("__tree"), F.col("__tree").alias("__name"), F.col("subroot").alias("__h"))
    top = climbed(numbered(roots, ["__name"]), shape).select(F.col("__name").alias("__tree"), F.col("__path").alias("__high"), F.col("__root").alias("root"))
    return low.join(top, "__tree").select(*leaves.columns, F.concat("__low", "__high").alias("path"), "subroot", "root")


def document_manifest(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Per document: leaf, subroot of its source, root, proof_sha256, and whether a tampered copy still folds to the root.

    A leaf covers doc_id, source, lang, n_chars and text. In documents whose id's crc32 is even, the tampered text lacks its line feeds; where
    there are none, or the text is null, nothing changes. A null doc_id comes first in its source and counts as empty text for the crc32. Repeated rows
    are leaves of their own.
    """
    leaf = lambda text: digest(*[field(F.col(x)) for x in ("doc_id", "source", "lang", "n_chars")], field(text))
    text = F.col("text")
    tampered = F.when(remainder(F.col("doc_id"), 2) == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    leaves = docs.select("doc_id", "source", leaf(text).alias("leaf"), F.when(~text.eqNullSafe(tampered), leaf(tampered)).alias("changed"))
    out = manifest(leaves, "source", ["doc_id"], shape)
    out = out.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
