"""Near duplicates by an inverted join over MinHash coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, store
from tidewire.llm.components import components
from tidewire.llm.hashing import U, mix, text_bytes, windows, word_hashes, word_spans


@dataclass(frozen=True)
class Rule:
    """Link two documents when 100 * intersection >= percent * union of their sets of shingles of ``words`` words.

    ``coordinates`` of the signature, of which ``matches`` must agree for a pair to be looked at. With 24 and 10, a pair just at 85 %
    is overlooked with a chance of about 1 in 7 million. ``block`` documents are compared with as many others in one task.
    """

    words: int = 5
    percent: int = 85
    coordinates: int = 24
    matches: int = 10
    block: int = 512


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and the texts' offsets in them."""
    raw, offsets = text_bytes(column)
    starts, ends, edges = word_spans(raw, offsets)
    hashes, owner = windows(word_hashes(raw, starts, ends, lower=True), edges, words, short=True)
    order = np.lexsort([hashes, owner])
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(column) + 1))


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, key (two numbers that equal sets share; null for empty sets) and the signature's tokens.

    A token stands for a coordinate and its value.
    """
    seeds = mix(np.arange(1, 2 * rule.coordinates + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, edges = shingle_sets(part.column("text"), rule.words)
                counts = np.diff(edges)
                full = np.flatnonzero(counts)
                at = edges[:-1][full]
                tokens = np.empty((len(full), rule.coordinates), np.uint64)
                keys = np.zeros((2, len(part)), np.uint64)
                if len(full):
                    for k in range(rule.coordinates):
                        tokens[:, k] = mix(np.minimum.reduceat(hashes * (seeds[2 * k] | U(1)) + seeds[2 * k + 1], at) + U(k))
                    keys[0, full] = np.add.reduceat(mix(hashes + U(7)), at)
                    keys[1, full] = np.bitwise_xor.reduceat(mix(hashes ^ seeds[0]), at)
                ends = np.zeros(len(part) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(counts > 0, rule.coordinates, 0))
                empty = counts == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), *[pa.array(k.view(np.int64), mask=empty) for k in keys],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.reshape(-1).view(np.int64)))],
                    names=["doc_id", "n_shingles", "k1", "k2", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, tokens array<long>")


def postings(reps: DataFrame, rule: Rule) -> DataFrame:
    """(token, doc, weight, tokens): documents under the tokens of their prefix, and how often their tokens occur in all.

    A token of one document alone can't collide and is skipped, and so is a document with fewer than ``matches`` shared tokens. Of
    n shared tokens, from rare to frequent, the first n - matches + 1 are posted: two documents that agree in ``matches`` tokens have one
    of these in common. Frequent tokens (a licence, a common line) so get few postings.
    """
    flat = reps.select("doc", F.explode("tokens").alias("token"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    shared = (
        flat.join(often, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("found"))  # one per coordinate
        .filter(F.size("found") >= rule.matches))
    picked = F.expr(f"slice(found, 1, size(found) - {rule.matches - 1})")
    return shared.select(
        "doc", F.transform("found", lambda x: x["token"]).alias("tokens"),
        F.aggregate("found", F.lit(0).cast("long"), lambda total, x: total + x["freq"]).alias("weight"), F.explode(picked).alias("p"),
    ).select("p.token", "doc", "weight", "tokens")


def links_within(members: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) among the documents of each home, enough to connect all that are linked there.

    ``members`` has home, doc and set (sorted 64-bit hashes). A home is cut into blocks; every two blocks meet in a task that compares their sets
    and returns a spanning forest of the links, so pairs are neither shuffled nor emitted, and no task holds a whole home.
    """
    sizes = members.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("set")).alias("bytes")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / rule.block, F.col("bytes") / (rule.block << 13))).cast("int")
    placed = members.join(sizes.select("home", blocks.alias("n")), "home").withColumn("own", F.pmod(F.xxhash64("doc"), "n").cast("int"))
    units = placed.select(
        "home", "doc", "set", "own", F.explode(F.expr("sequence(0, n - 1)")).alias("other"),
    ).select("home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "set")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for home, i, j, own, doc, data in zip(*columns, batch.column(5), strict=True):
                if (home, i, j) != key:
                    out += _forest(rows, key, rule)
                    key, rows = (home, i, j), []
                rows.append((own, doc, np.frombuffer(data.as_py(), "<u8")))
            if out:
                yield _edge_batch(out)
        out += _forest(rows, key, rule)
        yield _edge_batch(out)

    return units.repartition(n, "home", "i", "j").sortWithinPartitions("home", "i", "j").mapInArrow(run, "a long, b long")


def _edge_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
    out.clear()
    return batch


def _forest(rows: list[tuple], key: tuple | None, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links among a unit's documents; block i against block j, or one block in itself."""
    if len(rows) < 2:
        return []
    sizes = np.array([len(s) for _, _, s in rows])
    ids, inverse = np.unique(np.concatenate([s for _, _, s in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(inverse, kind="stable")
    edges = np.searchsorted(inverse[order], np.arange(len(ids) + 1))
    lists = owner[order]
    shared = np.diff(edges) > 1
    block = np.array([own for own, _, _ in rows])
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    at = 0
    for x in range(len(rows)):
        mine = inverse[at : at + sizes[x]]
        at += sizes[x]
        mine = mine[shared[mine]]
        if not len(mine):
            continue
        first, width = edges[mine], edges[mine + 1] - edges[mine]
        spread = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())
        both = np.bincount(lists[spread], minlength=len(rows))
        near = 100 * both >= rule.percent * (sizes + sizes[x] - both)
        near[: x + 1] = False
        if key[1] != key[2]:
            near &= block != block[x]
        for y in np.flatnonzero(near):
            a, b = find(x), find(int(y))
            if a != b:
                root[b] = a
                found.append((rows[x][1], rows[int(y)][1]))
    return found


def with_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``wanted`` (doc, ...) with the whole shingle set of each document, read from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes, edges = shingle_sets(part.column("text"), rule.words)
                sets = [hashes[i:j].astype("<u8").tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns - 1)], pa.array(sets, pa.binary())], names=[*names, "set"])

    names = wanted.columns
    texts = wanted.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    kinds = ", ".join(f"`{c}` {t}" for c, t in wanted.dtypes)
    return texts.select(*names, "text").mapInArrow(run, f"{kinds}, set binary")


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; component_id is the least doc_id that links lead to.

    Documents with equal sets are one class, for which its least doc_id stands. Classes are posted under the tokens of their
    signature. Under each token the most central class leads; the most central leader of a class is its home. Classes of one home are compared block by block
    within tasks. Classes of different homes that meet under a token and agree in enough coordinates are compared one pair a row.
    Both compare whole sets. Texts without words are linked with nothing. Rows with equal doc_id are one document if their texts agree;
    a null doc_id stands for no class and keeps itself if nothing else of its class has an id.
    """
    base = store(signatures(docs, rule), "neardup-signatures")
    reps = base.filter("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("tokens").alias("tokens"))
    reps = store(reps, "neardup-classes")
    posted = store(postings(reps.select("doc", "tokens"), rule), "neardup-postings")
    rank = F.struct("weight", F.col("doc").alias("leader"))
    leaders = posted.groupBy("token").agg(F.max(rank).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "lead")
    homes = posted.join(leaders, "token").groupBy("doc").agg(F.max("lead").getField("leader").alias("home"))
    homes = store(homes, "neardup-homes")
    sets = store(with_sets(docs.select("doc_id", "text"), homes, rule), "neardup-sets")
    inside = links_within(sets, rule)

    at_home = posted.join(homes, "doc")
    mixed = at_home.groupBy("token").agg(F.min("home").alias("low"), F.max("home").alias("high")).filter("low < high").select("token")
    at_home = at_home.join(mixed, "token").select("token", "doc", "home", "tokens")
    left, right = at_home.alias("x"), at_home.alias("y")
    across = (
        left.join(right, (F.col("x.token") == F.col("y.token")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.home") != F.col("y.home")))
        .filter(F.size(F.array_intersect("x.tokens", "y.tokens")) >= rule.matches)
        .select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct())
    one = sets.select(F.col("doc").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("doc").alias("b"), F.col("set").alias("sb"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= rule.percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])

    confirmed = across.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(confirm, "a long, b long")
    roots = components(inside.union(confirmed))
    found = reps.select("k1", "k2", "doc").join(roots, F.col("doc") == F.col("node"), "left").select("k1", "k2", F.coalesce("root", "doc").alias("__root"))
    out = base.drop("tokens").join(found, ["k1", "k2"], "left").withColumn("component_id", F.coalesce("__root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
