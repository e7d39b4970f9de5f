"""Nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is put into a leaf. A query walks the tree best bin first, with a priority queue, and visits as
many leaves as some probes, whose exact neighbours are known, need for the wanted recall. Vectors get one more component that makes all of them
equally long, so that the largest inner product is the least distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id long, rank int, vec_id long, score double"
_HITS = "query_id long, vec_id long, score double, leaf int"


@dataclass(frozen=True)
class Settings:
    """Neighbours wanted, and the recall that probes must reach.

    The tree has ``branching`` children per node and leaves of about ``leaf`` vectors, as far as ``sample`` vectors (fewer if they are long: ``sample_bytes``) can tell;
    these and ``probes`` queries are all that the driver holds. A task holds a piece of about ``piece`` vectors; larger leaves are cut.
    """

    neighbours: int = 20
    recall: float = 0.95
    branching: int = 16
    leaf: int = 256
    sample: int = 32_768
    sample_bytes: int = 64 << 20
    probes: int = 256
    piece: int = 4_096
    rounds: int = 10


# --- the tree ---------------------------------------------------------------

@dataclass
class Tree:
    """Centroids of all nodes, children of each node, and the leaf number of a node (-1 inside). ``scale`` and ``radius`` make vectors equally long."""

    scale: float
    radius: float
    centroids: list = field(default_factory=list)
    children: list = field(default_factory=list)
    leaf: list = field(default_factory=list)
    leaves: int = 0

    def stretched(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the component that brings them to the common length."""
        x = x * self.scale
        rest = np.sqrt(np.maximum(0.0, self.radius - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest])

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries brought to the common length, which changes no order, and without the further component."""
        q = q * (1 / np.abs(q).max(axis=1))[:, None]
        q = q * np.sqrt(self.radius / np.einsum("ij,ij->i", q, q))[:, None]
        return np.column_stack([q, np.zeros(len(q))])

    def distances(self, x: np.ndarray, nodes: list[int] | slice) -> np.ndarray:
        """Squared distances, less what all nodes have in common."""
        c = np.asarray(self.centroids)[nodes]
        return np.einsum("ij,ij->i", c, c)[None] - 2 * (x @ c.T)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, from the nearest child to the nearest child."""
        x, out = self.stretched(x), np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            choice = self.distances(x[rows], self.children[node]).argmin(axis=1)
            stack += [(child, rows[choice == k]) for k, child in enumerate(self.children[node]) if (choice == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` leaves of each query, in the order in which the priority queue gives them."""
        most = min(most, self.leaves)
        out = np.empty((len(q), most), np.int32)
        step = max(1, (1 << 22) // len(self.centroids))
        for first in range(0, len(q), step):
            far = self.distances(self.asked(q[first : first + step]), slice(None))
            for i, row in enumerate(far):
                queue, found = [(0.0, 0)], 0
                while found < most:
                    node = heapq.heappop(queue)[1]
                    if self.leaf[node] >= 0:
                        out[first + i, found] = self.leaf[node]
                        found += 1
                    else:
                        for child in self.children[node]:
                            heapq.heappush(queue, (row[child], child))
        return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and the centroid of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    choice = np.zeros(len(x), np.int64)
    for turn in range(rounds):
        now = (np.einsum("ij,ij->i", c, c)[None] - 2 * (x @ c.T)).argmin(axis=1)
        if turn and (now == choice).all():
            break
        choice = now
        sums = np.zeros_like(c)
        np.add.at(sums, choice, x)
        n = np.bincount(choice, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c, choice


def fit_tree(sample: np.ndarray, total: int, settings: Settings, scale: float, radius: float) -> Tree:
    """A tree over ``total`` vectors, of which ``sample`` holds some. Scaled vectors have a squared length of ``radius`` at most."""
    tree = Tree(scale, radius)
    x, rng = tree.stretched(sample), np.random.default_rng(0)
    each = total / len(x)

    def add(rows: np.ndarray, centroid: np.ndarray) -> int:
        me = len(tree.leaf)
        tree.centroids.append(centroid)
        tree.children.append([])
        tree.leaf.append(-1)
        k = min(settings.branching, int(np.ceil(len(rows) * each / settings.leaf)))
        if k > 1 and len(rows) >= 4 * k:
            c, choice = k_means(x[rows], k, settings.rounds, rng)
            parts = [j for j in range(k) if (choice == j).any()]
            if len(parts) > 1:
                tree.children[me] = [add(rows[choice == j], c[j]) for j in parts]
                return me
        tree.leaf[me] = tree.leaves
        tree.leaves += 1
        return me

    add(np.arange(len(x)), x.mean(axis=0))
    return tree


# --- vectors ----------------------------------------------------------------

def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(id, v): rows with an id whose vector has finite components only, not all zero, and ``dims`` of them: if not given, as many as most of the vectors have
    (the longer kind among equals)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    if dims is None:
        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
        dims = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("v") == dims)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, added from the first component to the last, so that equal vectors get equal sums wherever they stand."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score): the k nearest of each query by exact score and id, its own id left out and each id once. Ties with the last one are kept."""
    found = []
    step = max(1, (1 << 21) // max(1, len(x)))
    for first in range(0, len(q), step):
        part = q[first : first + step]
        score = part @ x.T
        score[q_ids[first : first + step, None] == x_ids[None]] = -np.inf
        if len(x) > k:
            bar = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
            slack = 1e-12 * np.abs(part).sum(axis=1) * np.abs(x).max()
            a, b = np.nonzero((score >= (bar - slack)[:, None]) & (score > -np.inf))
        else:
            a, b = np.nonzero(score > -np.inf)
        found.append((a + first, b, dots(part[a], x[b])))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def first_k(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query: greater score, then smaller id; an id counts once."""
    order = np.lexsort([ids, -score, query])
    q, i = query[order], ids[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    order = order[fresh]  # equal ids with equal vectors stand together
    q = query[order]
    start = np.searchsorted(q, q)
    return order[np.arange(len(order)) - start < k]


def exact(vectors: DataFrame, q: np.ndarray, q_ids: np.ndarray, tree: Tree, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): the k nearest of a few queries among all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            if len(ids):
                a, b, s = best(q, q_ids, x, ids, k)
                keep = first_k(a, ids[b], s, k)
                yield _hits(q_ids[a[keep]], ids[b[keep]], s[keep], tree.leaf_of(x[b[keep]]))

    return _ranked(vectors.mapInArrow(run, _HITS), k)


def _hits(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "leaf"])


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits per query with their rank; the tasks have sent k a piece at most."""
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("leaf").alias("leaf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- search -----------------------------------------------------------------

def calibrated(vectors: DataFrame, queries: DataFrame, tree: Tree, settings: Settings) -> int:
    """How many leaves a query must visit, widened one by one until the probes' neighbours are found with the wanted recall."""
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(settings.probes).toArrow()
    if not len(probes) or tree.leaves == 1:
        return 1
    q, ids = matrix(probes.column("v")), probes.column("id").to_numpy()
    order = tree.visits(q, tree.leaves)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(tree.leaves, dtype=np.int32)[None], axis=1)
    place = {int(i): k for k, i in enumerate(ids)}
    truth = exact(vectors, q, ids, tree, settings.neighbours).select("query_id", "leaf").collect()  # probes x neighbours rows
    turns = np.sort([turn[place[r["query_id"]], r["leaf"]] for r in truth])
    return int(turns[int(np.ceil(settings.recall * len(turns))) - 1]) + 1 if len(turns) else 1


def nearest(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest vectors found for each row of ``queries``; both tables have vec_id and embedding.

    Rows without an id, and vectors that are null, zero, of an uncommon length or hold null or non-finite components, take no part. A repeated
    row counts once; of several vectors under one id each is searched, and the least is the query. A query's own id is no neighbour. Ties go to the smaller
    id. An empty table gives an empty result, a table of no more than ``leaf`` vectors an exact one.
    """
    spark = vectors.sparkSession
    base = usable(vectors)
    total, dims, largest = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not total:
        return spark.createDataFrame([], RESULT)
    scale = 1 / largest
    radius = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * scale * x * scale))).first()[0]
    asked = usable(queries, dims).groupBy("id").agg(F.min("v").alias("v"))
    bound = min(settings.sample, settings.sample_bytes // (8 * dims))
    share = int(min(1.0, 0.97 * bound / total) * (1 << 20))
    picked = base.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).groupBy("id").agg(F.min("v").alias("v")).select("v").toArrow()
    sample = picked if len(picked) else base.limit(1).select("v").toArrow()
    tree = fit_tree(matrix(sample.column("v")), total, settings, scale, radius)
    visits = calibrated(base, asked, tree, settings)

    def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(matrix(batch.column(1))) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    placed = base.mapInArrow(to_leaf, "id long, v array<double>, leaf int")
    counts = {r["leaf"]: r["k"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("k")).collect()}  # as many rows as leaves
    # neighbouring leaves share a piece; a leaf that is larger than a piece is cut into several
    unit, cuts, held, number = np.zeros(tree.leaves, np.int32), {}, 0, 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if held and held + n > settings.piece:
            number, held = number + 1, 0
        unit[leaf], held = number, held + n
        cuts[number] = max(cuts.get(number, 1), -(-n // settings.piece))
    pieces = np.array([cuts[u] for u in range(number + 1)])

    def as_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in to_leaf(batches):
            if len(batch):
                ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                u = unit[leaf]
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cut = (mixed % pieces[u].astype(np.uint64)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32)), pa.array(leaf, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(cut), pa.array(np.zeros(len(ids), np.int32)), lists, *batch.columns[:2]], names=names)

    def as_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [])
            for i, leaves in enumerate(tree.visits(matrix(batch.column(1)), visits)) if len(batch) else ():
                units = unit[leaves]
                for u in np.unique(units):
                    for cut in range(pieces[u]):
                        for to, value in zip(rows, (u, cut, leaves[units == u], i), strict=True):
                            to.append(value)
            who = pa.array(rows[3], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(np.ones(len(who), np.int32)), pa.array(rows[2], pa.list_(pa.int32())),
                 batch.column(0).take(who), batch.column(1).take(who)], names=names)

    names = ["unit", "cut", "role", "leaves", "id", "v"]
    schema = "unit int, cut int, role int, leaves array<int>, id long, v array<double>"
    both = base.mapInArrow(as_points, schema).union(asked.mapInArrow(as_queries, schema))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(pieces.sum()), 1 << 16))
    dealt = both.repartition(n, "unit", "cut").sortWithinPartitions("unit", "cut", "role")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, points, ready = None, [], None
        for batch in batches:
            unit_, cut, role = (batch.column(i).to_numpy() for i in range(3))
            change = np.flatnonzero((unit_[1:] != unit_[:-1]) | (cut[1:] != cut[:-1]) | (role[1:] != role[:-1])) + 1
            for first, end in zip(np.r_[0, change], np.r_[change, len(batch)], strict=True):
                if first == end:
                    continue
                part = batch.slice(first, end - first)
                if (unit_[first], cut[first]) != key:
                    key, points, ready = (unit_[first], cut[first]), [], None
                if role[first] == 0:
                    points.append((part.column(3).flatten().to_numpy(), part.column(4).to_numpy(), matrix(part.column(5))))
                    continue
                if not points:
                    continue
                if ready is None:
                    leaf, ids, x = (np.concatenate(c) for c in zip(*points, strict=True))
                    order = np.argsort(leaf, kind="stable")
                    ready, points = (leaf[order], ids[order], x[order]), [()]
                yield _found(ready, part, settings.neighbours)

    hits = dealt.mapInArrow(search, _HITS)
    return _ranked(hits, settings.neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _found(ready: tuple, part: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The k best of each query of ``part`` in the leaves of a piece that it visits."""
    leaf, ids, x = ready
    q_ids, q = part.column(4).to_numpy(), matrix(part.column(5))
    wanted = part.column(3).flatten().to_numpy()
    owner = np.repeat(np.arange(len(q)), np.diff(part.column(3).offsets.to_numpy()))
    out = []
    for one in np.unique(wanted):
        low, high = np.searchsorted(leaf, [one, one + 1])
        if low < high:
            who = owner[wanted == one]
            a, b, s = best(q[who], q_ids[who], x[low:high], ids[low:high], k)
            keep = first_k(a, ids[low:high][b], s, k)
            out.append((who[a[keep]], ids[low:high][b[keep]], s[keep]))
    if not out:
        return _hits(*[np.zeros(0)] * 4)
    a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
    keep = first_k(a, b, s, k)
    return _hits(q_ids[a[keep]], b[keep], s[keep], np.zeros(len(keep), np.int32))


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> float:
    """The share of the true neighbours of up to ``probes`` queries that ``found`` has."""
    base = usable(vectors)
    probes = base.join(queries.select(F.col("vec_id").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    probes = probes.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(settings.probes).toArrow()
    if not len(probes):
        return 1.0
    q = matrix(probes.column("v"))
    tree = fit_tree(q[:1], 1, settings, 1.0, 0.0)
    truth = exact(base, q, probes.column("id").to_numpy(), tree, settings.neighbours)
    both = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, truth.count())
