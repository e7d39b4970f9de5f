"""Toxicity scores from a linear model over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, remainder, store

ORDERS = (3, 4, 5)
BITS = 20


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit. ``sample`` bounds the labelled rows that are learned from, ``features`` the n-grams kept (65,536 at most)."""

    sample: int = 16_384
    features: int = 8_192
    least_docs: int = 3
    smoothing: float = 0.5
    ridge: float = 2.0
    rounds: int = 80


def ngram_buckets(texts: list[str], orders: tuple[int, ...] = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of every character n-gram of the lower-cased texts, each between blanks, and its text's number."""
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(orders) + 1):
        step = np.zeros(len(codes), np.uint32)
        step[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        h = (h + step + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in orders:
            inside = left >= n
            mixed = (h[inside] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - BITS)).astype(np.int32), owner[inside]


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket once per text: (text number, bucket); only those with a true entry in ``wanted``, where it is given."""
    keys = []
    for buckets, owner in ngram_buckets(texts):
        if wanted is not None:
            hit = wanted[buckets]
            buckets, owner = buckets[hit], owner[hit]
        keys.append(np.unique(owner.astype(np.int64) << BITS | buckets))
    found = np.unique(np.concatenate(keys))
    return found >> BITS, (found & ((1 << BITS) - 1)).astype(np.int32)


@dataclass
class Model:
    """Buckets with their weights, and the intercept. ``score`` depends on the text alone."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = np.zeros(1 << BITS, np.float32)
        table[self.buckets] = self.weights
        wanted = table != 0

        def score(texts: list[str]) -> np.ndarray:
            owner, bucket = present(texts, wanted)
            total = np.bincount(owner, table[bucket], len(texts)) + self.bias
            return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

        return score


def sample_labels(labels: DataFrame, label: str, bound: int, folds: int = 5) -> DataFrame:
    """One row (doc_id, y) per labelled training document; about ``bound`` of them, chosen by a hash of the id, if there are more."""
    train = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
    train = train.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = train.count()
    if n > bound:
        train = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(0.97 * bound / n * (1 << 20)))
    return train


def minimise(value_and_slope, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    f, g = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, step = g @ q, 1.0
        while step > 1e-6:
            new = x - step * q
            f2, g2 = value_and_slope(new)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - x) @ (g2 - g) > 1e-12:
            pairs = [*pairs, (new - x, g2 - g)][-memory:]
        done = abs(f - f2) <= 1e-7 * abs(f)
        x, f, g = new, f2, g2
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit: Fit = Fit()) -> Model:
    """Learn from the labelled training documents.

    The sampled label rows have a bound, so they are broadcast and only the sampled texts are shuffled. Of an id's labels the greatest
    counts, and of its texts the least, so repeated rows don't raise the bound. Document counts of n-grams are summed in Spark, and
    the most telling buckets (by chi-square) are kept. Each kept n-gram is a feature worth its log-count ratio; ridge logistic
    weights over them are found on the driver, whose data ``sample`` and ``features`` bound. Without both classes the model
    is the share of ones (one half without any label).
    """
    chosen = sample_labels(labels, label, fit.sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = store(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y"), "toxicity-sample")
    sums = texts.groupBy("y").count().collect()
    n = {int(r["y"] > 0): 0 for r in sums} | {0: 0, 1: 0}
    for r in sums:
        n[int(r["y"] > 0)] += r["count"]
    prior = (n[1] + 0.5) / (n[0] + n[1] + 1)
    if not n[0] or not n[1]:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part in chunks(batch):
                y = part.column(1).to_numpy() > 0
                owner, bucket = present(part.column(0).to_pylist())
                for k in (0, 1):
                    seen[k] += np.bincount(bucket[y[owner] == k], minlength=1 << BITS)
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[1, some]), pa.array(seen[0, some])], names=["bucket", "ones", "zeros"])

    counts = texts.mapInArrow(count, "bucket long, ones long, zeros long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    ones, zeros, all_docs = F.col("ones").cast("double"), F.col("zeros").cast("double"), float(n[0] + n[1])
    spread = (ones + zeros) * (F.lit(all_docs) - ones - zeros)
    chi = F.when(spread > 0, F.pow(ones * (n[0] - zeros) - zeros * (n[1] - ones), F.lit(2.0)) / spread).otherwise(0.0)
    a = fit.smoothing
    ratio = F.log((ones + a) / (n[1] + 2 * a)) - F.log((zeros + a) / (n[0] + 2 * a))
    kept = (
        counts.filter(ones + zeros >= fit.least_docs).select("bucket", ratio.alias("ratio"), chi.alias("chi"))
        .coalesce(16).orderBy(F.desc("chi"), "bucket").limit(fit.features).collect())  # each partition sends its best to the driver
    buckets, ratios = np.array([r["bucket"] for r in kept], np.int32), np.array([r["ratio"] for r in kept])
    place = np.full(1 << BITS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = place >= 0
        for batch in batches:
            for part in chunks(batch):
                owner, bucket = present(part.column(0).to_pylist(), wanted)
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                found = place[bucket].astype("<u2")
                rows = [found[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), part.column(1)], names=["x", "y"])

    rows = texts.mapInArrow(features, "x binary, y int").toArrow()
    y = (rows.column("y").to_numpy() > 0).astype(float)
    edges = np.r_[0, np.cumsum(pc.binary_length(rows.column("x")).to_numpy()) // 2]
    at = np.frombuffer(b"".join(x.as_py() for x in rows.column("x")), "<u2")
    del rows
    step = 1024  # documents at a time, which keeps the temporary arrays small

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, slope, total = v[1:] * ratios, np.zeros_like(v), 0.0
        for i in range(0, len(y), step):
            part = slice(i, min(i + step, len(y)))
            n_docs = part.stop - i
            own = np.repeat(np.arange(n_docs), np.diff(edges[i : part.stop + 1]))
            mine = at[edges[i] : edges[part.stop]].astype(np.intp)
            z = np.bincount(own, w[mine], n_docs) + v[0]
            miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[part]
            total += np.logaddexp(0, np.where(y[part] > 0, -z, z)).sum()
            slope[0] += miss.sum()
            slope[1:] += np.bincount(mine, miss[own], len(ratios))
        slope[1:] = slope[1:] * ratios + fit.ridge * v[1:]
        return float(total + fit.ridge / 2 * (v[1:] @ v[1:])), slope

    v = np.zeros(len(ratios) + 1)
    v[0] = np.log(prior / (1 - prior))
    v = minimise(loss, v, fit.rounds)
    return Model(buckets, (v[1:] * ratios).astype(np.float32), float(v[0]))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5, keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (without ``text`` unless it is to be kept), and score and predicted, from each whole text (null: empty).

    No shuffle. Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    names = [c for c in docs.columns if c != "text"]
    kept = [*names, "text"] if keep_text else names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = [score(part.column("text").fill_null("").to_pylist()) for part in chunks(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(np.concatenate([*found, np.zeros(0)]))], names=[*kept, "score"])

    kinds = dict(docs.dtypes)
    scored = docs.select(*names, "text").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "score double"]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Fit = Fit()) -> DataFrame:
    """Fit on the training fold and score every document."""
    model = fit(docs, labels, "toxic", settings)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
