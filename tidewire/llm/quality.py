"""Quality scores from a sparse rule ensemble: tree paths over text statistics, lasso weights, Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, remainder, store
from tidewire.llm.hashing import U, text_bytes, word_hashes, word_spans
from tidewire.llm.toxicity import sample_labels

#: Byte classes whose shares of the text are statistics; bytes in none are "other".
CLASSES = {"lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "blank": b" ", "line": b"\n", "stop": b".,;:?'\"()-",
           "exclaim": b"!", "bar": b"|", "symbol": b"#$%&*@^~<>{}[]\\=+_/`", "control": bytes([*range(10), *range(11, 32), 127]), "wide": bytes(range(128, 256))}
STATS = [f"{c}_share" for c in CLASSES] + [
    "log_bytes", "log_words", "word_bytes", "longest_word", "short_words", "long_words", "repeated_words", "repeated_lines", "words_per_line", "odd_ends"]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members)] = _k


def statistics(texts: pa.Array) -> np.ndarray:
    """texts x STATS, from whole texts. Empty texts are all zero."""
    raw, offsets = text_bytes(texts)
    n, width = len(texts), len(CLASSES) + 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * width + _CLASS[raw], minlength=n * width).reshape(n, width)
    starts, ends, edges = word_spans(raw, offsets)
    length, words = ends - starts, np.diff(edges)
    word_of = np.repeat(np.arange(n), words)
    per_word = np.maximum(words, 1)
    keys = word_of.astype(np.uint64) << U(44) | word_hashes(raw, starts, ends, lower=True) >> U(20)
    keys.sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    distinct = np.bincount((keys[fresh] >> U(44)).astype(np.int64), minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, word_of, length)
    ending = _CLASS[raw[ends - 1]] if len(ends) else np.zeros(0, np.int64)
    odd = np.isin(ending, [list(CLASSES).index(c) for c in ("exclaim", "bar", "symbol")])
    share = lambda mask: np.bincount(word_of, mask, n) / per_word
    lines = [t.as_py().split("\n") if t.is_valid else [""] for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    return np.column_stack([
        counts[:, :-1] / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(words), np.bincount(word_of, length, n) / per_word, np.log1p(longest),
        share(length <= 3), share(length >= 15), 1 - distinct / per_word * (words > 0) - (words == 0), repeated, words / [len(x) for x in lines], share(odd)])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a column per statistic instead of ``text``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(found[:, k]) for k in range(len(STATS))]], names=[*names, *STATS])

    names = [c for c in docs.columns if c != "text"]
    kinds = [f"`{c}` {t}" for c, t in docs.dtypes if c != "text"] + [f"{s} double" for s in STATS]
    return docs.select(*names, "text").mapInArrow(run, ", ".join(kinds))


@dataclass(frozen=True)
class Fit:
    """``sample`` bounds the labelled rows learned from. Trees give the rules; the lasso's ``penalty`` decides how many stay."""

    sample: int = 16_384
    trees: int = 24
    depth: int = 3
    penalty: float = 0.002
    rounds: int = 80
    seed: int = 11


#: A rule: conditions (statistic, at_most, threshold) that hold together.
Rule = tuple[tuple[str, bool, float], ...]


def column_of(rule: Rule) -> Column:
    """The rule as a boolean Spark expression."""
    out = F.lit(True)
    for stat, at_most, threshold in rule:
        out = out & (F.col(stat) <= threshold if at_most else F.col(stat) > threshold)
    return out


def tree_rules(forest) -> list[Rule]:
    """Every path from a root to a node, as a conjunction; conditions on the same side of one statistic are merged."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found[tuple(sorted((s, m, t) for (s, m), t in path.items()))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            stat, threshold = STATS[node.split().featureIndex()], float(node.split().threshold())
            walk(node.leftChild(), path | {(stat, True): min(threshold, path.get((stat, True), threshold))})
            walk(node.rightChild(), path | {(stat, False): max(threshold, path.get((stat, False), threshold))})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") and tree._java_obj is not None else tree._call_java("rootNode"), {})
    return list(found)


@dataclass
class Model:
    """Rules with weights, and the intercept."""

    rules: list[tuple[Rule, float]]
    bias: float

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(column_of(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Fit = Fit()) -> Model:
    """Learn from the labelled training documents. Without both classes the model is the share of ones (one half without any)."""
    chosen = sample_labels(labels, label, settings.sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text")
    rows = store(with_statistics(rows), "quality-sample").withColumn("label", (F.col("y") > 0).cast("double"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = (ones + 0.5) / (n + 1)
    if not 0 < ones < n:
        return Model([], float(np.log(prior / (1 - prior))))
    table = rows.select("label", array_to_vector(F.array(*STATS)).alias("features"))
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=5, subsamplingRate=0.7, seed=settings.seed).fit(table)
    rules = tree_rules(forest)
    if not rules:
        return Model([], float(np.log(prior / (1 - prior))))
    flags = F.array(*[F.when(column_of(r), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=settings.penalty, maxIter=settings.rounds, standardization=False)
    fitted = lasso.fit(rows.select("label", array_to_vector(flags).alias("features")))
    weights = fitted.coefficients.toArray()
    return Model([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w], float(fitted.intercept))


def quality(docs: DataFrame, labels: DataFrame, settings: Fit = Fit(), threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document: statistics of its whole text (null: empty), then the rules as columns."""
    model = fit(docs, labels, "quality", settings)
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", model.score())
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
