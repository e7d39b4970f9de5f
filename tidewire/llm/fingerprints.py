"""One-permutation MinHash fingerprints of five-word shingles, with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import CHUNK_BYTES
from tidewire.llm.hashing import U, mix, text_bytes, windows, word_hashes, word_spans


@dataclass(frozen=True)
class Shape:
    """Bins (a power of two), low-order bits kept of each bin's minimum (4 or 8), words in a shingle."""

    bins: int = 512
    bits: int = 4
    words: int = 5


_VALUE_BITS = 36


def bin_values(texts: list[str], shape: Shape) -> np.ndarray:
    """texts x bins: the low-order bits of every bin's minimum after densification. Rows of texts without words are zero.

    Shingle hashes are dealt to bins once, by their top bits; each bin keeps its least value. An empty bin takes the value of the bin that
    a hash of (bin, attempt) names first among the filled ones. Words are lower-cased (A-Z); fewer words than a shingle has are one shingle.
    """
    raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
    starts, ends, edges = word_spans(raw, offsets)
    hashes, owner = windows(word_hashes(raw, starts, ends, lower=True), edges, shape.words, short=True)
    out = np.zeros((len(texts), shape.bins), np.uint64)
    filled = np.zeros((len(texts), shape.bins), bool)
    log_bins = shape.bins.bit_length() - 1
    for low in range(0, len(texts), 1 << 16):  # the text's number takes 16 of the 64 bits that are sorted
        some = slice(*np.searchsorted(owner, [low, low + (1 << 16)]))
        keys = (owner[some] - low).astype(np.uint64) << U(log_bins + _VALUE_BITS) | hashes[some] >> U(64 - log_bins - _VALUE_BITS)
        keys.sort()
        cell = (keys >> U(_VALUE_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        at = (low + (cell[first] >> log_bins), cell[first] & (shape.bins - 1))
        out[at] = keys[first] & U((1 << _VALUE_BITS) - 1)
        filled[at] = True
    text, cell = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 0
    while len(text):
        attempt += 1
        source = (mix(cell.astype(np.uint64) * U(1 << 32) + U(attempt)) & U(shape.bins - 1)).astype(np.int64)
        hit = filled[text, source]
        out[text[hit], cell[hit]] = out[text[hit], source[hit]]
        text, cell = text[~hit], cell[~hit]
    # The bin's number takes part, else a short text's few values, copied over many bins, would agree with another's all at once.
    low_bits = (mix(out + np.arange(shape.bins, dtype=np.uint64) * U(1 << 40)) & U((1 << shape.bits) - 1)).astype(np.uint8)
    low_bits[~filled.any(axis=1)] = 0
    return low_bits


def packed(values: np.ndarray, shape: Shape) -> list[str]:
    """Hexadecimal strings of the kept bits, bin after bin."""
    data = values if shape.bits == 8 else values[:, 0::2] << 4 | values[:, 1::2]
    return [row.tobytes().hex() for row in np.ascontiguousarray(data)]


def likeness(a: np.ndarray, b: np.ndarray, shape: Shape) -> np.ndarray:
    """Estimated similarity of paired rows: the share of equal bins less what chance gives, 2 to the power of minus bits."""
    chance = 0.5**shape.bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def fingerprint(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """doc_id and fingerprint of every document, without a shuffle. Null texts are empty; texts without words are all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _runs(zip(batch.column(0).to_pylist(), (t.as_py() or "" for t in batch.column(1)), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed(bin_values(texts, shape), shape))], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _runs(rows: Iterator[tuple], most_rows: int = 2048) -> Iterator[tuple[list, ...]]:
    """Lists of columns of successive rows whose last field, a text, has about CHUNK_BYTES in all."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > CHUNK_BYTES or len(held) >= most_rows:
            yield tuple(map(list, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held, strict=True)))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _next_in_order(docs: DataFrame) -> DataFrame:
    """Rows (part, extra, doc_id, text) in which each part, ordered, is a run of documents by descending doc_id with the one that follows it.

    Cuts between parts are quantiles of the ids. The greatest id of each part is known from the ids alone; that row goes to the part
    before it as well, marked ``extra``, and the first document of all to the last part. The texts are shuffled once.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(least)).alias("__key"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("__key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("long")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), side="right"))

    tops = sorted((r["part"], r["top"]) for r in rows.select("__key", part_of("__key").alias("part")).groupBy("part").agg(F.max("__key").alias("top")).collect())
    # At most one row per part: the part before each, in descending order, is the next higher one that has rows.
    before = {part: tops[(i + 1) % len(tops)][0] if i + 1 < len(tops) else tops[0][0] for i, (part, _) in enumerate(tops)}
    marks = spark.createDataFrame([(top, before[part]) for part, top in tops] or [(0, 0)], "__key long, __before long")
    rows = rows.withColumn("part", part_of("__key")).join(F.broadcast(marks), "__key", "left")
    own = F.struct(F.col("part"), F.lit(False).alias("extra"))
    also = F.struct(F.col("__before").alias("part"), F.lit(True).alias("extra"))
    places = F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("p")
    rows = rows.select(places, "__key", "doc_id", "text").select("p.part", "p.extra", "__key", "doc_id", "text")
    return rows.repartition(n, "part").sortWithinPartitions("part", "extra", F.desc("__key"), "text").select("part", "extra", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Fingerprints of every text and of the text edited: its last half replaced by as much of the next document's beginning.

    The next document is the one with the next smaller doc_id (after the least: the greatest); equal ids go by text, a null id is
    least. Null texts are empty. ``near_edited`` and ``near_next`` estimate the likeness to the edited and to the next text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), (t.as_py() for t in batch.column(3)), strict=True)

        carry: tuple = ()
        for part, extra, ids, texts in _runs(rows()):
            if carry:
                part, extra, ids, texts = [carry[0], *part], [carry[1], *extra], [carry[2], *ids], [carry[3], *texts]
            carry = (part[-1], extra[-1], ids[-1], texts[-1])
            own = [i for i in range(len(ids) - 1) if not extra[i] and part[i] == part[i + 1]]
            if not own:
                continue
            mine = bin_values(texts, shape)
            new = [texts[i][: (len(texts[i]) + 1) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
            theirs = bin_values(new, shape)
            at = np.array(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), pa.array(packed(mine[at], shape)), pa.array(packed(theirs, shape)),
                 pa.array(likeness(mine[at], theirs, shape)), pa.array(likeness(mine[at], mine[at + 1], shape))],
                names=[f.split()[0] for f in SCHEMA.split(", ")])

    return _next_in_order(docs).mapInArrow(run, SCHEMA)
