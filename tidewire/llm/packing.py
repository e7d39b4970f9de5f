"""Vector bin packing of token sequences: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how many pieces are weighed against each other at a time (memory bound of a task)."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    pool: int = 4096


def pack_pool(demand: np.ndarray, limit: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of ``demand`` (pieces x resources), no bin over ``limit`` in any resource.

    One bin is open at a time. Of the pieces that fit it takes the one with the greatest dot product of its demand and what is left
    of the bin, both as shares of the limit and weighted by how scarce the resource is over the pool. Ties go to the lower row.
    """
    share = demand / limit
    if (share > 1).any():
        raise ValueError("a piece is over a limit by itself")
    weight = share.mean(axis=0)
    rest = np.lexsort([*(-share * weight).T[::-1], -(share * weight).sum(axis=1)])
    share = share[rest]
    bins = []
    while len(rest):
        left = np.ones(share.shape[1])
        chosen: list[int] = []
        used = np.zeros(len(rest), bool)
        while True:
            score = np.where(used | (share > left + 1e-9).any(axis=1), -1.0, share @ (weight * left))
            best = int(score.argmax())
            if score[best] < 0:
                break
            used[best] = True
            chosen.append(int(rest[best]))
            left = left - share[best]
        bins.append(chosen)
        rest, share = rest[~used], share[~used]
    return bins


_ODD_SPACE = re.compile(r"\s \s")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder(dict):
    """Texts to little-endian 32-bit ids by a rank file of byte pairs; keeps the ids of words it has seen, up to a bound.

    A blank between two other characters, not both of them white space, always starts a new piece of the tokenizer's pattern. Words between such
    blanks can so be encoded one by one. Texts with a blank amid white space are encoded whole.

    ``added``: tokens that stand for one id wherever a text has them; of those that start at one place the longest counts. What is between them
    is encoded as texts of their own.
    """

    BOUND = 400_000

    def __init__(self, path: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = {token: np.array([i], "<u4").tobytes() for token, i in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.plain(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.BOUND:
            self.clear()
        out = self[word] = self.whole(" " + word)
        return out

    def encode(self, text: str) -> bytes:
        if self.marks is None or not self.marks.search(text):
            return self.between(text)
        return b"".join(self.added[part] if k % 2 else self.between(part) for k, part in enumerate(self.marks.split(text)))

    def between(self, text: str) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text) or text[0] == " " or text[-1] == " ":
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, rest))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, added: tuple[tuple[str, int], ...] = ()) -> Encoder:
    """One encoder per worker process, rank file and added tokens."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of a tokenizer's json, which it recognises inside a text, and their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only added tokens that are matched as they stand are supported")
    return tuple((t["content"], t["id"]) for t in found)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, segments long, loss_tokens long"


def pack_documents(docs: DataFrame, ranks: str, end_id: int = 0, limits: Limits = Limits(), added: tuple[tuple[str, int], ...] = (),
                   prompt: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limits.tokens`` ids.

    A document is cut where a sequence is full of ids or of ids that bear loss. Pieces that leave room are packed, ``limits.pool`` at a time within a partition,
    so a task holds a bounded number of them and no row is shuffled. A document's piece is one segment. Every id bears loss, but for those of the column
    named ``prompt``: its text is encoded by itself and stands before ``text`` (null: no prompt). ``loss_tokens`` are a piece's ids that bear loss. Sequence ids
    hold the partition's number above bit 40. Null and empty texts are the end id alone. Repeated rows are packed each for itself.
    ``added`` are the tokenizer's tokens beside the rank file; without them their text is encoded like any other.
    """
    limit = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    if limit.min() < 1:
        raise ValueError("every limit must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, added).encode
        next_id = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4").tobytes()
        pool: list[tuple] = []
        out: list[tuple] = []

        def flush() -> None:
            nonlocal next_id
            demand = np.array([(p[2], 1, loss) for p, loss in pool], float)
            for chosen in pack_pool(demand, limit):
                at, total = 0, sum(pool[i][0][2] for i in chosen)
                for i in chosen:
                    piece, loss = pool[i]
                    out.append((*piece, next_id, at, total, len(chosen), loss))
                    at += piece[2]
                next_id += 1
            pool.clear()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text, before in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                free = encode(before.as_py() or "")
                ids = free + encode(text.as_py() or "") + end
                n, first = len(ids) // 4, len(free) // 4
                start = 0
                while start < n:
                    length = min(limits.tokens, n - start, max(first - start, 0) + limits.loss_tokens)
                    loss = max(0, start + length - max(start, first))
                    piece = (doc_id, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), n)
                    if length == limits.tokens:
                        out.append((*piece, next_id, 0, length, 1, loss))
                        next_id += 1
                    else:
                        pool.append((piece, loss))
                        if len(pool) >= limits.pool:
                            flush()
                    start += length
            if out:
                yield emit()
        if pool:
            flush()
        if out:
            yield emit()

    before = F.lit("") if prompt is None else F.col(prompt)
    return docs.select("doc_id", F.col("text"), before.alias("__prompt")).mapInArrow(run, SCHEMA)
