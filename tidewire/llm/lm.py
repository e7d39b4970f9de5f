"""Language-model scores from a word n-gram model kept in Elias-Fano tries, one per shard of the contexts.

Documents are read in blocks. A block asks each shard for the words and n-grams it has, each once, and adds how often its training
documents have them. The shard sums these counts over all blocks, builds its trie and answers every block in the order it asked. With the answers
the block's documents are scored. So what is shuffled follows the corpus, no task holds the model, and the driver sees two sums.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, remainder, store
from tidewire.llm.eliasfano import Trie, dequantise, numbered
from tidewire.llm.hashing import U, mix, text_bytes, word_hashes, word_spans

#: Names of the end token and of the context before the first word.
END, START = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: Bits of a hash that stand for a word, for a context in its shard, and for a word after a given context.
_WORD_BITS, _CONTEXT_BITS, _NEXT_BITS = 48, 40, 32


@dataclass(frozen=True)
class Settings:
    """Additive smoothing of words, absolute discount of n-grams, fold left out of training, tokens in a block, words of the longest n-grams."""

    additive: float = 0.1
    discount: float = 0.75
    folds: int = 10
    block: int = 1_500_000
    order: int = 2


@dataclass
class Block:
    """Tokens of successive documents: numbers in ``words`` (distinct hashes, ascending), and the documents' offsets in them."""

    doc_ids: list
    train: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    edges: np.ndarray


def _ended(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the end token after each document."""
    return np.insert(words, edges[1:], END), edges + np.arange(len(edges))


def blocks(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[Block]:
    """Blocks of whole documents of about ``settings.block`` tokens, in the order of the rows (doc_id, train, text)."""
    held: list[tuple] = []

    def settle() -> Block:
        ids, train = [i for ids, _, _, _ in held for i in ids], np.concatenate([t for _, t, _, _ in held])
        edges = np.r_[0, np.cumsum(np.concatenate([np.diff(e) for _, _, _, e in held]))]
        hashes = np.concatenate([h for _, _, h, _ in held])
        held.clear()
        # Words recur: a hash table first, and only the distinct ones are sorted.
        coded = pa.array(hashes).dictionary_encode()
        words, number = numbered(coded.dictionary.to_numpy())
        return Block(ids, train, words, number[coded.indices.to_numpy()], edges)

    for batch in batches:
        for part in chunks(batch):
            raw, offsets = text_bytes(part.column("text"))
            starts, ends, edges = word_spans(raw, offsets)
            hashes, edges = _ended(word_hashes(raw, starts, ends, lower=True), edges)
            held.append((part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False), hashes, edges))
            if sum(len(h) for _, _, h, _ in held) >= settings.block:
                yield settle()
    if held:
        yield settle()


@dataclass
class Level:
    """What a block asks of n-grams of one length, in order of the shards: (shard, context) pairs, and n-grams, each at its context's pair.

    ``hashes`` are those of the contexts; ``token_grams`` is the n-gram that ends at each token, -1 where the document is too short for one.
    """

    hashes: np.ndarray
    pair_shards: np.ndarray
    pair_contexts: np.ndarray
    gram_pairs: np.ndarray
    gram_words: np.ndarray
    token_grams: np.ndarray


@dataclass
class Question:
    """What a block asks, in order of the shards: words, and n-grams level by level, from two words on."""

    word_order: np.ndarray
    word_shards: np.ndarray
    levels: list[Level]


def joined(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of contexts that are longer by a word."""
    return mix(contexts * U(0x9E3779B97F4A7C15) + words)


def context_hashes(hashes: np.ndarray, edges: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Level by level, the hashes of the contexts of all tokens that have one of that length. The first context of a document is START."""
    place = np.arange(len(hashes)) - np.repeat(edges[:-1], np.diff(edges))
    context = np.empty_like(hashes)
    context[1:] = hashes[:-1]
    context[edges[:-1][np.diff(edges) > 0]] = START
    for n in range(2, order + 1):
        yield context[place >= n - 2]
        context[1:] = joined(context[:-1], hashes[:-1])


def ask(block: Block, shards: int, spread: np.ndarray) -> Question:
    """``spread``: level by level, into how many shards the successors of a context go, by the top 16 bits of its hash; frequent ones have several."""
    # A block's arrays are as narrow as their numbers allow: they are most of a task's memory.
    hashes = np.r_[block.words, START]
    n = len(hashes)
    word_bits = n.bit_length()
    home = (mix(block.words) % U(shards)).astype(np.int32)
    word_order = np.argsort(home, kind="stable")
    salt = mix(hashes + U(1))
    place = (np.arange(len(block.tokens)) - np.repeat(block.edges[:-1], np.diff(block.edges))).astype(np.int32)
    context = np.empty(len(block.tokens), np.int32)
    context[1:] = block.tokens[:-1]
    context[block.edges[:-1]] = n - 1
    known, levels = hashes, []
    for k, ways_of in enumerate(spread):
        has = np.flatnonzero(place >= k)
        m = len(known)
        keys = context[has].astype(np.int64)
        keys <<= word_bits
        keys |= block.tokens[has]
        keys, grams = numbered(keys, m << word_bits)
        v = (keys >> word_bits).astype(np.int32)
        w = (keys & ((1 << word_bits) - 1)).astype(np.int32)
        del keys
        at = (mix(known) % U(shards)).astype(np.int32)
        ways = ways_of.astype(np.int32)[(known >> U(48)).astype(np.uint16)]
        wide = np.flatnonzero(ways > 1)
        shard = at[v]
        if len(wide):
            split = np.flatnonzero(ways[v] > 1)
            shard[split] = (shard[split] + (salt[w[split]] % ways[v[split]].astype(np.uint64)).astype(np.int32)) % shards
        # N-grams ascend by context, so by shard alone is by shard and context. Small numbers are sorted by radix.
        order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")
        placed = shard[order].astype(np.int64)
        placed *= m
        placed += v[order]
        fresh = np.ones(len(placed), bool)
        fresh[1:] = placed[1:] != placed[:-1]
        pairs = placed[fresh]
        if len(wide):
            # A context with several shards asks all of them how often they have seen it.
            wide = wide[np.bincount(v, minlength=m)[wide] > 0]
            extra_v = np.repeat(wide, ways[wide])
            turn = np.arange(len(extra_v)) - np.repeat(np.cumsum(ways[wide]) - ways[wide], ways[wide])
            pairs = np.sort(np.r_[pairs, (at[extra_v].astype(np.int64) + turn) % shards * m + extra_v])
            pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        gram_pairs = np.searchsorted(pairs, placed).astype(np.int32) if len(wide) else np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        del placed, fresh, shard
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        token_grams = np.full(len(block.tokens), -1, np.int32)
        token_grams[has] = back[grams]
        del back
        levels.append(Level(known, (pairs // m).astype(np.int32), (pairs % m).astype(np.int32), gram_pairs, w[order], token_grams))
        del order, pairs
        if k + 1 < len(spread):
            # The n-gram that ends at a token is the next token's context one level up.
            known = joined(known[v], hashes[w])
            on = has + 1 < len(context)
            context[has[on] + 1] = grams[on]
    return Question(word_order, home[word_order], levels)


def narrow(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def pack(arrays: list[np.ndarray]) -> bytes:
    """Compressed arrays. Of wider numbers all first bytes come first, then all second ones: the upper ones are mostly zero."""
    head = struct.pack("<i", len(arrays)) + b"".join(struct.pack("<ci", a.dtype.char.encode(), len(a)) for a in arrays)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.compress(head + b"".join(planes), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(data)
    (n,), at, out = struct.unpack_from("<i", data), 4, []
    shapes = []
    for _ in range(n):
        kind, size = struct.unpack_from("<ci", data, at)
        shapes.append((np.dtype(kind.decode()), size))
        at += struct.calcsize("<ci")
    for kind, size in shapes:
        planes = np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += kind.itemsize * size
    return out


def key_bytes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of each hash, as bytes."""
    return np.ascontiguousarray((hashes >> U(64 - bits)).view(np.uint8).reshape(-1, 8)[:, : bits // 8]).reshape(-1)


def keys_of(data: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros((len(data) // (bits // 8), 8), np.uint8)
    out[:, : bits // 8] = data.reshape(-1, bits // 8)
    return out.reshape(-1).view(np.uint64)


def _shards(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def context_spread(docs: DataFrame, shards: int, order: int) -> np.ndarray:
    """Level by level, how many shards the successors of a context go to, by the top 16 bits of its hash.

    Contexts are counted by level and these bits over all documents; where a share of a level is over a quarter of an even shard, it is split.
    Each task sends only buckets that may matter, so the driver gets a bounded number of rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((order - 1, 1 << 16), np.int64)
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                starts, ends, edges = word_spans(raw, offsets)
                hashes, edges = _ended(word_hashes(raw, starts, ends, lower=True), edges)
                for level, contexts in enumerate(context_hashes(hashes, edges, order)):
                    seen[level] += np.bincount((contexts >> U(48)).astype(np.int64), minlength=1 << 16)
        for level, counts in enumerate(seen):
            some = np.flatnonzero(counts > counts.sum() / (8 * shards))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some) + 1, level)), pa.array(np.r_[some, -1]), pa.array(np.r_[counts[some], counts.sum()])], names=["level", "bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "level long, bucket long, n long").groupBy("level", "bucket").agg(F.sum("n").alias("n")).collect()
    totals = {r["level"]: max(1, r["n"]) for r in rows if r["bucket"] < 0}
    out = np.ones((order - 1, 1 << 16), np.int64)
    for level, bucket, n in rows:
        if bucket >= 0:
            out[level, bucket] = min(shards, max(1, -(-4 * shards * n // totals[level])))
    return out


def _block_id(k: int) -> int:
    return TaskContext.get().partitionId() << 24 | k


def questions(docs: DataFrame, shards: int, spread: np.ndarray, settings: Settings) -> DataFrame:
    """(shard, block, asked): the words and n-grams of each block, with the counts of its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(blocks(batches, settings)):
            q = ask(block, shards, spread)
            train = np.repeat(block.train, np.diff(block.edges)).astype(bool)
            seen = np.bincount(block.tokens[train], minlength=len(block.words))[q.word_order]
            hashes = np.r_[block.words, START]
            each = np.arange(shards + 1)
            a = np.searchsorted(q.word_shards, each)
            rows = [[key_bytes(block.words[q.word_order[a[s] : a[s + 1]]], _WORD_BITS), narrow(seen[a[s] : a[s + 1]])] for s in range(shards)]
            for level in q.levels:
                grams = np.bincount(level.token_grams[train & (level.token_grams >= 0)], minlength=len(level.gram_words))
                per_pair = np.bincount(level.gram_pairs, minlength=len(level.pair_contexts))
                b, c = np.searchsorted(level.pair_shards, each), np.searchsorted(level.pair_shards[level.gram_pairs], each)
                for s in range(shards):
                    rows[s] += [
                        key_bytes(level.hashes[level.pair_contexts[b[s] : b[s + 1]]], _CONTEXT_BITS), narrow(per_pair[b[s] : b[s + 1]]),
                        key_bytes(hashes[level.gram_words[c[s] : c[s + 1]]], _NEXT_BITS), narrow(grams[c[s] : c[s + 1]])]
            rows = [pack(row) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([_block_id(k)] * shards, pa.int64()), pa.array(rows, pa.binary())], names=["shard", "block", "asked"])

    return docs.mapInArrow(run, "shard int, block long, asked binary")


@dataclass
class Asked:
    """What all blocks ask of a shard's n-grams of one length, each once, ascending by context and word, with their counts in training.

    ``gram_contexts`` and ``gram_words`` are numbers among ``contexts`` and ``words``. ``pairs`` and ``grams`` are the numbers of the contexts
    and n-grams as the blocks ask for them, one block after the other.
    """

    contexts: np.ndarray
    words: np.ndarray
    gram_contexts: np.ndarray
    gram_words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    grams: np.ndarray

    @classmethod
    def of(cls, parts: list[list[np.ndarray]]) -> Asked:
        """Of each block: contexts, n-grams of each, each n-gram's last word, its count in training."""
        contexts, pairs = numbered(keys_of(np.concatenate([v for v, _, _, _ in parts]), _CONTEXT_BITS), 1 << _CONTEXT_BITS)
        words, last = numbered(keys_of(np.concatenate([w for _, _, w, _ in parts]), _NEXT_BITS), 1 << _NEXT_BITS)
        word_bits = len(words).bit_length()
        keys = np.repeat(pairs, np.concatenate([each for _, each, _, _ in parts])).astype(np.int64)
        keys <<= word_bits
        keys |= last
        keys, grams = numbered(keys, max(1, len(contexts)) << word_bits)
        counts = np.bincount(grams, np.concatenate([n for _, _, _, n in parts]), len(keys)).astype(np.int64)
        return cls(contexts, words, (keys >> word_bits).astype(np.int32), (keys & ((1 << word_bits) - 1)).astype(np.int32), counts, pairs, grams)

    def trained(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, words and counts of the n-grams that training documents have."""
        some = np.flatnonzero(self.counts > 0)
        return self.contexts[self.gram_contexts[some]], self.words[self.gram_words[some]], self.counts[some]

    def answered(self, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each pair's context was seen, its kinds of successors, and each n-gram's code, as the blocks ask for them."""
        context, seen, kinds = trie.context(self.contexts)
        each = np.bincount(self.gram_contexts, minlength=len(self.contexts))
        codes = trie.probability_codes(context, each, self.words, self.gram_words)
        return seen[self.pairs], kinds[self.pairs], codes[self.grams]


def _summed(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and counts of the n-grams that training documents have, over all blocks, each once."""
    return Asked.of(parts).trained()


def answers(asked: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """(block, shard, told, tokens, kinds): each shard's answers; in the row with a null block its training tokens and their kinds.

    A shard holds what all blocks ask of it: about the corpus divided by the number of shards. Each level has a trie of its own, in turn.
    """

    def settle(rows: list[tuple[int, bytes]], shard: int) -> Iterator[pa.RecordBatch]:
        parts = [unpack(data) for _, data in rows]
        word, inverse = numbered(keys_of(np.concatenate([p[0] for p in parts]), _WORD_BITS), 1 << _WORD_BITS)
        counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)
        told, at = [], 0
        for p in parts:
            told.append([narrow(counts[inverse[at : at + len(p[1])]])])
            at += len(p[1])
        for level in range(settings.order - 1):
            mine = [p[2 + 4 * level : 6 + 4 * level] for p in parts]
            asked = Asked.of(mine)
            with tempfile.TemporaryDirectory() as folder:
                trie = Trie.build(folder, *asked.trained(), settings.discount, 1 << _CONTEXT_BITS)
                seen, kinds, codes = asked.answered(trie)
            v, w = 0, 0
            for out, (_, each, _, n) in zip(told, mine, strict=True):
                out += [narrow(seen[v : v + len(each)]), narrow(kinds[v : v + len(each)]), codes[w : w + len(n)]]
                v, w = v + len(each), w + len(n)
        for (block, _), out in zip(rows, told, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([shard], pa.int32()), pa.array([pack(out)]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.array([shard], pa.int32()), pa.nulls(1, pa.binary()), pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=names)

    names = ["block", "shard", "told", "tokens", "kinds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if s != shard and held:
                    yield from settle(held, shard)
                    held = []
                shard = s
                held.append((block, data.as_py()))
        if held:
            yield from settle(held, shard)

    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "block long, shard int, told binary, tokens long, kinds long")


def payloads(docs: DataFrame, settings: Settings) -> DataFrame:
    """(block, shard, doc_ids, content): the tokens of each block, to meet the answers. They come before these, so their shard is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(blocks(batches, settings)):
            content = pack([block.words, block.tokens.astype(np.uint32), block.edges.astype(np.int64), block.train.astype(np.uint8)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([_block_id(k)]), pa.array([-1], pa.int32()), pa.array([block.doc_ids], pa.list_(pa.int64())), pa.array([content], pa.binary())],
                names=["block", "shard", "doc_ids", "content"])

    return docs.mapInArrow(run, "block long, shard int, doc_ids array<long>, content binary")


def score_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Training documents are those whose id's remainder is not 0. ``base_score`` is exact. ``score`` sums log10 of
    p(w | v) = a(v, w) + discount * kinds(v) / seen(v) * p(w | v'), where v is the ``order`` - 1 tokens before w (fewer at a document's start), v' is v
    without its first, and a is the quantised discounted share of w after v; after no token at all p(w) is the smoothed
    share of w that ``base_score`` uses; after a context v that training has not, p(w | v'). Null and empty texts are the end token alone.
    ``docs`` is read more than once and must have the same partitions each time, as the scan of a table has; a block whose question
    and answers don't fit together stops the job.
    """
    shards = _shards(docs) * (2 * settings.order - 3)  # longer n-grams repeat less, so a shard would hold more of them; a task settles its shards in turn
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), settings.folds) != 0).alias("train"), F.coalesce("text", F.lit("")).alias("text"))
    spread = context_spread(rows, shards, settings.order)
    again = "the documents had other partitions when they were read again; store() them first"
    told = store(answers(questions(rows, shards, spread, settings), shards, settings), "lm-answers")
    total, kinds = told.filter("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    bottom = total + settings.additive * (kinds + 1)

    def scored(ids: list, content: bytes, sent: list[bytes]) -> pa.RecordBatch:
        words, tokens, edges, train = unpack(content)
        block = Block(ids, train, words, tokens.astype(np.int32), edges)
        q = ask(block, shards, spread)
        parts = [unpack(data) for data in sent]
        if len({len(p) for p in parts}) > 1 or sum(len(p[0]) for p in parts) != len(words):
            raise ValueError(again)
        known = np.zeros(len(words), np.int64)
        known[q.word_order] = np.concatenate([p[0] for p in parts])
        single = (known + settings.additive) / bottom
        p = single[block.tokens]
        for k, level in enumerate(q.levels):
            seen, kinds_of, codes = (np.concatenate([x[1 + 3 * k + i] for x in parts]) for i in range(3))
            if (len(seen), len(codes)) != (len(level.pair_contexts), len(level.gram_words)):
                raise ValueError(again)
            context_seen = np.bincount(level.pair_contexts, seen, len(level.hashes))
            context_kinds = np.bincount(level.pair_contexts, kinds_of, len(level.hashes))
            whole = np.maximum(context_seen, 1)
            rest = np.where(context_seen > 0, settings.discount * context_kinds / whole, 1.0)
            v = level.pair_contexts[level.gram_pairs]
            own = dequantise(codes) * seen[level.gram_pairs] / whole[v]
            rest = rest[v]
            there = np.flatnonzero(level.token_grams >= 0)
            at = level.token_grams[there]
            p[there] = own[at] + rest[at] * p[there]
        score = np.add.reduceat(np.log10(p), edges[:-1])
        base = np.add.reduceat(np.log10(single)[block.tokens], edges[:-1])
        n_known = np.add.reduceat((known > 0).astype(np.int64)[block.tokens], edges[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(train == 0), pa.array(np.diff(edges)), pa.array(n_known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # block, ids and content of a block, then its answers in order of the shards

        def settle() -> pa.RecordBatch:
            if len(held) != 3 + shards or held[1] is None:
                raise ValueError(again)
            return scored(held[1], held[2], held[3:])

        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if held and held[0] != block:
                    yield settle()
                    held.clear()
                held += [batch.column(3)[i].as_py()] if held else [block, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()]
        if held:
            yield settle()

    replies = told.filter("block is not null").select("block", "shard", F.lit(None).cast("array<long>").alias("doc_ids"), F.col("told").alias("content"))
    met = payloads(rows, settings).unionByName(replies).repartition(shards, "block").sortWithinPartitions("block", "shard")
    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
