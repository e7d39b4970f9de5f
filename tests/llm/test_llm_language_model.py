"""The language model's parts against plain Python, and the memory of a block."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import eliasfano, lm


def a_block(tokens):
    draws = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draws.zipf(1.3, 1000) % 50_000) for _ in range(tokens // 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array(texts)], names=["doc_id", "train", "text"])
    return next(lm.blocks(iter([batch]), lm.Settings(order=3, block=tokens)))


def test_a_question_takes_few_bytes_a_token():
    """Two tasks of an executor share its memory; at 64-bit numbers all over, blocks of 1.5 million tokens took more than it has."""
    block = a_block(200_000)
    spread = np.ones((2, 1 << 16), np.int64)
    spread[0, ::7] = 3
    tracemalloc.start()
    q = lm.ask(block, 16, spread)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * len(block.tokens)  # 74; 133 with 64-bit numbers
    for level in q.levels:
        there = level.token_grams >= 0
        assert there.sum() == len(block.tokens) - (0 if level is q.levels[0] else len(block.doc_ids))
        assert (np.unique(level.token_grams[there]) == np.arange(len(level.gram_words))).all()
        pairs = level.pair_shards.astype(np.int64) * len(level.hashes) + level.pair_contexts
        assert (np.diff(pairs) > 0).all() and (np.diff(level.gram_pairs) >= 0).all()


@pytest.mark.parametrize("values, universe", [([], 9), ([0], 1), ([8], 9), ([0, 0, 3, 3, 7], 8), (list(range(0, 4000, 3)), 4000), ([1, 5, 1 << 39, (1 << 40) - 1], 1 << 40)])
def test_sequences_are_read_and_searched(tmp_path, values, universe):
    eliasfano.EliasFano.of(np.array(values, np.uint64), universe).save(str(tmp_path), "x")
    x = eliasfano.EliasFano.open(str(tmp_path), "x")
    assert x.get(np.arange(len(values))).tolist() == values
    wanted = sorted({v + d for v in [0, *values] for d in (-1, 0, 1) if 0 <= v + d < universe})
    assert x.find(np.array(wanted)).tolist() == [values.index(v) if v in values else -1 for v in wanted]


def test_ngrams_that_differ_in_the_last_bits_alone_are_summed_apart():
    draws = np.random.default_rng(1)
    v = np.sort(draws.integers(0, 3, 300)).astype(np.uint64) << np.uint64(37)
    contexts, each = np.unique(v, return_counts=True)
    parts, brute = [], {}
    for _ in range(3):
        w, n = draws.integers(0, 600, 300).astype(np.uint64), draws.integers(0, 3, 300)
        parts.append([lm.key_bytes(contexts << np.uint64(24), 40), each, lm.key_bytes(w << np.uint64(32), 32), n])
        for key in zip(v.tolist(), w.tolist(), n.tolist(), strict=True):
            brute[key[:2]] = brute.get(key[:2], 0) + key[2]
    context, word, count = lm._summed(parts)
    assert [((a, b), n) for a, b, n in zip(context.tolist(), word.tolist(), count.tolist(), strict=True)] == sorted((k, n) for k, n in brute.items() if n)


class Rows:
    """Stands for a data frame: keeps the function that its tasks run."""

    def repartition(self, *_):
        return self

    def sortWithinPartitions(self, *_):  # noqa: N802
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_a_shard_searches_its_trie_once_for_all_blocks(monkeypatch):
    """Before, each block's n-grams were searched apart, so common ones as often as there are blocks."""
    block, settings = a_block(20_000), lm.Settings(order=3)
    monkeypatch.setattr(lm, "blocks", lambda *_: iter([block]))
    monkeypatch.setattr(lm, "_block_id", lambda k: k)
    (asked,) = lm.questions(Rows(), 1, np.ones((2, 1 << 16), np.int64), settings)([])
    sought, find = [], eliasfano.EliasFano.find
    monkeypatch.setattr(eliasfano.EliasFano, "find", lambda x, targets, *bounds: (sought.append(len(targets)), find(x, targets, *bounds))[1])

    def told(copies):
        sought.clear()
        rows = [pa.RecordBatch.from_arrays([asked.column(0), pa.array([k]), asked.column(2)], names=asked.schema.names) for k in range(copies)]
        out = pa.Table.from_batches(lm.answers(Rows(), 1, settings)(iter(rows))).to_pylist()
        return sum(sought), [lm.unpack(r["told"]) for r in out[:-1]], (out[-1]["tokens"], out[-1]["kinds"])

    (one, first, sums), (five, each, five_sums) = told(1), told(5)
    assert five == one > 20_000 and len(each) == 5 and five_sums == (5 * sums[0], sums[1])
    for words, *levels in each:
        assert (words == 5 * first[0][0].astype(int)).all()
        assert all((levels[k].astype(int) == (1 if k % 3 else 5) * first[0][1 + k].astype(int)).all() for k in (0, 1, 3, 4))


@pytest.mark.parametrize("bound", [1 << 20, 1 << 50, 1 << 63])
def test_values_are_numbered_in_ascending_order(bound):
    for n in (0, 1, 2, 3000):
        for values in (np.random.default_rng(n).integers(0, bound, n).astype(np.uint64) // np.uint64(7) * np.uint64(7), np.arange(n) // 3):
            found, number = eliasfano.numbered(values, bound)
            assert (found == np.unique(values)).all() and found.dtype == values.dtype and (found[number] == values).all()


def test_a_block_whose_answers_are_gone_stops_the_job(spark, monkeypatch):
    """Before, the documents of such a block were left out of the result."""
    whole = lm.store
    monkeypatch.setattr(lm, "store", lambda df, name: whole(df, name).filter("block is null"))
    df = spark.createDataFrame([(i, f"a b c{i}") for i in range(20)], "doc_id long, text string")
    with pytest.raises(Exception, match="other partitions"):
        lm.score_documents(df).collect()
