"""The pipeline's stages against plain Python on a small table with planted cases."""

import random

import pytest
from brute import hit_words, jaccard, near_duplicates, secrets, shingles

import corpus_pipeline
from tidewire.tables import Tables


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = Tables(spark, data).documents
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(spark.createDataFrame(stage(spark, out[-1], data).collect(), docs.schema))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages)


def test_each_stage_takes_effect(stages, spark, data):
    docs, clean, single, fair, mended = map(rows, stages)
    bad = ("idiot", "scum", "pathetic")
    assert sum(any(w in t.lower() for w in bad) for t in clean.values()) <= 0.1 * sum(any(w in t.lower() for w in bad) for t in docs.values()) + 1
    want = {i for i, _, root in near_duplicates(list(clean.items()), percent=80) if i == root}
    assert set(single) == want
    items = [tuple(r) for r in Tables(spark, data).benchmark.select("item_id", "text").collect()]
    assert set(fair) == {i for i, t in single.items() if not hit_words(t, items)[1]}
    assert set(mended) == set(fair)
    assert all(("[SECRET]" in mended[i]) if secrets(t)[-1] else mended[i] == t for i, t in fair.items())


def test_near_copies_from_80_percent_on_are_dropped(spark, data):
    rng = random.Random(80)
    planted, kinds = [], []
    for i in range(160):
        n = rng.randrange(60, 140)
        old = [f"p{i}w{k}" for k in range(n)]
        new = list(old)
        for k in range(rng.randrange(1, 4)):
            new[8 + k * (n - 16) // 3] = f"p{i}new{k}"
        pair = (2 * i, " ".join(old)), (2 * i + 1, " ".join(new))
        planted += pair
        kinds.append(jaccard(*(shingles(t) for _, t in pair)))
    assert sum(0.8 <= j < 0.85 for j in kinds) >= 20 and sum(0.75 < j < 0.8 for j in kinds) >= 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert set(rows(corpus_pipeline.drop_near_duplicates(spark, docs, data))) == {i for i, _, root in near_duplicates(planted, percent=80) if i == root}


def test_whole_run(spark, data, stages):
    out = corpus_pipeline.run(spark, data).select("doc_id", "length", "doc_tokens").collect()
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == set(rows(stages[-1])) and all(total[r["doc_id"]] == r["doc_tokens"] for r in out)


def test_odd_rows_pass(spark, data):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some clean words", "en", "s", 16), (3, "some clean words", "en", "s", 16), (None, "no id", None, None, 5), (None, "no id", None, None, 5)]
    docs = spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == [("1", None), ("2", ""), ("3", "some clean words"), ("None", "no id"), ("None", "no id")]
    empty = docs.filter("doc_id = -1")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0
