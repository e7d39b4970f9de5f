"""Vector search, spelling variants and Merkle manifests against plain Python, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import ann, merkle, spelling
from tidewire.llm import queries as registered
from tidewire.tables import Tables

NAN, INF = float("nan"), float("inf")


def key(row):
    return tuple((x is None, str(x)) for x in row)


# --- vector search ------------------------------------------------------------

def nearest(base, queries, k):
    """(query, rank, id, score) by comparing all; ``base`` and ``queries`` are lists of (id, vector)."""
    out = []
    for q, v in queries:
        scores = {}
        for i, x in base:
            if i != q:
                s = 0.0
                for a, b in zip(v, x, strict=True):
                    s += a * b
                scores[i] = max(s, scores.get(i, -INF))
        best = sorted(scores.items(), key=lambda t: (-t[1], t[0]))[:k]
        out += [(q, rank, i, s) for rank, (i, s) in enumerate(best, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "id": F.lit("x"), "leaf": F.lit(2), "score": F.lit(3)}).repartition(3)


def test_all_leaves_give_the_exact_neighbours(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 5) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]  # ties, more than a piece holds
    everything = ann.Settings(neighbours=5, recall=1.0, branching=4, leaf=16, piece=24, probes=1000)
    df = table(spark, rows)
    got = sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 3 = 0"), everything).collect())
    assert got == nearest(rows, [r for r in rows if r[0] % 3 == 0], 5)


def test_vectors_that_take_no_part(spark):
    good = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [-1.0, 3.0]), (20, [-1.0, 3.0]), (40, [1e150, 1.0])]
    bad = [(None, [1.0, 1.0]), (3, None), (60, [0.0, 0.0]), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (80, [1.0, 1.0, 1.0]), (7, [])]
    df = table(spark, good + bad)
    got = sorted(tuple(r) for r in ann.nearest(df, df.filter("vec_id % 20 = 0")).collect())
    unique = list(dict((i, v) for i, v in good).items())
    assert got == nearest(unique, [(i, v) for i, v in unique if i % 20 == 0], 20)
    none = df.filter("vec_id < 0")
    assert ann.nearest(none, none).count() == 0 and ann.nearest(df, none).count() == 0
    lone = df.filter("vec_id = 0")
    assert ann.nearest(lone, lone).count() == 0


def test_recall_of_a_partial_search(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16)).tolist()) for i in range(6000)]
    df = table(spark, rows).cache()
    queries = df.filter("vec_id % 20 = 0")
    settings = ann.Settings(leaf=64, sample=2000, piece=500)
    found = ann.nearest(df, queries, settings)
    assert ann.recall(found, df, queries, settings) >= 0.9
    assert found.groupBy("query_id").count().filter("count <> 20").count() == 0 and found.count() == 6000
    sample = np.array([v for _, v in rows[:2000]])
    scale = 1 / np.abs(sample).max()
    tree = ann.fit_tree(sample, 6000, settings, scale, float(((sample * scale) ** 2).sum(axis=1).max()))
    visited = ann.calibrated(ann.usable(df), ann.usable(queries), tree, settings)
    assert tree.leaves >= 32 and visited < tree.leaves / 2  # most of the tree is left alone


def test_registered_search_has_its_recall(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in Tables(spark, path).embeddings.select("vec_id", "embedding").collect()]
    want = nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = [tuple(r) for r in registered.op11_nearest_neighbours(spark, path).collect()]
    exact = {(q, i): s for q, _, i, s in want}
    assert len(got) == len(want) and len({(q, i) for q, _, i, _ in got} & set(exact)) >= 0.9 * len(want)
    assert all(s == exact.get((q, i), s) for q, _, i, s in got)


# --- spelling -----------------------------------------------------------------

def variants(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    slots, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            slots[k, w[:k], w[k + 1 :]].add(w)
            if (d := w[:k] + w[k + 1 :]) in words:
                near[w].add(d)
                near[d].add(w)
    for group in slots.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        if others and words[b := min(others, key=lambda x: (-words[x], x))] >= 2 * words[w]:
            form[w] = b
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


WORDS = ["banana", "bananas", "banane", "Banana", "BANANA", "ananab", "straße", "strasse", "ÉCOLE", "école", "école", "naïve", "naive", "aaaaa", "aaaaaa", "aaaab", "×÷×÷×"]


def test_variants_against_plain_python(spark, data):
    rng = random.Random(4)
    texts = [(i if i % 7 else None, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60)))) for i in range(80)]
    dna = [(1000 + i, " ".join("".join(rng.choice("acgt") for _ in range(rng.choice((5, 6, 40)))) for _ in range(200))) for i in range(30)]
    dna += [(2000 + i, t) for i, (_, t) in enumerate(dna[:12])] + [(3000 + i, t) for i, (_, t) in enumerate(dna[:12])]
    odd = [(1, None), (2, ""), (3, "x" * 50_000), (3, "x" * 50_000), (4, "x" * 50_000), (5, ("words " * 300_000)), (None, None), (6, "1234 -- \n"), (7, "🙂école🙂" * 5)]
    plain = [tuple(r) for r in Tables(spark, data).documents.select("doc_id", "text").collect()]
    for rows in (texts + odd, dna, plain):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "cell": F.lit(2)}).repartition(3)
        for rule in (spelling.Rule(), spelling.Rule(cell=30, sample=500)):
            assert sorted(tuple(r) for r in spelling.variants(df, rule).collect()) == variants(rows)
    assert spelling.variants(df.filter("doc_id = -1")).count() == 0


def test_cells_hold_all_vectors_within_reach():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    counts = spelling.letter_counts(words)
    tree = []
    spelling.grow(counts, 12, tree, [0])
    home = dict(zip(*spelling.cells_within(tree, counts, 0, 0), strict=True))
    assert len(home) == len(words) and len(set(home.values())) > 6
    reach = collections.defaultdict(set)
    for w, c in zip(*spelling.cells_within(tree, counts, 1, 1), strict=True):
        reach[w].add(c)
    for a in range(len(words)):
        for b in range(len(words)):
            if (counts[b] - counts[a]).clip(0).sum() <= 1 and (counts[a] - counts[b]).clip(0).sum() <= 1:
                assert home[b] in reach[a]
    assert sum(map(len, reach.values())) < 0.8 * len(words) * len(set(home.values()))


def test_chains_of_forms_end_at_their_root(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "b")], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots_of(links).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)} | {"a": "b"}
    assert spelling.roots_of(links.filter("word = 'none'")).count() == 0


# --- manifest -----------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(hashes):
    """Root, and for each leaf the siblings (left, right) of each level."""
    paths, members = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, held = [], []
        for at in range(0, len(hashes), 3):
            run = hashes[at : at + 3]
            for k in range(len(run)):
                for m in members[at + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha(*run))
            held.append(sum(members[at : at + 3], []))
        hashes, members = up, held
    return hashes[0], paths


def manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    if not rows:
        return []
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r, sha(*map(told, r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = tree_of([h for _, h in groups[name]])
    root, upper = tree_of([trees[name][0] for name in names])
    out = []
    for name, high in zip(names, upper, strict=True):
        for (r, leaf), low in zip(groups[name], trees[name][1], strict=True):
            text = r[4]
            if text is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            at = sha(*map(told, (*r[:4], text)))
            for left, right in low + high:
                at = sha(left, at, right)
            out.append((r[0], leaf, trees[name][0], root, sha(*(a + b for a, b in low + high)), at, at == root))
    return sorted(out, key=key)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [
    (1, None, None, None, None), (2, None, "en", 0, ""), (None, "", "en", 3, "a\nb"), (None, "", "en", 3, "a\nb"), (None, None, None, None, None), (3, "é", "ß", 2, "漢\n字"), (4, "z", "-", -1, "-"),
    (5, "z", "en", 1, "1:x"), (6, "Z", "en", 1, "\n" * 5), (7, "long", "en", 1, "line\n" * 400_000), (8, "z", "en", 1, "\r\n \n"), (-9, "z", "en", 1, "minus")]


@pytest.mark.parametrize("shape", [merkle.Shape(), merkle.Shape(levels=1), merkle.Shape(levels=2)])
def test_manifest_against_plain_python(spark, data, shape):
    docs = [tuple(r) for r in Tables(spark, data).documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    hot = [(i, "hot" if i % 3 else f"s{i}", "en", i, f"text {i}\n") for i in range(150)]
    for rows in (docs, hot, ODD, ODD[:1]):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("l"), "root": F.lit(1), "path": F.lit(2), "__idx": F.lit(3), "verified": F.lit("v")}).repartition(4)
        assert sorted((tuple(r) for r in merkle.document_manifest(df, shape).collect()), key=key) == manifest(rows)
    assert merkle.document_manifest(df.filter("doc_id = -1"), shape).count() == 0


def test_manifest_of_other_tables_keeps_their_columns(spark):
    rows = spark.createDataFrame([(i, i % 2, f"v{i}", "mine") for i in range(20)], "id int, side int, value string, kept string")
    out = merkle.manifest(rows.withColumn("leaf", merkle.digest(F.col("value"))), "side", ["id"], merkle.Shape(fan=2, levels=2))
    assert out.columns == ["id", "side", "value", "kept", "leaf", "path", "subroot", "root"]
    assert out.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 20
    assert out.filter(merkle.folded(merkle.digest(F.lit("other")), F.col("path")) == F.col("root")).count() == 0
