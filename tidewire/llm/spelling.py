"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One replaced letter moves a word's vector of letter counts down by one in one letter and up by one in another; one inserted letter moves it up by one.
Words of one length lie in the cells of a k-d tree. A word searches the trees of its own and of the next greater length: it goes to each
cell within that distance, where a tree of boxes is pruned in the same way, and the letters in their order decide.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
DIMS = 96  # a-z, the 64 of Latin-1, and 6 that all others share
POINT, SAME, SHORTER = range(3)


@dataclass(frozen=True)
class Rule:
    """Which words count, and the bounds of the search.

    ``least_chars`` and ``least_count`` of a word; of each ``noise`` occurrences (by crc32) one loses a letter; a form is ``ratio`` times as frequent. ``cell`` is
    the wanted number of words in a cell. The trees' thresholds are chosen on about ``sample`` words, which bounds what the driver holds; a cell
    that has become too large is cut by a hash of its words and searched piece by piece.
    """

    least_chars: int = 5
    least_count: int = 3
    noise: int = 97
    ratio: int = 2
    cell: int = 32_768
    sample: int = 65_536


# --- words ------------------------------------------------------------------

def pieces(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that end between runs."""
    at = 0
    while len(text) - at > limit:
        gap = GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def word_counts(docs: DataFrame, rule: Rule) -> DataFrame:
    """(word, n): the distinct words of all texts with their occurrences, counted in the tasks before they are shuffled."""
    spark_schema = "word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text, doc = text.as_py(), doc.as_py()
                if not text:
                    continue
                base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for piece in pieces(text):
                    for word, n in Counter(RUN.findall(piece.encode().lower().decode())).items():  # bytes lower only A-Z
                        if len(word) < rule.least_chars:
                            continue
                        h = zlib.crc32(word.encode(), base)
                        if h % rule.noise == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < rule.least_chars:
                                continue
                        seen[word] += n
                    if len(seen) > 400_000:
                        yield flush()
        yield flush()

    counts = docs.select("doc_id", "text").mapInArrow(run, spark_schema).groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= rule.least_count)


# --- vectors and trees ------------------------------------------------------

def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), lengths


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word."""
    codes, lengths = codes_of(words)
    dim = np.where((codes >= 97) & (codes < 123), codes - 97, np.where((codes >= 0xC0) & (codes < 0x100), codes - 0xC0 + 26, 90 + codes % 6)).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(owner * DIMS + dim, minlength=len(words) * DIMS).reshape(len(words), DIMS)


def best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and the count at or below which nearest to half of the rows are; None if all rows are equal."""
    found, best = None, 0.02
    for dim in np.flatnonzero(counts.min(axis=0) < counts.max(axis=0)):
        column = np.sort(counts[:, dim])
        for at in {int(column[len(column) // 2]), int(column[len(column) // 2]) - 1, int(column[0])}:
            share = np.searchsorted(column, at, side="right") / len(column)
            even = min(share, 1 - share)
            if even > best:
                found, best = (int(dim), at), even
    return found


def grow(counts: np.ndarray, cells: float, tree: list, number: list[int]) -> int:
    """Add a subtree over ``counts`` with about ``cells`` leaves to ``tree``; returns its node. A leaf is ('cell', number)."""
    cut = best_cut(counts) if cells > 1.5 and len(counts) >= 16 else None
    me = len(tree)
    if cut is None:
        tree.append(("cell", number[0]))
        number[0] += 1
        return me
    tree.append(None)
    low = counts[:, cut[0]] <= cut[1]
    share = low.mean()
    tree[me] = (*cut, grow(counts[low], cells * share, tree, number), grow(counts[~low], cells * (1 - share), tree, number))
    return me


def cells_within(tree: list | None, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): the cells that hold vectors which lie above a row by ``up`` at most and below it by ``down`` at most, in all letters together."""
    rows = np.arange(len(counts))
    if tree is None:
        return rows, np.zeros(len(rows), np.int64)
    found_rows, found_cells = [], []
    stack = [(0, rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), {}, {})]
    while stack:
        node, mine, ups, downs, least, most = stack.pop()
        if not len(mine):
            continue
        if tree[node][0] == "cell":
            found_rows.append(mine)
            found_cells.append(np.full(len(mine), tree[node][1]))
            continue
        dim, at, low, high = tree[node]
        value = counts[mine, dim]
        over = lambda bound: np.maximum(0, value - bound) if bound is not None else 0  # noqa: E731, B023
        under = lambda bound: np.maximum(0, bound - value) if bound is not None else 0  # noqa: E731, B023
        d = downs + over(at) - over(most.get(dim))
        u = ups + under(at + 1) - under(least.get(dim))
        left, right = d <= down, u <= up
        stack.append((low, mine[left], ups[left], d[left], least, {**most, dim: at}))
        stack.append((high, mine[right], u[right], downs[right], {**least, dim: at + 1}, most))
    return (np.concatenate(found_rows), np.concatenate(found_cells)) if found_rows else (rows[:0], rows[:0])


class Boxes:
    """Words of one length in a k-d tree whose nodes know the box of their words.

    Counts are kept as bits 'this letter at least so often', so a box is an AND and an OR of its words' bits, and what lies above or below it is counted
    by bits. Letters with many counts have some thresholds only, so distances may come out too small, never too great.
    """

    def __init__(self, words: list[str], leaf: int = 24, thresholds: int = 6):
        order = sorted(range(len(words)), key=words.__getitem__)
        self.words = [words[i] for i in order]  # ascending, so that indexes compare as words do
        self.order = np.array(order)
        counts = letter_counts(self.words)
        self.cuts = []
        for dim in range(DIMS):
            values = np.unique(counts[:, dim])
            steps = np.unique(np.r_[1, values + 1])
            steps = steps[steps > 0]
            if len(steps) > thresholds:
                steps = np.unique(np.quantile(steps, np.linspace(0, 1, thresholds), method="nearest"))
            self.cuts += [(dim, int(s)) for s in steps]
        bits = self._bits(counts)
        even = -np.abs(bits.mean(axis=0) - 0.5)
        rank = np.argsort(-even, kind="stable")  # the most telling bits first
        self.cuts = [self.cuts[i] for i in rank]
        bits = bits[:, rank]
        self.bits = self._pack(bits)
        self.nodes: list[tuple] = []
        self._build(np.arange(len(words)), bits, leaf)
        self.letters = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    def _bits(self, counts: np.ndarray) -> np.ndarray:
        dims, steps = np.array([d for d, _ in self.cuts]), np.array([s for _, s in self.cuts])
        return counts[:, dims] >= steps

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1).view(np.uint64)

    def _build(self, rows: np.ndarray, bits: np.ndarray, leaf: int) -> int:
        """Nodes are (AND, OR, members or None, children)."""
        me = len(self.nodes)
        self.nodes.append(())
        packed = self.bits[rows]
        box = np.bitwise_and.reduce(packed, axis=0), np.bitwise_or.reduce(packed, axis=0)
        children = []
        if len(rows) > leaf:
            share = bits[rows].mean(axis=0)
            cut = int(np.argmin(np.abs(share - 0.5)))
            if 0 < share[cut] < 1:
                has = bits[rows, cut]
                children = [self._build(rows[~has], bits, leaf), self._build(rows[has], bits, leaf)]
        self.nodes[me] = (*box, None if children else rows, children)
        return me

    def pairs(self, words: list[str], down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) that may be within one up and ``down`` down, in parts of bounded size."""
        asked = self._pack(self._bits(letter_counts(words)))
        count = np.bitwise_count
        stack = [(0, np.arange(len(words)))]
        while stack:
            node, mine = stack.pop()
            every, some, members, children = self.nodes[node]
            q = asked[mine]
            up = count(every & ~q).sum(axis=1, dtype=np.int32)
            fall = count(q & ~some).sum(axis=1, dtype=np.int32)
            mine = mine[(up <= 1) & (fall <= down)]
            if not len(mine):
                continue
            if members is None:
                stack += [(child, mine) for child in children]
                continue
            theirs = self.bits[members]
            step = max(1, (1 << 20) // len(members))
            for first in range(0, len(mine), step):
                part = mine[first : first + step]
                apart = count(asked[part, 0][:, None] ^ theirs[:, 0][None])
                a, b = np.nonzero(apart <= 1 + down)
                x, y = asked[part[a]], theirs[b]
                ok = (count(y & ~x).sum(axis=1, dtype=np.int32) <= 1) & (count(x & ~y).sum(axis=1, dtype=np.int32) <= down)
                if ok.any():
                    yield part[a[ok]], members[b[ok]]

    def near(self, words: list[str], shorter: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) with exactly one replaced letter, or with one letter more than the shorter query."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if words:
            asked = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
            wide = max(1, (1 << 22) // max(1, asked.shape[1]))
            for query, member in self.pairs(words, 0 if shorter else 1):
                for first in range(0, len(query), wide):
                    q, m = query[first : first + wide], member[first : first + wide]
                    x, y = asked[q], self.letters[m]
                    if shorter:
                        lead = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
                        trail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                        ok = lead + trail >= x.shape[1]
                    else:
                        ok = (x != y).sum(axis=1) == 1
                    found.append((q[ok], m[ok]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


# --- search -----------------------------------------------------------------

def trees_of(words: DataFrame, rule: Rule) -> dict[int, list]:
    """A tree per length that has more words than fit a cell. Driver: a row per such length, and about ``sample`` words."""
    sizes = words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > rule.cell).collect()
    if not sizes:
        return {}
    total = sum(r["k"] for r in sizes)
    share = min(1 << 20, int(rule.sample / total * (1 << 20)))
    picked = words.filter(F.char_length("word").isin([r["length"] for r in sizes]) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)).select("word").collect()
    held: dict[int, list[str]] = {}
    for r in picked:
        held.setdefault(len(r["word"]), []).append(r["word"])
    trees = {}
    for r in sizes:
        tree: list = []
        if r["length"] in held:
            grow(letter_counts(held[r["length"]]), r["k"] / rule.cell, tree, [0])
            trees[r["length"]] = tree
    return trees


def routed(words: DataFrame, trees: dict[int, list], points_only: bool = False) -> DataFrame:
    """(length, cell, role, word, n): each word as a point of its own cell, and as a question to every cell that may have a near word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, all_words), np.int64, len(all_words))
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                mine = [all_words[i] for i in rows]
                counts = letter_counts(mine)
                for role, target, up, down in ((POINT, length, 0, 0), (SAME, length, 1, 1), (SHORTER, length + 1, 1, 0)):
                    if points_only and role != POINT:
                        continue
                    who, cell = cells_within(trees.get(int(target)), counts, up, down)
                    same = np.full(len(who), int(target))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(same, pa.int64()), pa.array(cell, pa.int64()), pa.array(np.full(len(who), role), pa.int32()),
                         pa.array([mine[i] for i in who], pa.string()), pa.array(n[rows[who]], pa.int64())],
                        names=["length", "cell", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "length long, cell long, role int, word string, n long")


def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, top, form) of each piece of a cell: per word with near words their number, the greatest count and the word that has it.

    A piece's points come first and are held; questions stream past them.
    """
    key, points, boxes = None, ([], []), None
    near = top = None
    best: list = []

    def finished() -> Iterator[pa.RecordBatch]:
        if boxes is not None:
            hit = np.flatnonzero(near)
            yield _answer([boxes.words[i] for i in hit], near[hit], top[hit], [best[i] for i in hit])

    for batch in batches:
        place = list(zip(*(batch.column(i).to_numpy() for i in range(3)), strict=True))
        roles, words, n = batch.column(3).to_numpy(), batch.column(4).to_pylist(), batch.column(5).to_numpy()
        edge = 0
        while edge < len(words):
            first = edge
            while edge < len(words) and place[edge] == place[first] and roles[edge] == roles[first]:
                edge += 1
            if place[first] != key:
                yield from finished()
                key, points, boxes = place[first], ([], []), None
            if roles[first] == POINT:
                points[0].extend(words[first:edge])
                points[1].extend(n[first:edge].tolist())
                continue
            if boxes is None and points[0]:
                boxes = Boxes(points[0])
                held = np.array(points[1], np.int64)[boxes.order]
                near, top, best = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), [""] * len(held)
            if boxes is None:  # a cell without words
                continue
            asked, often = words[first:edge], n[first:edge]
            query, member = boxes.near(asked, roles[first] == SHORTER)
            if not len(query):
                continue
            # the greatest count first, then the least word
            order = np.lexsort([member, -held[member], query])
            who, at, many = np.unique(query[order], return_index=True, return_counts=True)
            chosen = member[order][at]
            yield _answer([asked[i] for i in who], many, held[chosen], [boxes.words[i] for i in chosen])
            if roles[first] == SHORTER:
                rank = np.empty(len(asked), np.int64)
                rank[sorted(range(len(asked)), key=lambda i: (-often[i], asked[i]))] = np.arange(len(asked))  # noqa: B023
                order = np.lexsort([rank[query], member])
                who, at, many = np.unique(member[order], return_index=True, return_counts=True)
                near[who] += many
                for p, q in zip(who, query[order][at], strict=True):
                    if (-often[q], asked[q]) < (-top[p], best[p]) or not best[p]:
                        top[p], best[p] = often[q], asked[q]
    yield from finished()


def _answer(words: list[str], near: np.ndarray, top: np.ndarray, form: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array(near, pa.int64()), pa.array(top, pa.int64()), pa.array(form, pa.string())], names=["word", "near", "top", "form"])


def near_words(words: DataFrame, rule: Rule) -> DataFrame:
    """(word, near, top, form): how many near words each word has, the greatest count among them, and the first word that has it; words without any are left out."""
    trees = trees_of(words, rule)
    sizes = routed(words, trees, points_only=True).groupBy("length", "cell").agg(F.count(F.lit(1)).alias("k"))
    # pieces hold twice a cell's words at most, and few if these are very long; one row per cell that needs more than one
    fits = F.greatest(F.lit(1), F.least(F.lit(2 * rule.cell), F.floor(F.lit(1 << 26) / (4 * F.col("length")))))
    blocks = sizes.select("length", "cell", F.ceil(F.col("k") / fits).cast("long").alias("blocks")).filter("blocks > 1")
    rows = routed(words, trees).join(blocks, ["length", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), "blocks"))
    pieces_ = F.explode(F.when(F.col("role") == POINT, own).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("block")
    n = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // rule.cell))
    placed = rows.select("length", "cell", pieces_, "role", "word", "n").repartition(n, "length", "cell", "block").sortWithinPartitions("length", "cell", "block", "role")
    answers = placed.mapInArrow(searched, "word string, near long, top long, form string")
    best = F.min(F.struct((-F.col("top")).alias("t"), F.col("form"))).alias("b")
    return answers.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("b.t")).alias("top"), F.col("b.form").alias("form"))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of the links (word, form): where following them ends. Each round doubles the steps taken; counts grow along a link, so there are no rings."""
    roots = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = store(roots.join(ahead, "root", "left"), "spelling-roots")
        if not longer.filter("next is not null").limit(1).count():
            return roots
        roots = longer.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts.

    Null and empty texts have no words; a null doc_id counts as empty text for the noise; repeated rows count again. A word's form is its most frequent
    near word (the first in code-point order among equals) if that is ``ratio`` times as frequent, else null; its root is where forms end.
    """
    words = store(word_counts(docs, rule), "spelling-words")
    found = words.join(near_words(words, rule), "word", "left")
    good = F.col("top") >= rule.ratio * F.col("n")
    found = store(found.select(
        "word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("top")).alias("form_n")), "spelling-forms")
    roots = roots_of(found.filter("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
