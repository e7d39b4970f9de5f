"""Benchmark passages in training documents, found through a positional inverted index of the training tokens.

Only Spark expressions: words, postings, intersections and checks stay in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import store

#: Words, and what stands between them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Match:
    """Words in a window, and up to how many rows a lookup table is broadcast."""

    words: int = 10
    broadcast_rows: int = 500_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if it is counted to be small; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def item_windows(items: DataFrame, match: Match) -> tuple[DataFrame, DataFrame]:
    """(win, n, words): distinct windows of the items; and (win, item): which items have each. A shorter item is one window."""
    tokens = items.select("item_id", words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    n = F.least(F.size("w"), F.lit(match.words))
    each = tokens.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    each = each.select(F.col("item_id").cast("string").alias("item"), "n", F.slice("w", F.col("i"), F.col("n")).alias("words")).distinct()
    each = store(each.withColumn("win", F.xxhash64(F.array_join("words", " "), F.col("n"))), "decontaminate-windows")
    return each.select("win", "n", "words").distinct(), each.select("win", "item")


def search_words(text: Column) -> Column:
    """The words of a text in lower case throughout, which takes a third of the time of ``words_of``: for searching and counting.

    Words that are equal when A-Z are lower-cased are equal here too, and both forms have the same number of words.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(plain), " "))


def indexed(docs: DataFrame) -> DataFrame:
    """The stored index: ``docs`` as a struct ``doc``, a number ``row`` of each row, and ``terms``, the 32-bit hash of the word at each position.

    Every text is split here and nowhere else. A hash that two words share gives a candidate more, which the check of the words rejects.
    """
    words = F.transform(search_words(F.col("text")), lambda w: F.hash(w))
    own = F.struct(*[F.col(c) for c in docs.columns])
    return store(docs.select(own.alias("doc"), F.monotonically_increasing_id().alias("row"), words.alias("terms")), "decontaminate-index")


def postings(index: DataFrame, terms: DataFrame, match: Match) -> DataFrame:
    """(row, pos, terms, and the columns of the lookup ``terms``): where each looked-up term stands, from 0, beside its document's terms."""
    return index.select("row", "terms", F.posexplode("terms").alias("pos", "term")).join(bounded(terms, match.broadcast_rows), "term")


def lists_of(windows: DataFrame, index: DataFrame, match: Match) -> DataFrame:
    """(term, offset, win, n, o2, t2, o3, t3): of each window the rarest term by its count in the training tokens, and the next rarest two.

    A window with a term that no document has can't occur and is left out.
    """
    each = windows.select("win", "n", F.posexplode(F.transform("words", lambda w: F.hash(F.lower(w)))).alias("offset", "term"))
    terms = each.select("term").distinct()
    counts = store(
        index.select(F.explode("terms").alias("term")).join(bounded(terms, match.broadcast_rows), "term").groupBy("term").agg(F.count(F.lit(1)).alias("often")), "decontaminate-counts")
    order = Window.partitionBy("win").orderBy("often", "offset")
    ranked = each.join(bounded(counts, match.broadcast_rows), "term").withColumn("rank", F.row_number().over(order))
    nth = lambda col, k: F.max(F.when(F.col("rank") == k, F.col(col)))
    picked = ranked.groupBy("win", "n").agg(
        F.count(F.lit(1)).alias("known"), nth("term", 1).alias("term"), nth("offset", 1).alias("offset"),
        nth("offset", 2).alias("o2"), nth("term", 2).alias("t2"), nth("offset", 3).alias("o3"), nth("term", 3).alias("t3"))
    return picked.filter("known = n").drop("known")


def candidates(index: DataFrame, windows: DataFrame, match: Match, slop: int = 0) -> DataFrame:
    """(row, win, start), stored: windows that may occur in a document, and where.

    Postings of a window's rarest term, less the term's offset in the window, are its possible starts. They are intersected with the lists of the
    next rarest terms at once, at the places of the same document, so no list is shuffled; what is left is. With
    ``slop`` words may be displaced, so the rarest list alone gives the starts.
    """
    lists = store(lists_of(windows, index, match), "decontaminate-lists")
    starts = postings(index, lists, match).withColumn("start", F.col("pos") - F.col("offset"))
    if not slop:
        stands = lambda o, t: F.col(t).isNull() | F.coalesce(F.get("terms", F.col("start") + F.col(o)) == F.col(t), F.lit(False))
        starts = starts.filter((F.col("start") >= 0) & stands("o2", "t2") & stands("o3", "t3"))
    return store(starts.select("row", "win", "start"), "decontaminate-starts")


def checked(index: DataFrame, windows: DataFrame, found: DataFrame, test: str, match: Match) -> DataFrame:
    """(row, doc_id, win, start, n, words) of the candidates whose words pass ``test``, SQL over ``w``, ``start``, ``n`` and ``words``.

    A row's candidates are gathered beside its text, so it is split once; there are at most its words times the windows of a term.
    """
    named = found.join(bounded(windows.select("win", "n", "words"), match.broadcast_rows), "win")
    gathered = store(named.groupBy("row").agg(F.collect_list(F.struct("win", "start", "n", "words")).alias("found")), "decontaminate-found")
    rows = index.select("row", "doc.doc_id", "doc.text").join(gathered, "row").withColumn("w", words_of(F.col("text")))
    return rows.select("row", "doc_id", "w", F.explode("found").alias("c")).select("row", "doc_id", "w", "c.*").filter(test).drop("w")


_COVERED = """
aggregate(array_sort(transform(hits, h -> struct(h.start as s, h.start + h.n as e))), named_struct('n', 0L, 'to', 0),
  (a, x) -> named_struct('n', a.n + greatest(0, x.e - greatest(x.s, a.to)), 'to', greatest(a.to, x.e)), a -> a.n)"""


def with_hits(docs: DataFrame, items: DataFrame, match: Match = Match()) -> DataFrame:
    """``docs`` with a column ``__hits``: a struct of n_words, n_hit and items (sorted).

    Candidates from the index are checked word by word against the document. Null and empty texts have no words; no items, no hits. Every row
    is looked up by itself, whatever its doc_id. A column of ``docs`` named ``__hits`` is replaced; others keep name and value.
    """
    windows, named = item_windows(items, match)
    index = indexed(docs)
    hits = store(checked(index, windows, candidates(index, windows, match), "slice(w, start + 1, n) = words", match).select("row", "win", "start", "n"), "decontaminate-hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("hits")).select("row", F.expr(_COVERED).alias("n_hit"))
    # a window that many items share is named once a document before its items are
    told = hits.select("row", "win").distinct().join(named, "win").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = store(spans.join(told, "row", "left"), "decontaminate-told")
    keep = [c for c in docs.columns if c != "__hits"]
    no_items = F.array().cast("array<string>")
    value = F.struct(
        F.size("terms").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", no_items).alias("items"))
    return index.join(told, "row", "left").select(*[F.col("doc")[c].alias(c) for c in keep], value.alias("__hits"))


def contamination(docs: DataFrame, items: DataFrame, match: Match = Match()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of every document.

    ``n_hit`` counts the document's words inside any occurrence of a window.
    """
    out = with_hits(docs.select("doc_id", "text"), items, match).select("doc_id", "__hits.*")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "items")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 3, match: Match = Match()) -> DataFrame:
    """(doc_id, start, words, items): windows all of whose words stand in the document, each at most ``slop`` words from its place.

    Places count from where the window's rarest word stands; ``start`` may be below 0. Exact occurrences are among them.
    """
    windows, named = item_windows(items, match)
    index = indexed(docs.select("doc_id", "text"))
    near = (
        f"forall(sequence(0, n - 1), i -> array_contains(slice(w, greatest(1, start + i + 1 - {slop}), "
        f"greatest(0, start + i + 2 + {slop} - greatest(1, start + i + 1 - {slop}))), words[i]))")
    rows = checked(index, windows, candidates(index, windows, match, slop), near, match)
    rows = rows.join(named, "win").groupBy("row", "doc_id", "start", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select("doc_id", "start", "words", "items")
