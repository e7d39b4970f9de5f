"""Secrets in texts: patterns, and sliding-window entropy of unbroken character runs. Spark expressions only, no shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds: pattern, group whose length counts, least length. A match that is too short is dropped, but what it covers stays covered.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs have no beginning inside them, so the length may stand in the pattern
}
RUN = r"[A-Za-z0-9+/_-]{20,}"
_UNIT = 1_000_000
_BLOCK = 256


@dataclass(frozen=True)
class Entropy:
    """Window length, and bits per character from which a window counts as random, by the character class of its run.

    A run is left alone if it matches a pattern of ``allow``: letters alone, digits alone, paths, UUIDs, and words that mark examples.
    """

    window: int = 20
    hex_bits: float = 2.9
    base64_bits: float = 3.7
    allow: tuple[str, ...] = (
        r"^[A-Za-z_-]+$", r"^[0-9_-]+$", r"^(?:[A-Za-z_-]*/){2,}[A-Za-z_-]*$",
        r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"(?i)example|placeholder|changeme|dummy|sample")

    def most_repeats(self, bits: float) -> int:
        """The greatest sum of k*log2(k) over a window's characters at which its entropy still has ``bits``, in millionths."""
        return round(self.window * (math.log2(self.window) - bits) * _UNIT)


def prefix_sums(xs: Column) -> Column:
    """Running sums of an array of numbers, in blocks, so that long arrays aren't copied once per element."""
    long = lambda n: F.lit(n).cast("long")
    none = F.array().cast("array<bigint>")
    add = lambda total, seen, x: F.struct((total + x).alias("t"), F.concat(seen, F.array(total + x)).alias("s"))
    start = F.struct(long(0).alias("t"), none.alias("s"))
    inner = lambda part: F.aggregate(part, start, lambda a, x: add(a["t"], a["s"], x.cast("long")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: inner(F.slice(xs, b * _BLOCK + 1, _BLOCK)))
    each = F.aggregate(
        blocks, F.struct(long(0).alias("t"), F.array().cast("array<array<bigint>>").alias("s")),
        lambda a, b: F.struct((a["t"] + b["t"]).alias("t"), F.concat(a["s"], F.array(F.transform(b["s"], lambda x: x + a["t"]))).alias("s")))
    return F.when(F.size(xs) == 0, none).otherwise(F.flatten(each["s"]))


def matches(text: Column, pattern: str, group: int) -> Column:
    """Structs of start and stop (code points, stop exclusive), the length of ``group`` and the match itself."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    stops = prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, F.char_length), lambda g, m: g + m))
    return F.transform(
        F.arrays_zip(stops.alias("stop"), found.alias("match"), inner.alias("inner")),
        lambda x: F.struct((x["stop"] - F.char_length(x["match"])).alias("start"), x["stop"].alias("stop"), F.char_length(x["inner"]).alias("n"), x["match"].alias("match")))


_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _span(start: Column, stop: Column, rank: Column, kind: Column) -> Column:
    return F.struct(start.alias("start"), rank.cast("int").alias("rank"), stop.alias("stop"), kind.alias("kind"))


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one base kind."""
    pattern, group, least = BASE[kind]
    rank = list(BASE).index(kind)
    good = F.filter(matches(text, pattern, group), lambda m: m["n"] >= least)
    spans = F.transform(good, lambda m: _span(m["start"], m["stop"], F.lit(rank), F.lit(kind)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


def random_windows(chars: Column, most: Column, settings: Entropy) -> Column:
    """Structs of start and stop in a run, given as the array of its characters, covered by windows whose entropy is high enough; windows that touch are one.

    The counts of the window's characters are carried along: one that enters raises its count, one that leaves lowers it, and the sum of
    k*log2(k) changes by the steps between their counts. Steps are whole millionths of a bit, so sums are exact. The stretch that is still growing is
    kept apart from the finished ones, so the work is linear in the run.
    """
    w = settings.window
    level = [0] + [round(k * math.log2(k) * _UNIT) for k in range(1, w + 1)]
    step = F.array(*[F.lit(level[k + 1] - level[k]).cast("long") for k in range(w)])  # the k-th, from 1: from k-1 to k of a kind
    slot = lambda i: F.ascii(F.element_at(chars, i)) - (ord("+") - 1)

    def finished(state: Column) -> Column:
        span = F.struct(state["start"].alias("start"), state["stop"].alias("stop"))
        return F.when(state["stop"] > 0, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])

    def advance(state: Column, i: Column) -> Column:
        enters, leaves = slot(i), F.when(i > w, slot(F.greatest(F.lit(1), i - w))).otherwise(0)
        fall = F.when(i > w, F.element_at(step, F.element_at(state["counts"], F.greatest(F.lit(1), leaves)))).otherwise(0)
        others = F.element_at(state["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
        total = state["total"] - fall + F.element_at(step, others + 1)
        counts = F.transform(state["counts"], lambda n, k: n + F.when(k + 1 == enters, 1).otherwise(0) - F.when(k + 1 == leaves, 1).otherwise(0))
        start, stop = (i - w).cast("long"), i.cast("long")
        hot = (i >= w) & (total <= most)
        goes_on = state["stop"] >= F.greatest(start, F.lit(1))
        return F.struct(
            total.alias("total"), counts.alias("counts"), F.when(hot & ~goes_on, start).otherwise(state["start"]).alias("start"), F.when(hot, stop).otherwise(state["stop"]).alias("stop"),
            F.when(hot & ~goes_on, finished(state)).otherwise(state["spans"]).alias("spans"))

    zero = F.lit(0).cast("long")
    begin = F.struct(
        zero.alias("total"), F.array_repeat(F.lit(0), ord("z") - ord("+") + 1).alias("counts"), zero.alias("start"), zero.alias("stop"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), begin, advance, finished)


def entropy_spans(text: Column, settings: Entropy) -> Column:
    """Spans of random looking stretches in unbroken runs, kinds entropy_hex and entropy_base64 by the characters of the run."""
    allowed = lambda m: F.exists(F.array(*[F.lit(p) for p in settings.allow]), lambda p: F.regexp_like(m["match"], p))
    open_ = F.filter(matches(text, RUN, 0), lambda m: ~allowed(m))
    split = F.transform(open_, lambda m: F.struct(m["start"].alias("start"), m["match"].alias("match"), F.split(m["match"], "").alias("chars")))  # once a run

    def inside(m: Column) -> Column:
        is_hex = m["match"].rlike("^[0-9A-Fa-f]+$")
        most = F.when(is_hex, F.lit(settings.most_repeats(settings.hex_bits))).otherwise(F.lit(settings.most_repeats(settings.base64_bits)))
        kind, rank = F.when(is_hex, F.lit("entropy_hex")).otherwise(F.lit("entropy_base64")), F.when(is_hex, F.lit(3)).otherwise(F.lit(4))
        return F.transform(random_windows(m["chars"], most, settings), lambda s: _span(m["start"] + s["start"], m["start"] + s["stop"], rank, kind))

    return F.when(text.rlike(RUN), F.flatten(F.transform(split, inside))).otherwise(F.array().cast(_SPANS))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def find_secrets(docs: DataFrame, settings: Entropy = Entropy()) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of spans (start, rank, stop, kind), by start and then kind.

    ``base`` has the pattern spans, ``found`` those and the entropy spans. Starts and ends count code points, ends exclusive. Null texts have none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("*", *[base_spans(text, k).alias(f"__{k}") for k in BASE], entropy_spans(text, settings).alias("__entropy"))
    base = [f"__{k}" for k in BASE]
    return parts.withColumns({"base": F.array_sort(F.concat(*base)), "found": F.array_sort(F.concat(*base, "__entropy"))})


def secret_report(docs: DataFrame, settings: Entropy = Entropy()) -> DataFrame:
    """doc_id, counts per base kind, base_sha256 and all spans as text, for every document."""
    found = find_secrets(docs.select("doc_id", "text"), settings)
    return found.select(
        "doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", settings: Entropy = Entropy()) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans are one. Texts without spans stay as they are, nulls too."""
    found = find_secrets(docs.select(F.struct(*docs.columns).alias("__row"), "text"), settings)
    stretch = F.aggregate(
        "found", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["parts"], F.array(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))).otherwise(a["parts"]).alias("parts")),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring("text", a["at"] + 1, F.char_length("text"))))
    return found.select(*[(F.when(F.size("found") > 0, stretch).otherwise(F.col("text")) if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns])
