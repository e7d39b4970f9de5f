"""Relational joins. Equi-joins carry no hints: Spark picks the strategy from sizes it measures, and
adaptive execution splits skewed partitions. Only fixed in-code tables are broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.scalars import ipv4_number, mac_hex


def inner(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "inner")


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) for c in cols})


def rollup_left(parent: DataFrame, rollup: DataFrame, on: list[str], zeros: list[str]) -> DataFrame:
    """Attach a pre-aggregated roll-up to its parent; counts of absent children read zero."""
    return zero_fill(parent.join(rollup, on, "left"), zeros)


def lateral_agg(parent: DataFrame, child: DataFrame, on: list[str], aggs: list[Column], zeros: list[str] = ()) -> DataFrame:
    """Per-parent aggregate of its children: aggregate first, then join, so no child row is joined."""
    return rollup_left(parent, child.groupBy(*on).agg(*aggs), on, list(zeros))


def latest_child(parent: DataFrame, child: DataFrame, on: list[str], order: list[Column], take: dict[str, str]) -> DataFrame:
    """Newest child per parent, by the greatest order tuple; the aggregate combines on the map side."""
    row = F.max_by(F.struct(*[F.col(src).alias(out) for out, src in take.items()]), F.struct(*order))
    newest = child.groupBy(*on).agg(row.alias("_row")).select(*on, "_row.*")
    return parent.join(newest, on, "left")


def join_nullsafe(left: DataFrame, right: DataFrame, on: list[str], blank_as_null: bool = True) -> DataFrame:
    """Equi-join in which null equals null (and, by default, the empty string)."""
    def norm(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if blank_as_null else F.col(c)

    renamed = right
    cond = F.lit(True)
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    for c in on:
        cond = cond & norm(c).eqNullSafe(norm(f"_r_{c}"))
    return left.join(renamed, cond, "inner").drop(*[f"_r_{c}" for c in on])


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def single_rows(*frames: DataFrame) -> DataFrame:
    """Side by side, frames that are global aggregates and so hold exactly one row each."""
    return reduce(lambda a, b: a.join(b, F.lit(True), "inner"), frames)


#: Words of the filter over device addresses, as a power of two: 8,192 of 64 bits, 64 KB whatever the number of devices.
FILTER_POWER = 13


def _filter_bits(h: Column) -> tuple[Column, Column]:
    """The filter's word for a hash, and the two bits of it that the hash sets."""
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(h, 64 - FILTER_POWER).cast("int"), one(0).bitwiseOR(one(6))


def address_filter(keys: DataFrame, key: str) -> DataFrame:
    """One row with a blocked Bloom filter of the keys: an array of 2 ** ``FILTER_POWER`` longs. It never misses a key; of foreign
    keys it lets through about one in 200 with 20,000 keys, one in 10 with 100,000; a higher power suits larger fleets.
    """
    word, bits = _filter_bits(F.xxhash64(key))
    seen = keys.filter(F.col(key).isNotNull()).select(word.alias("_w"), bits.alias("_b"))
    blank = keys.sparkSession.range(1 << FILTER_POWER).select(F.col("id").cast("int").alias("_w"), F.lit(0).cast("bigint").alias("_b"))
    words = seen.unionByName(blank).groupBy("_w").agg(F.bit_or("_b").alias("_b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "_b"))), lambda x: x["_b"]).alias("_filter"))


def contains_join(texts: DataFrame, devices: DataFrame, text_cols: list[str], mac: str, text_id: list[str],
                  device_order: str, take: dict[str, str]) -> DataFrame:
    """Attach the first device whose hex MAC occurs inside a text, without comparing every pair.

    A MAC has 12 hex digits, so each text is cut into its distinct 12-digit windows. A filter of the devices' addresses, a scalar
    subquery of fixed size, drops nearly all of them in the task that cut them; the rest, little more than the matches, are
    joined by equality. Texts without a match, and null texts, keep null columns.
    """
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in text_cols])
    row = F.struct(*[F.col(s).alias(o) for o, s in take.items()]).alias("_row")
    keyed = devices.select(mac_hex(F.col(mac)).alias("_mac"), F.col(device_order).alias("_ord"), row).filter(F.length("_mac") == 12)
    known = address_filter(keyed, "_mac").scalar()
    starts = F.sequence(F.lit(1), F.length("_hex") - 11)
    word, bits = _filter_bits(F.xxhash64("_mac"))
    grams = (
        texts.select(*text_id, mac_hex(joined).alias("_hex"))
        .filter(F.length("_hex") >= 12)
        .select(*text_id, F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_hex"), i, 12)))).alias("_mac"))
        .filter(F.get(known, word).bitwiseAND(bits) == bits)
    )
    found = grams.join(keyed, "_mac").groupBy(*text_id).agg(F.min_by("_row", "_ord").alias("_row")).select(*text_id, "_row.*")
    return texts.join(found, text_id, "left")


def coalesced_lookup(facts: DataFrame, config: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """First hit among several key columns against one lookup (exact key, then coarser key, and so on)."""
    result = facts
    for i, key in enumerate(keys):
        side = config.select(F.col("key").alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        result = result.join(side, F.col(key).cast("string") == F.col(f"_k{i}"), "left")
    result = result.withColumn(out, F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))]))
    return result.drop(*[f"_{p}{i}" for i in range(len(keys)) for p in "kv"])


def multi_key_lookup(facts: DataFrame, devices: DataFrame, device_keys: list[str], probes: list[str], order: str,
                     take: dict[str, str]) -> DataFrame:
    """Find a device by any of its keys; a repeated key belongs to the device latest in order, and the
    fact's probe columns are tried in turn."""
    row = F.struct(*[F.col(s).alias(o) for o, s in take.items()])
    entries = devices.select(
        F.explode(F.array_distinct(F.filter(F.array(*[F.col(k).cast("string") for k in device_keys]),
                                            lambda k: k.isNotNull() & (k != "")))).alias("_key"),
        row.alias("_row"), F.col(order).alias("_ord"),
    )
    index = entries.groupBy("_key").agg(F.max_by("_row", "_ord").alias("_row"))
    result = facts
    for i, probe in enumerate(probes):
        side = index.select(F.col("_key").alias(f"_k{i}"), F.col("_row").alias(f"_r{i}"))
        result = result.join(side, F.col(probe).cast("string") == F.col(f"_k{i}"), "left")
    result = result.withColumn("_hit", F.coalesce(*[F.col(f"_r{i}") for i in range(len(probes))]))
    return result.select(*facts.columns, *[F.col(f"_hit.{o}").alias(o) for o in take])


def range_filter_join(facts: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, bucket: float,
                      on: list[str] = ()) -> DataFrame:
    """Rows whose value lies in a range, as an equi-join on range buckets followed by the exact test.

    Ranges are exploded over the buckets they touch, so a fact meets only ranges near it.
    """
    b = lambda c: F.floor(F.col(c) / F.lit(float(bucket)))
    spread = ranges.withColumn("_bk", F.explode(F.sequence(b(lo).cast("bigint"), b(hi).cast("bigint"))))
    keyed = facts.withColumn("_bk", b(value).cast("bigint"))
    return keyed.join(spread, ["_bk", *on]).filter(F.col(value).between(F.col(lo), F.col(hi))).drop("_bk")


def in_any_cidr(df: DataFrame, ip: str, bounds: list[tuple[int, int]]) -> DataFrame:
    """Rows whose address falls in one of a few configured blocks."""
    # the address is parsed once a row, not once a bound: a filter repeats any expression that it names twice
    inside = F.exists(F.array(ipv4_number(F.col(ip))), lambda n: reduce(lambda a, b: a | b, [n.between(lo, hi) for lo, hi in bounds]))
    return df.filter(F.coalesce(inside, F.lit(False)))


def restore_preserved(preserved: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Preserved rows whose parent still exists, plus those that name no parent."""
    kept = preserved.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_semi")
    return kept.unionByName(preserved.filter(F.col(key).isNull()).select(*kept.columns))
