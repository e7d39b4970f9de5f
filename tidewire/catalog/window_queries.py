"""Windows, ranking, duplicates, sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.catalog.bindings import ctes, frame
from tidewire.catalog.registry import query
from tidewire.operators import topk as K
from tidewire.operators import windows as W
from tidewire.operators.blocked import Order

EVENT_ORDER = Order("ts", ("event_id",))


@query("w01_latest_row", ctes("captures") + """
select capture_id, source_name from captures order by coalesce(case when capture_time <= timestamp '2000-06-01' + interval 5 minute then capture_time end, parsed_at) desc, source_name desc limit 1""")
def w01(t):
    limit = F.lit("2000-06-01 00:05:00").cast("timestamp")
    at = F.coalesce(F.when(F.col("capture_time") <= limit, F.col("capture_time")), F.col("parsed_at"))
    return W.latest_row(frame(t, "captures"), at.desc(), F.col("source_name").desc()).select("capture_id", "source_name")


@query("w02_top1", """
select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderstatus asc, o_totalprice desc, o_orderkey) as rn from orders) where rn = 1""")
def w02(t):
    return W.top1(t.orders, ["o_custkey"], [("o_orderstatus", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w03_best_per_key", """
with s as (select page_id as line, length(html) % 10 as bssid, case when length(html) % 7 = 0 then null else -(length(html) % 60)::double end as rssi from pages)
select bssid::int as bssid, line from (select *, row_number() over (partition by bssid order by coalesce(rssi, -999) desc, line) as rn from s) where rn = 1""")
def w03(t):
    n = F.length("html")
    d = t.pages.select(F.col("page_id").alias("line"), (n % 10).alias("bssid"), F.when(n % 7 != 0, -(n % 60).cast("double")).alias("rssi"))
    return W.best_per_key(d, ["bssid"], "rssi", "line", -999.0).select("bssid", "line")


_DUP = """
with k as (select doc_id, source, count(*) over (partition by md5(text)) as duplicate_count, row_number() over (partition by md5(text) order by doc_id) as duplicate_rank from documents)
"""


@query("w04_duplicates", _DUP + "select doc_id, source, duplicate_count, duplicate_rank from k where duplicate_count > 1")
def w04(t):
    return W.duplicates(t.documents, [F.md5("text")], Order("doc_id")).select("doc_id", "source", "duplicate_count", "duplicate_rank")


@query("w04_duplicate_lines", """
with k as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, count(*) over (partition by l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N'), '')) as c,
 row_number() over (partition by l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N'), '') order by l_shipdate desc, l_orderkey, l_linenumber, l_extendedprice) as r from lineitem)
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, c as duplicate_count, r as duplicate_rank from k where c > 1""")
def w04b(t):
    key = [F.col("l_partkey"), F.col("l_suppkey"), F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit(""))]
    order = Order("l_shipdate", ("l_orderkey", "l_linenumber", "l_extendedprice"), desc=True)
    return W.duplicates(t.lineitem, key, order).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "duplicate_count", "duplicate_rank")


@query("w05_canonical", _DUP + "select doc_id, source, duplicate_count from k where duplicate_rank = 1")
def w05(t):
    return W.duplicates(t.documents, [F.md5("text")], Order("doc_id"), keep="canonical").select("doc_id", "source", "duplicate_count")


@query("w06_duplicate_sources", """
with n as (select doc_id, source, coalesce(nullif(case lang when 'en' then md5(text) when 'fr' then '' end, ''), 'path:' || source || '|size:' || coalesce(case when lang <> 'de' then n_chars end::varchar, '') || '|mtime:') as key from documents),
k as (select *, count(*) over (partition by source, key) as c, row_number() over (partition by source, key order by doc_id desc) as r from n)
select doc_id, key as duplicate_key, c as duplicate_count, r as duplicate_rank from k where c > 1""")
def w06(t):
    c = F.col
    sha = F.when(c("lang") == "en", F.md5("text")).when(c("lang") == "fr", "")
    key = W.source_key(sha, c("source"), F.when(c("lang") != "de", c("n_chars")), F.lit(None))
    return W.duplicate_sources(t.documents, ["source"], key, Order("doc_id", desc=True)).select("doc_id", "duplicate_key", "duplicate_count", "duplicate_rank")


@query("w07_dedupe_sources", """
with d as (select doc_id, lang, source || case when doc_id % 3 = 0 then '_20240101_010101_000001' else '' end || doc_id as path, source as name, case when lang = 'de' then '' else md5(text) end as sha from documents)
select doc_id, path from d where sha = '' union all
select doc_id, path from (select *, row_number() over (partition by lang, sha order by regexp_matches(path, '_[0-9]{8}_[0-9]{6}_[0-9]{6}')::int, length(name), path) as rn from d where sha <> '') where rn = 1""")
def w07(t):
    c = F.col
    path = F.concat("source", F.when(c("doc_id") % 3 == 0, "_20240101_010101_000001").otherwise(""), c("doc_id").cast("string"))
    d = t.documents.select("doc_id", "lang", path.alias("path"), c("source").alias("name"), F.when(c("lang") != "de", F.md5("text")).otherwise("").alias("sha"))
    return W.dedupe_sources(d, "lang", "sha", "path", "name", c("path").rlike("_[0-9]{8}_[0-9]{6}_[0-9]{6}")).select("doc_id", "path")


@query("w08_latest_per_series", """
select event_type, user_id, event_id, value from (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def w08(t):
    return W.latest_by(t.events, ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query("w09_best_snapshot", """
with s as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case l_returnflag when 'A' then 'during' when 'R' then 'after' end as phase,
  (case when l_quantity > 25 then 1 else 0 end) + (case when l_tax > 0.04 then 1 else 0 end) + 1 as filled from lineitem),
r as (select *, row_number() over (partition by l_orderkey order by coalesce(phase = 'during', false) desc, filled desc, l_linenumber * 1000000 + l_partkey * 100 + l_quantity) as rn from s)
select l_orderkey, l_linenumber, l_partkey, l_quantity from r where rn = 1""")
def w09(t):
    c = F.col
    phase = F.when(c("l_returnflag") == "A", "during").when(c("l_returnflag") == "R", "after")
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", phase.alias("phase"), F.when(c("l_quantity") > 25, "ap").alias("ap"),
                          F.when(c("l_tax") > 0.04, "x").otherwise("").alias("chan"), F.lit("m").alias("mgid"),
                          (c("l_linenumber") * 1000000 + c("l_partkey") * 100 + c("l_quantity")).alias("tie"))
    return W.best_snapshot(d, ["l_orderkey"], "phase", "during", ["ap", "chan", "mgid"], "tie").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


_OUT = """
with m as (select event_id, case when event_type = 'error' then null else event_type end as floor, user_id % 40 as band, value, value < 60 as exact from events),
s as (select coalesce(floor, '') as f, band, count(*) as n, avg(value) as m, stddev_samp(value) as sd from m where {where} group by all)
"""


@query("w10_outliers_sql", _OUT.format(where="exact") + """
select event_id, n as sample_count, round((value - m) / nullif(sd, 0), 4) as z_score, case when n < 30 then 'insufficient_samples' when sd is null or sd = 0 then 'no_variance'
 when abs((value - m) / sd) > 2 then 'outlier' else 'normal' end as outlier_status from m join s on s.f = coalesce(floor, '') and s.band = m.band""")
def w10(t):
    return _outliers(t, F.col("exact"), True)


@query("w10_outliers_plain", _OUT.format(where="true") + """
select event_id, n as sample_count, case when n >= 30 then round((value - m) / nullif(sd, 0), 4) end as z_score, case when n < 30 then 'insufficient_samples' when sd is null or sd = 0 then 'no_variance'
 when abs((value - m) / sd) > 2 then 'outlier' else 'normal' end as outlier_status from m join s on s.f = coalesce(floor, '') and s.band = m.band""")
def w10b(t):
    return _outliers(t, None, False)


def _outliers(t, sample, keep):
    c = F.col
    d = t.events.select("event_id", F.when(c("event_type") != "error", c("event_type")).alias("floor"), (c("user_id") % 40).alias("band"), "value", (c("value") < 60).alias("exact"))
    o = W.annotate_outliers(d, ["floor", "band"], "value", sample=sample, keep_small_z=keep)
    return o.select("event_id", "sample_count", F.round("z_score", 4).alias("z_score"), "outlier_status")


@query("w11_flag_outliers", """
with s as (select round(avg(value), 6) as m, round(stddev_samp(value), 6) as sd from events)
select event_id, round((value - m) / sd, 4) as z_score, abs((value - m) / sd) > 2 as is_outlier from events, s""")
def w11(t):
    return W.flag_outliers(t.events, "value").select("event_id", "z_score", "is_outlier")


@query("w12_counter_delta", """
with s as (select event_id, user_id, ts, case when event_type <> 'error' then value end as v from events),
p as (select *, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as pv from s)
select event_id, round(coalesce(greatest(v - pv, 0), 0), 6) as delta from (select event_id, v, pv from p where pv is not null and v is not null)
union all select event_id, 0.0 from p where pv is null or v is null""")
def w12(t):
    d = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    return W.counter_delta(d, ["user_id"], EVENT_ORDER, "v").select("event_id", F.round("delta", 6).alias("delta"))


@query("w13_gaps", """
select event_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1000.0::double as gap_ms from events""")
def w13(t):
    return W.gaps(t.events, ["user_id"], EVENT_ORDER).select("event_id", "gap_ms")


@query("w14_ffill", """
select conv_id, turn, last_value(case when role = 'user' then length(text) end ignore nulls) over (partition by conv_id order by turn)::int as last_len from conversations""")
def w14(t):
    d = t.conversations.withColumn("n", F.when(F.col("role") == "user", F.length("text")))
    return W.ffill(d, ["conv_id"], Order("turn"), "n", "last_len").select("conv_id", "turn", "last_len")


@query("w14_ffill_events", """
select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id) as last_purchase from events""")
def w14b(t):
    d = t.events.withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return W.ffill(d, ["user_id"], EVENT_ORDER, "p", "last_purchase").select("event_id", "last_purchase")


@query("w15_block_id", """
select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn)::bigint as block_id from conversations""")
def w15(t):
    return W.block_id(t.conversations, ["conv_id"], Order("turn"), F.col("role") == "user").select("conv_id", "turn", "block_id")


@query("w16_uniquify", """
with s as (select s_suppkey, 'n' || s_nationkey as base, row_number() over (partition by s_nationkey order by s_suppkey) as i from supplier)
select s_suppkey, case when i = 1 then base else base || '-' || i end as unique_id from s""")
def w16(t):
    d = t.supplier.withColumn("base", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return W.uniquify(d, "base", Order("s_suppkey")).select("s_suppkey", "unique_id")


@query("k01_sort_nulls_last", ctes("streams") + """
select stream_id, packet_count, jitter_ms from streams order by jitter_ms desc nulls last, packet_count desc nulls last, stream_id""")
def k01(t):
    return K.sort_nulls_last(frame(t, "streams"), [("jitter_ms", "desc"), ("packet_count", "desc"), ("stream_id", "asc")]).select("stream_id", "packet_count", "jitter_ms")


@query("k02_worst_streams", ctes("streams") + """
select stream_id, packet_count from streams order by coalesce(loss_ratio, 0) desc, coalesce(jitter_ms, 0) desc, coalesce(interarrival_p95_ms, 0) desc, packet_count desc, stream_id limit 40""")
def k02(t):
    return K.worst_streams(frame(t, "streams"), 40, "stream_id").select("stream_id", "packet_count")


@query("k03_bounded_limit", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 5000")
def k03(t):
    return K.bounded_limit(t.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 9999).select("o_orderkey")


@query("k04_topk", "select event_id, value from events order by value desc, event_id limit 25")
def k04(t):
    return K.topk(t.events, "value", 25, ["event_id"]).select("event_id", "value")


@query("k05_topk_by", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as rn from events) where rn = 1")
def k05(t):
    return K.topk_by(t.events, ["user_id"], "value", ["event_id"]).select("user_id", "event_id", "value")


@query("k06_sort_desc", "select event_type, round(sum(value), 2) as total from events group by 1 order by total desc")
def k06(t):
    return K.sort_desc(t.events.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total")), "total")


@query("k07_recent_keys", """
select user_id, max(ts) as last_seen from events where ts >= timestamp '2024-01-29' and (user_id::varchar like '1%' or user_id::varchar like '3%') group by 1 order by 2 desc, 1 limit 20""")
def k07(t):
    return K.recent_keys(t.events, "user_id", "ts", F.lit("2024-01-29").cast("timestamp"), ["1", "3"], 20)


@query("k08_capped", "select event_id, true as truncated from events order by ts, event_id limit 4000")
def k08(t):
    page, more = K.capped(t.events, [F.col("ts"), F.col("event_id")], 4000)
    return page.select("event_id").join(more, F.lit(True))
