"""The registered queries of this subpackage, one per operator, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import ann, decontaminate, fingerprints, lm, merkle, neardup, packing, quality, secrets, shards, spelling, substrings, toxicity
from tidewire.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_ranks() -> str:
    """The rank file of the public vocabulary that ``byte_bpe_50k.json`` holds too."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenizer_added() -> tuple[tuple[str, int], ...]:
    """The added tokens of ``byte_bpe_50k.json``, which the rank file lacks."""
    import public_tokenizers

    return packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """A toxicity score of every document."""
    t = Tables(spark, path)
    return toxicity.toxicity(t.documents, t.labels)


@query
def op4_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(Tables(spark, path).documents)


@query
def op7_shard_bytes(spark: SparkSession, path: str) -> DataFrame:
    """40 contiguous shards of near equal bytes."""
    out = shards.shard_documents(Tables(spark, path).documents, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_packing(spark: SparkSession, path: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return packing.pack_documents(Tables(spark, path).documents, tokenizer_ranks(), added=tokenizer_added())


@query
def op10_near_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """Components of documents whose shingle sets agree by 85 percent or more."""
    return neardup.near_duplicates(Tables(spark, path).documents, neardup.Rule(percent=85))


@query
def op6_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Documents without the 13-word windows that a document with a smaller id has."""
    return substrings.remove_repeats(Tables(spark, path).documents)


@query
def op9_quality(spark: SparkSession, path: str) -> DataFrame:
    """A quality score of every document."""
    t = Tables(spark, path)
    return quality.quality(t.documents, t.labels)


@query
def op2_contamination(spark: SparkSession, path: str) -> DataFrame:
    """Words of every document inside 10-word windows of benchmark items."""
    t = Tables(spark, path)
    return decontaminate.contamination(t.documents, t.benchmark).drop("items")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL["op2_contamination"] = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
lengths as (select distinct n from bw),
dw as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)),
hit as (select doc_id, i, n, item_id from dw join bw using (n, win)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)"""


@query
def op3_secrets(spark: SparkSession, path: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.secret_report(Tables(spark, path).documents)


@query
def op5_language_model(spark: SparkSession, path: str) -> DataFrame:
    """Language-model scores of all documents by a trigram model."""
    return lm.score_documents(Tables(spark, path).documents, lm.Settings(order=3))


SQL["op6_repeats"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as k
  from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
first as (select k, min(doc_id) as m from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from win join first using (k) where m < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as s from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (doc_id)"""

SQL["op10_near_duplicates"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as k
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
size as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from pair join size a on a.doc_id = x join size b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
both_ways as (select x, y from link union all select y, x from link),
reach as (select doc_id, doc_id as root from d union select y, root from reach join both_ways on x = reach.doc_id),
comp as (select doc_id, min(root) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from d join comp using (doc_id) left join size using (doc_id)"""

SQL["op3_secrets"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
kinds as (
  select * from (values
    ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6), ('access', 1, 'AKIA[A-Z0-9]+', 20),
    ('hex', 2, '[0-9a-f]{24,}', 24), ('run', 3, '[A-Za-z0-9+/_-]{20,}', 20)) as k(kind, rank, pattern, least)),
m as (
  select doc_id, kind, rank, least, regexp_extract_all(t, pattern) as found, string_split_regex(t, pattern) as gaps,
    case when kind = 'assign' then regexp_extract_all(t, pattern, 2) else regexp_extract_all(t, pattern) end as inn
  from d, kinds),
u as (select doc_id, kind, rank, least, i, found[i] as found, inn[i] as inn, gaps[i] as gap from (select *, unnest(range(1, len(found) + 1)) as i from m where len(found) > 0)),
p as (select *, sum(length(gap) + length(found)) over (partition by doc_id, kind order by i) as stop from u),
base as (select doc_id, kind, rank, stop - length(found) as start, stop from p where kind <> 'run' and length(inn) >= least),
runs as (
  select doc_id, i, found, stop - length(found) as start, regexp_full_match(found, '[0-9A-Fa-f]+') as is_hex from p
  where kind = 'run' and not regexp_matches(found, '^[A-Za-z_-]+$') and not regexp_matches(found, '^[0-9_-]+$') and not regexp_matches(found, '^(?:[A-Za-z_-]*/){2,}[A-Za-z_-]*$')
    and not regexp_matches(found, '^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$') and not regexp_matches(found, '(?i)example|placeholder|changeme|dummy|sample')),
places as (select *, unnest(range(0, length(found) - 19)) as w from runs),
chars as (select doc_id, i, start, is_hex, w, substr(found, w + c, 1) as ch from (select *, unnest(range(1, 21)) as c from places)),
sums as (
  select doc_id, i, start, is_hex, w, sum(round(n * log2(n) * 1000000)) as total
  from (select doc_id, i, start, is_hex, w, ch, count(*) as n from chars group by all) group by all),
hot as (select *, w - lag(w) over (partition by doc_id, i order by w) as step from sums where total <= case when is_hex then 28438562 else 12438562 end),
isle as (select *, count(*) filter (where step is null or step > 20) over (partition by doc_id, i order by w) as no from hot),
entropy as (
  select doc_id, case when is_hex then 'entropy_hex' else 'entropy_base64' end as kind, case when is_hex then 3 else 4 end as rank, start + min(w) as start, start + max(w) + 20 as stop
  from isle group by doc_id, i, start, is_hex, no),
told as (select doc_id, rank < 3 as is_base, kind, rank, start, kind || ':' || start::bigint || ':' || stop::bigint as span from (select * from base union all select * from entropy)),
g as (
  select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
    string_agg(span, ',' order by start, rank) filter (where is_base) as base, string_agg(span, ',' order by start, rank) as spans
  from told group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)"""


@query
def op11_nearest_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector id."""
    vectors = Tables(spark, path).embeddings
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op12_spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    """All words with their more frequent spelling, one edit away."""
    return spelling.variants(Tables(spark, path).documents)


@query
def op13_merkle_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every document's place in the Merkle trees of the sources, and whether a tampered copy is noticed."""
    return merkle.document_manifest(Tables(spark, path).documents)


# crc32 of a text by its bytes: the table of 256 remainders follows from the polynomial 0xEDB88320
_CRC_TABLE = "(select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b::bigint)) as crc_table)"


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes; needs a column crc_table."""
    bytes_ = f"list_transform(range(1, 1 + octet_length(encode({text}))), lambda p: ('0x' || substr(hex(encode({text})), (2 * p - 1)::int, 2))::bigint)"
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, b: xor(c >> 8, crc_table[1 + (xor(c, b) & 255)]), 4294967295::bigint))"


SQL["op7_shard_bytes"] = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
bytes as (select doc_id, t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint) as b from d),
sized as (
  select doc_id, len(b) + 16 as size, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, crc_table[1 + (xor(c, x) & 255)]), 4294967295::bigint)) as text_crc32
  from bytes, {_CRC_TABLE}),
placed as (
  select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) - size as before, sum(size) over () as total,
    row_number() over (order by doc_id nulls first, text_crc32, size) as r
  from sized),
dealt as (select *, least(39, (before + size // 2) // greatest(1, ceil(total / 40.0)::hugeint))::int as shard from placed)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by r) - 1)::bigint as slot, null::int as grown_shard
from dealt"""

SQL["op13_merkle_manifest"] = rf"""
with recursive f as (
  select doc_id, source, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head, text,
    case when {_crc32("coalesce(doc_id::varchar, '')")} % 2 = 0 then replace(text, chr(10), '') else text end as other
  from documents, {_CRC_TABLE}),
leaves as (
  select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf, sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) as changed from f),
l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from leaves),
low as (
  select 0 as lvl, source, i, leaf as h, count(*) over (partition by source) as n from l
  union all
  select lvl + 1, source, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from low where n > 1 group by lvl, source, i // 3),
sub as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as i from low where n = 1),
high as (
  select 0 as lvl, i, subroot as h, count(*) over () as n from sub
  union all
  select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (any_value(n) + 2) // 3 from high where n > 1 group by lvl, i // 3),
steps as (
  select l.source, l.i, low.lvl, coalesce(string_agg(low.h, '' order by low.i) filter (where low.i < l.i // (3 ** low.lvl)::bigint), '') as a,
    coalesce(string_agg(low.h, '' order by low.i) filter (where low.i > l.i // (3 ** low.lvl)::bigint), '') as b
  from l join low on low.source is not distinct from l.source and low.n > 1 and low.i // 3 = l.i // (3 ** (low.lvl + 1))::bigint group by all
  union all
  select l.source, l.i, 1000 + high.lvl, coalesce(string_agg(high.h, '' order by high.i) filter (where high.i < sub.i // (3 ** high.lvl)::bigint), ''),
    coalesce(string_agg(high.h, '' order by high.i) filter (where high.i > sub.i // (3 ** high.lvl)::bigint), '')
  from l join sub on sub.source is not distinct from l.source join high on high.n > 1 and high.i // 3 = sub.i // (3 ** (high.lvl + 1))::bigint group by all),
paths as (select source, i, list({{'a': a, 'b': b}} order by lvl) as p, sha256(string_agg(a || b, '' order by lvl)) as proof from steps group by source, i),
done as (
  select l.*, subroot, (select h from high where n = 1) as root, coalesce(proof, sha256('')) as proof, coalesce(p, []) as p
  from l join sub on sub.source is not distinct from l.source left join paths on paths.source is not distinct from l.source and paths.i = l.i),
fold as (
  select source, i, 1 as k, changed as h, p from done
  union all
  select source, i, k + 1, sha256(p[k].a || h || p[k].b), p from fold where k <= len(p))
select doc_id, leaf, subroot, root, proof as proof_sha256, fold.h as folded_root, fold.h = root as verified
from done join fold on fold.source is not distinct from done.source and fold.i = done.i and fold.k = len(fold.p) + 1"""

SQL["op12_spelling_variants"] = rf"""
with recursive runs as (
  select doc_id, run, count(*) as n from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents)
  group by all),
hashed as (select run, n, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs, {_CRC_TABLE} where length(run) >= 5),
words as (
  select word, sum(n)::bigint as n
  from (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed)
  where length(word) >= 5 group by word having sum(n) >= 3),
cut as (select word, k, substr(word, 1, k) || substr(word, k + 2) as rest from (select word, unnest(range(0, length(word)))::int as k from words)),
near as (
  select a.word as x, b.word as y from cut a join cut b on a.k = b.k and a.rest = b.rest and a.word <> b.word
  union select cut.word, words.word from cut join words on cut.rest = words.word
  union select words.word, cut.word from cut join words on cut.rest = words.word),
best as (select x as word, count(*) as n_near, max(n) as top, arg_min(y, (-n, encode(y))) as y from near join words on words.word = y group by x),
forms as (select words.word, n, coalesce(n_near, 0) as n_near, case when top >= 2 * n then y end as form, case when top >= 2 * n then top end as form_n from words left join best using (word)),
walk as (select word as first, word, form from forms union all select first, forms.word, forms.form from walk join forms on forms.word = walk.form)
select forms.word, forms.form, walk.word as root, n, n_near, form_n from forms join walk on walk.first = forms.word and walk.form is null"""
