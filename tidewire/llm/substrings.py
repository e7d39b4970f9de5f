"""Removal of repeated word runs, found by recompression.

Words are named by hashes. A round replaces runs of one name by a name of (name, length); each further round replaces pairs of neighbours by a name
of the pair, where a coin tossed by name makes the first a left and the second a right partner. Names depend on content alone, so equal
passages of any two documents get equal symbols in their interior. A window of words is looked up by one such symbol:
only symbols that two documents share lead to a comparison of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import chunks, store
from tidewire.llm.hashing import U, mix, text_bytes, windows, word_hashes, word_spans


@dataclass(frozen=True)
class Plan:
    """Words in a window, rounds of pairing, coins tried per round, entries that a task gathers before it sends them on, least number of shards."""

    words: int = 13
    rounds: int = 2
    coins: int = 4
    gather: int = 1_000_000
    shards: int = 64

    def shards_for(self, df: DataFrame) -> int:
        return max(self.shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@dataclass
class Level:
    """Symbols of a chunk: names, first words, and (for pairing) which of them begins a document."""

    names: np.ndarray
    starts: np.ndarray
    fresh: np.ndarray


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(column)
    starts, ends, edges = word_spans(raw, offsets)
    return word_hashes(raw, starts, ends, lower=False), edges


def runs(words: np.ndarray, edges: np.ndarray) -> Level:
    """Runs of one word, named by the word and, if it is repeated, the length."""
    fresh = np.zeros(len(words), bool)
    fresh[edges[:-1][np.diff(edges) > 0]] = True
    head = fresh.copy()
    head[1:] |= words[1:] != words[:-1]
    starts = np.flatnonzero(head)
    length = np.diff(starts, append=len(words))
    names = words[starts]
    names = np.where(length > 1, mix(names + length.astype(np.uint64) * U(0xA0761D6478BD642F)), names)
    return Level(names, starts, fresh[starts])


def coin(names: np.ndarray, salt: int) -> np.ndarray:
    """True: a left partner."""
    return mix(names ^ U(salt)) >> U(63) == 1


def merges(level: Level, left: np.ndarray) -> np.ndarray:
    """Which symbols merge with the next one."""
    out = np.zeros(len(left), bool)
    out[:-1] = left[:-1] & ~left[1:] & ~level.fresh[1:]
    return out


def pairs(level: Level, merge: np.ndarray) -> tuple[Level, np.ndarray]:
    """The next level, and for each symbol (and one past the last) the number of the new symbol that begins there or holds it."""
    head = np.ones(len(merge) + 1, bool)
    head[1:] = ~merge
    at = np.cumsum(head) - 1
    head = head[:-1]
    names = level.names.copy()
    names[:-1] = np.where(merge[:-1], mix(level.names[:-1] * U(0xE7037ED1A0B428DB) + mix(level.names[1:] + U(5))), level.names[:-1])
    return Level(names[head], level.starts[head], level.fresh[head]), at


def anchors(words: np.ndarray, edges: np.ndarray, salts: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of ``n`` words inside one text: its anchor symbol, the number of its text, its first word.

    The anchor is a function of the window's words alone. From both ends of the window all symbols are taken off that words outside might
    change: the outermost run, then in every round of pairing a right partner at the start and a left partner at the end. Of the
    neighbouring two among the symbols left in the last round, the longest are the anchor, then those with the greatest hash. If only one is left,
    it is the anchor; if none, the round before decides, and last of all the hash of the window.
    """
    hashes, owner = windows(words, edges, n)
    counts = np.maximum(np.diff(edges) - n + 1, 0)
    first = np.repeat(edges[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    best = hashes >> U(8)
    if not len(first):
        return best, owner, first
    level = runs(words, edges)
    at = np.searchsorted(level.starts, np.arange(len(words)), side="right") - 1
    low, high = at[first] + 1, at[first + n - 1]
    for salt in salts:
        left = coin(level.names, salt)
        merge = merges(level, left)
        low = low + ~left[np.minimum(low, len(left) - 1)]
        high = high - left[np.maximum(high - 1, 0)]
        gone = low >= high
        level, at = pairs(level, merge)
        low, high = at[np.minimum(low, len(at) - 1)], at[np.maximum(high, 0)]
        low = np.where(gone, high, low)
        for together in (1, 2):  # symbols, then neighbouring two under one name
            length, names = np.diff(level.starts, append=len(words)), level.names
            if together == 2:
                length, names = length[:-1] + length[1:], mix(names[:-1] * U(0xE7037ED1A0B428DB) + mix(names[1:] + U(11)))
            rank = np.minimum(length, 255).astype(np.uint64) << U(56) | mix(names + U(3)) >> U(8)
            top = np.zeros(len(first), np.uint64)
            last = high - together + 1
            open_ = np.flatnonzero(low < last)
            k = 0
            while len(open_):
                top[open_] = np.maximum(top[open_], rank[low[open_] + k])
                k += 1
                open_ = open_[low[open_] + k < last[open_]]
            best = np.where(top > 0, top, best)
    return best, owner, first


def choose_salts(docs: DataFrame, plan: Plan) -> list[int]:
    """Round by round, the coin of ``plan.coins`` that merges most pairs over all documents."""
    salts: list[int] = []
    for r in range(plan.rounds):
        tried = [int(x) for x in mix(np.arange(1 + r * plan.coins, 1 + (r + 1) * plan.coins, dtype=np.uint64))]
        done = list(salts)

        def count(batches: Iterator[pa.RecordBatch], tried=tried, done=done) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(tried), np.int64)
            for batch in batches:
                for part in chunks(batch):
                    level = runs(*words_of(part.column("text")))
                    for salt in done:
                        level, _ = pairs(level, merges(level, coin(level.names, salt)))
                    total += [int(merges(level, coin(level.names, salt)).sum()) for salt in tried]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(tried))), pa.array(total)], names=["coin", "n"])

        sums = docs.select("text").mapInArrow(count, "coin long, n long").groupBy("coin").agg(F.sum("n").alias("n")).collect()
        salts.append(tried[max(sums, key=lambda row: (row["n"], -row["coin"]))["coin"]] if sums else tried[0])
    return salts


_SENT = "shard int, doc long, version long, keys binary, docs binary, spans binary"
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


#: Bytes of a key on its way. What shard a key goes to depends on further bits of its hash, so keys differ in more bits than these hold.
SYMBOL_BYTES, WINDOW_BYTES = 5, 8


def packed(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def batch_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


class Exchange:
    """Entries (key, document) on their way to the shard of the key.

    What is decided within the task travels as one row per document, as keys or as spans of one version of its text. Other entries are sent once per key and
    task: a key that many documents have reaches its shard as often as there are tasks. Ids are sent as compressed differences.
    """

    def __init__(self, shards: int, width: int):
        self.shards, self.width = shards, width
        self.rows: list[tuple] = []

    def send(self, keys: np.ndarray, docs: np.ndarray, salt: np.ndarray) -> None:
        shard = (mix(salt) % U(self.shards)).astype(np.int64)
        order = np.lexsort([docs, shard])
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            some = order[edges[s] : edges[s + 1]]
            ids = zstandard.compress(np.diff(docs[some], prepend=0).astype("<i8").tobytes(), 1)
            self.rows.append((int(s), None, None, packed(keys[some], self.width), ids, None))

    def known(self, keys: np.ndarray, docs: np.ndarray) -> None:
        self.rows += [(d % self.shards, d, None, packed(k, self.width), None, None) for d, k in per_document(keys, docs)]

    def spans(self, doc: int, version: int, at: np.ndarray) -> None:
        """Window starts of one text."""
        self.rows.append((doc % self.shards, doc, version, None, None, as_spans(at)))

    def batches(self, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SENT.split(", ")]
        held, size = [], 0
        for row in self.rows:
            held.append(row)
            size += len(row[3] or b"")
            if size > most or len(held) >= 10_000:
                yield batch_of(held, names, _KINDS)
                held, size = [], 0
        yield batch_of(held, names, _KINDS)
        self.rows.clear()


def as_spans(at: np.ndarray) -> bytes:
    """Ascending positions as runs (first, last)."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]], axis=1).astype("<i4").tobytes()


def from_spans(data: bytes) -> np.ndarray:
    runs_ = np.frombuffer(data, "<i4").reshape(-1, 2).astype(np.int64)
    size = runs_[:, 1] - runs_[:, 0] + 1
    return np.repeat(runs_[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def per_document(keys: np.ndarray, docs: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    cut = np.flatnonzero(np.diff(docs)) + 1
    return [(int(docs[i]), keys[i:j]) for i, j in zip([0, *cut], [*cut, len(docs)], strict=True) if j > i]


def grouped(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of entries by key and document; where keys begin in it, and where documents of a key begin."""
    order = np.lexsort([docs, keys])
    keys, docs = keys[order], docs[order]
    new_key = np.ones(len(docs), bool)
    new_key[1:] = keys[1:] != keys[:-1]
    new_doc = new_key.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    return order, new_key, new_doc


def reply(sent: DataFrame, width: int, later_only: bool) -> DataFrame:
    """(doc, found): for each document its keys that another document has too; with ``later_only``, one with a smaller id.

    The rows of a shard are the gathered entries of all tasks. What was known before passes through. ``found`` has structs of version, keys and spans.
    """
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, kinds = ["doc", "version", "keys", "spans"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def settle() -> list[tuple]:
            if not held:
                return []
            keys = np.concatenate([unpacked(k, width) for k, _ in held])
            docs = np.concatenate([np.cumsum(np.frombuffer(zstandard.decompress(d), "<i8")) for _, d in held])
            held.clear()
            order, new_key, new_doc = grouped(keys, docs)
            keys, docs, new_key = keys[order][new_doc], docs[order][new_doc], new_key[new_doc]
            first = np.flatnonzero(new_key)
            count = np.diff(first, append=len(docs))
            take = np.repeat(count > 1, count)
            if later_only:
                take[first] = False
            return [(d, None, packed(k, width), None) for d, k in per_document(keys[take], docs[take])]

        for batch in batches:
            out: list[tuple] = []
            for s, doc, version, keys, docs, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs is None:
                    out.append((doc, version, keys, spans))
                    continue
                if s != shard:
                    out += settle()
                    shard = s
                held.append((keys, docs))
            yield batch_of(out, names, kinds)
        yield batch_of(settle(), names, kinds)

    dealt = sent.repartition(n, "shard").sortWithinPartitions("shard")
    replies = dealt.mapInArrow(run, "doc long, version long, keys binary, spans binary")
    return replies.groupBy("doc").agg(F.collect_list(F.struct("version", "keys", "spans")).alias("found"))  # one document's own windows


def shared_symbols(docs: DataFrame, salts: list[int], plan: Plan) -> DataFrame:
    """(doc, keys): of each document, the anchors that another document has too."""
    shards = plan.shards_for(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = Exchange(shards, SYMBOL_BYTES), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                keys, owners = np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held])
                held.clear()
                order, new_key, new_doc = grouped(keys, owners)
                keys, owners = keys[order][new_doc], owners[order][new_doc]
                first = np.flatnonzero(new_key[new_doc])
                count = np.diff(first, append=len(owners))
                some = np.repeat(count > 1, count)
                out.known(keys[some], owners[some])
                out.send(keys[first], owners[first], keys[first])
                yield from out.batches()

        for batch in batches:
            for part in chunks(batch):
                best, owner, _ = anchors(*words_of(part.column("text")), salts, plan.words)
                ids = part.column("doc").to_numpy()[owner]
                change = np.ones(len(best), bool)
                change[1:] = (best[1:] != best[:-1]) | (ids[1:] != ids[:-1])
                held.append((best[change], ids[change]))
                size += int(change.sum())
                if size > plan.gather:
                    yield from settle()
                    size = 0
        yield from settle()

    return reply(docs.mapInArrow(run, _SENT), SYMBOL_BYTES, later_only=False)


def _window_keys(words: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of all windows, independent hashes that choose their shards, and their texts."""
    keys, owner = windows(words, edges, n)
    salt, _ = windows(words, edges, n, seed=977)
    return keys, salt, owner


def remove_repeats(docs: DataFrame, plan: Plan = Plan(), keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and with ``keep_text`` the kept words as ``text``) of every document.

    A word goes if a window of ``plan.words`` words that covers it also starts in a document with a smaller doc_id. Windows are judged on
    the input. Words end at blanks and the control characters 9 to 13 and stay as they are. Null texts have no words. A null doc_id
    is greater than all others; rows with equal doc_id take nothing from each other.
    """
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    salts = choose_salts(docs, plan)
    symbols = shared_symbols(docs.select("doc", "text"), salts, plan)
    shards = plan.shards_for(docs)

    def open_windows(texts: pa.Array, shared: list[list[dict]]) -> list[np.ndarray]:
        """Of each text, which windows have a shared anchor."""
        best, owner, _ = anchors(*words_of(texts), salts, plan.words)
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [np.isin(best[i:j] & U((1 << 8 * SYMBOL_BYTES) - 1), unpacked(b"".join(f["keys"] for f in found), SYMBOL_BYTES)) for i, j, found in zip(cut[:-1], cut[1:], shared, strict=True)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "doc", "n_words", "sha", "text", "version", "open"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            for part in chunks(batch):
                shared = part.column("found").to_pylist()
                some = [i for i, s in enumerate(shared) if s]
                hits = dict(zip(some, open_windows(part.column("text").take(pa.array(some)), [shared[i] for i in some]), strict=True)) if some else {}
                rows = []
                for i, (doc_id, doc, text) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("doc").to_pylist(), part.column("text"), strict=True)):
                    text = text.as_py()
                    if i in hits and hits[i].any():
                        data = text.encode()
                        version = int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)
                        rows.append((doc_id, doc, None, None, zstandard.compress(data, 3), version, as_spans(np.flatnonzero(hits[i]))))
                    else:
                        words = text.encode().split()
                        kept = b" ".join(words)
                        rows.append((doc_id, doc, len(words), hashlib.sha256(kept).hexdigest(), zstandard.compress(kept, 3) if keep_text else None, None, None))
                yield batch_of(rows, names, kinds)

    looked = store(
        docs.join(symbols, "doc", "left").select("doc_id", "doc", "text", "found")
        .mapInArrow(look, "doc_id long, doc long, n_words long, sha string, text binary, version long, open binary"), "repeats-candidates")
    candidates = looked.filter("open is not null")  # their texts are stored and shuffled compressed

    def texts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chunks of a batch with the texts in plain form."""
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            plain = pa.array([zstandard.decompress(t.as_py()) for t in part.column("text")], pa.binary()).cast(pa.string())
            yield from chunks(part.set_column(part.schema.get_field_index("text"), "text", plain))


    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = Exchange(shards, WINDOW_BYTES), 0
        texts: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                keys, salt, at, text = (np.concatenate([h[i] for h in held]) for i in range(4))
                owners = np.array([d for d, _ in texts])[text]
                order, new_key, new_doc = grouped(keys, owners)
                # Windows of the least document of each key stay open; those of later documents go.
                run_, doc_run = np.cumsum(new_key) - 1, np.cumsum(new_doc) - 1
                later = doc_run > doc_run[np.flatnonzero(new_key)][run_]
                gone = order[later]
                gone = gone[np.lexsort([at[gone], text[gone]])]
                cut = np.flatnonzero(np.diff(text[gone])) + 1
                for i, j in zip([0, *cut], [*cut, len(gone)], strict=True):
                    if j > i:
                        out.spans(*texts[text[gone[i]]], at[gone[i:j]])
                first = order[new_key]
                out.send(keys[first], owners[first], salt[first])
                held.clear()
                texts.clear()
                yield from out.batches()

        for batch in batches:
            for part in texts_of(batch):
                keys, salt, owner = _window_keys(*words_of(part.column("text")), plan.words)
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                for i, (doc, version, spans) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc", "version", "open")), strict=True)):
                    at = from_spans(spans)
                    held.append((keys[cut[i] + at], salt[cut[i] + at], at, np.full(len(at), len(texts))))
                    texts.append((doc, version))
                    size += len(at)
                if size > plan.gather:
                    yield from settle()
                    size = 0
        yield from settle()

    repeated = reply(candidates.select("doc", "version", "text", "open").mapInArrow(gather, _SENT), WINDOW_BYTES, later_only=True)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for part in texts_of(batch):
                columns = [part.column(c).to_pylist() for c in ("doc_id", "version", "text", "found")]
                asked = [i for i, found in enumerate(columns[3]) if any(f["keys"] for f in found or [])]
                keys, _, owner = _window_keys(*words_of(part.column("text").take(pa.array(asked, pa.int64()))), plan.words)
                span = dict(zip(asked, np.searchsorted(owner, np.arange(len(asked) + 1)), strict=False))
                stop = dict(zip(asked, np.searchsorted(owner, np.arange(1, len(asked) + 1)), strict=True))
                rows = []
                for i, (doc_id, version, text, found) in enumerate(zip(*columns, strict=True)):
                    parts = text.encode().split()
                    gone = np.zeros(len(parts) + 1, np.int64)
                    for f in found or []:
                        if f["spans"] is not None and f["version"] == version:
                            for low, high in np.frombuffer(f["spans"], "<i4").reshape(-1, 2):
                                gone[low] += 1
                                gone[high + plan.words] -= 1
                    if i in span:
                        wanted = np.concatenate([unpacked(f["keys"], WINDOW_BYTES) for f in found if f["keys"]])
                        at = np.flatnonzero(np.isin(keys[span[i] : stop[i]], wanted))
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + plan.words, -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    kept = b" ".join(compress(parts, keep.tolist()))
                    rows.append((doc_id, len(parts), int(len(parts) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
                yield batch_of(rows, names, kinds)

    changed = (
        candidates.select("doc_id", "doc", "version", "text").join(repeated, "doc", "left").select("doc_id", "version", "text", "found")
        .mapInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"))
    whole = looked.filter("open is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), "text")
    if keep_text:
        whole = whole.mapInArrow(lambda batches: (b.set_column(4, "text", pa.array([zstandard.decompress(t.as_py()) for t in b.column(4)], pa.binary()).cast(pa.string())) for b in batches),
                                 "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
    else:
        whole = whole.withColumn("text", F.lit(None).cast("string"))
    out = whole.union(changed)
    return out if keep_text else out.drop("text")
