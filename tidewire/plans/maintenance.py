"""Table-maintenance jobs: upserts, reloads, snapshots, manual entries, reconciliation, audits.

Each job is a set-based function from frames to frames. ``Store`` persists the
results as numbered versions of a Parquet folder: a new version is written beside
the old one and becomes current when its write has completed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.predicates import match_quality
from tidewire.functions.scalars import BAND_OFFSETS, calibrated_delta, case_map, local_date
from tidewire.operators.aggregates import compare_counters, count_where
from tidewire.operators.joins import restore_preserved
from tidewire.operators.nearest import nearest_join
from tidewire.operators.setops import combine_snapshots, union_all
from tidewire.operators.windows import top1
from tidewire.session import checkpointed

c = F.col
DONE = ["complete", "missing_vendor_offset"]
BEST = [("badge_selected", "desc"), ("badge_score", "desc"), ("badge_rssi_dbm", "desc"), ("id", "asc")]


class Store:
    """A folder of numbered table versions; the newest complete one is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path):
            return []
        done = []
        for status in self._fs.listStatus(self._path):
            name = status.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and self._fs.exists(marker):
                done.append(int(name[1:]))
        return sorted(done)

    def read(self, at_most: int | None = None) -> DataFrame | None:
        """The newest version, or the newest one not above a number; None when there is none."""
        known = [v for v in self.versions() if at_most is None or v <= at_most]
        return self.spark.read.parquet(f"{self.root}/v{known[-1]:08d}") if known else None

    def write(self, df: DataFrame, partition_by: list[str] = (), version: int | None = None) -> int:
        """Write the next version, or a given one; a given one may be written again with the same result."""
        version = (self.versions() or [0])[-1] + 1 if version is None else version
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/v{version:08d}")
        return version


class KeyedStore(Store):
    """The latest rows of each key, as a base and the small versions after it, all cut into buckets by a hash of the key.

    A version holds the rows of the keys that it changes, so writing costs what has changed; its rows replace the key's rows of earlier versions. A reader that
    names its keys opens their buckets only. When the versions after the base outweigh it, a new base merges them, so each row is merged about as often as
    the table doubles. Versions before the last base but one are removed: a batch that is replayed is the newest one.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 16):
        super().__init__(spark, root)
        self.keys, self.buckets = keys, buckets

    def _folder(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._path, f"_part={name}")

    def _folders(self) -> list[tuple[str, int]]:
        """Kind (b: base, v: version) and number of all complete folders."""
        if not self._fs.exists(self._path):
            return []
        names = [status.getPath().getName().removeprefix("_part=") for status in self._fs.listStatus(self._path)]
        return [(n[0], int(n[1:])) for n in names if n[1:].isdigit() and self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(n), "_SUCCESS"))]

    def versions(self) -> list[int]:
        return sorted(number for kind, number in self._folders() if kind == "v")

    def _held(self, at_most: int | None) -> list[str]:
        """The folders that make up a version: the newest base, and the versions after it."""
        folders = [(kind, n) for kind, n in self._folders() if at_most is None or n <= at_most]
        base = max((n for kind, n in folders if kind == "b"), default=-1)
        names = ([f"b{base:08d}"] if base >= 0 else []) + [f"v{n:08d}" for n in sorted(n for kind, n in folders if kind == "v" and n > base)]
        return [n for n in names if any(x.getPath().getName().startswith("_bucket=") for x in self._fs.listStatus(self._folder(n)))]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, at_most: int | None = None, among: DataFrame | None = None) -> DataFrame | None:
        """The newest rows of all keys, or of the keys of ``among``; None when nothing was written. ``at_most`` bounds the versions."""
        names = self._held(at_most)
        if not names:
            return None
        rows = self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/_part={n}" for n in names]).drop("_part")
        if among is not None:
            touched = [r[0] for r in among.select(self.bucket()).distinct().collect()]  # as many rows as buckets
            wanted = among.select(*[c(k).alias(f"_{k}") for k in self.keys]).distinct()
            same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in self.keys])
            rows = rows.filter(c("_bucket").isin(touched)).join(wanted, same, "left_semi")
        newest = F.max("_version").over(Window.partitionBy(*self.keys))
        return rows.withColumn("_newest", newest).filter(c("_version") == c("_newest")).drop("_newest", "_version", "_bucket")

    def write(self, df: DataFrame, partition_by: list[str] = (), version: int | None = None) -> int:
        """Write the rows of the changed keys as the next version, or a given one; the same version may be written again."""
        version = max((int(n[1:]) for n in self._held(None)), default=0) + 1 if version is None else version
        self._put(df, "v", version)
        names = self._held(version)
        size = lambda name: self._fs.getContentSummary(self._folder(name)).getLength()
        base = [n for n in names[:1] if n.startswith("b")]
        if len(names) > 1 and sum(map(size, names[1:])) > size(names[0]):  # the oldest folder counts as the base, be it one or not
            self._put(self.read(version), "b", version)
            for kind, number in self._folders() if base else ():
                if number < int(base[0][1:]):
                    self._fs.delete(self._folder(f"{kind}{number:08d}"), True)
        return version

    def _put(self, df: DataFrame, kind: str, version: int) -> None:
        rows = df.withColumns({"_version": F.lit(version).cast("long"), "_bucket": self.bucket()})
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/_part={kind}{version:08d}")


class BatchLog:
    """Rows of micro-batches, one folder per batch. A replayed batch replaces its own folder and nothing else."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch_id={batch_id}")

    def read(self, except_batch: int | None = None) -> DataFrame | None:
        if not self._fs.exists(self._path) or len(list(self._fs.listStatus(self._path))) == 0:
            return None
        rows = self.spark.read.option("basePath", self.root).parquet(self.root)
        return rows if except_batch is None else rows.filter(c("batch_id") != except_batch)

    def latest(self, keys: list[str], before: int | None = None) -> DataFrame:
        """Each row as the last batch that wrote it has it; ``before`` leaves out a batch and those after it."""
        rows = self.read()
        rows = rows if before is None else rows.filter(c("batch_id") < before)
        own = [x for x in rows.columns if x != "batch_id"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), "batch_id").alias("_r")).select("_r.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Updates replace rows of the same key; among updates of one key the greatest ``order`` wins.

    Without an order, several updates of one key are an error.
    """
    from tidewire.operators.windows import latest_by
    if order:
        new = latest_by(updates, keys, order)
    else:
        one = updates.groupBy(*keys).agg(F.first(F.struct(*updates.columns)).alias("_r"), F.count(F.lit(1)).alias("_n"))
        once = F.when(c("_n") > 1, F.raise_error(F.lit("several updates of one key and no order"))).otherwise(c("_r"))
        new = one.select(once.alias("_r")).select("_r.*")
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*target.columns))


def upsert_into(store: KeyedStore, updates: DataFrame, order: str | None = None) -> int:
    """``upsert`` into a stored table: only the updated keys are written, and no other file is read or touched."""
    none = updates.limit(0)
    return store.write(upsert(none, updates, store.keys, order))


def reload_run(target: DataFrame, run: str, run_id: str, fresh: DataFrame, preserved: DataFrame | None = None, parent: DataFrame | None = None,
               parent_key: str | None = None) -> DataFrame:
    """Replace one run's rows; manual rows are kept where their parent still exists or they name none."""
    kept = target.filter(~c(run).eqNullSafe(F.lit(run_id)))
    out = kept.unionByName(fresh.select(*target.columns))
    if preserved is None:
        return out
    return out.unionByName(restore_preserved(preserved, parent, parent_key).select(*target.columns))


def snapshot_stats(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and time range of each table (frame, time column); a scope without rows is 'empty'."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time")).withColumn("table_name", F.lit(name))
             for name, (df, ts) in tables.items()]
    return union_all(*parts).withColumn("status", F.when(c("rows") > 0, "ok").otherwise("empty"))


def snapshot(tables: dict[str, tuple[DataFrame, str]], root: str, snapshot_id: str) -> DataFrame:
    """Archive the tables of a scope as Parquet folders under a snapshot id."""
    for name, (df, _) in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/snapshot_id={snapshot_id}")
    return snapshot_stats(tables)


def restore(spark: SparkSession, root: str, names: list[str], snapshot_id: str, stores: dict[str, Store]) -> dict[str, int]:
    """Make an archived snapshot current; what was current stays as an earlier version."""
    return {n: stores[n].write(spark.read.parquet(f"{root}/{n}/snapshot_id={snapshot_id}")) for n in names}


def clear_scope(tables: dict[str, DataFrame], scope: DataFrame, keys: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove a scope's rows from every table; ``scope`` has one column ``scope_id``. Also the removed counts."""
    kept, counts = {}, []
    for name, df in tables.items():
        ids = scope.select(c("scope_id").alias(keys[name])).distinct()
        kept[name] = df.join(ids, keys[name], "left_anti")
        counts.append(df.join(ids, keys[name], "left_semi").agg(F.count(F.lit(1)).alias("removed")).withColumn("table_name", F.lit(name)))
    return kept, union_all(*counts)


def combine_tables(snapshots: list[tuple[dict[str, DataFrame], str]], keys: dict[str, list[str]], order: dict[str, str]) -> dict[str, DataFrame]:
    """Newest row per entity over several snapshots, table by table."""
    return {n: combine_snapshots([(tables[n], sid) for tables, sid in snapshots], k, order[n]) for n, k in keys.items()}


def delete_run(tables: dict[str, DataFrame], run: str, run_ids: DataFrame, soft: str | None = None, now: Column | None = None) -> dict[str, DataFrame]:
    """Drop runs and their children; ``soft`` names the table that only gets a deletion time."""
    ids = run_ids.select(run).distinct()
    out = {}
    for name, df in tables.items():
        if name == soft:
            hit = ids.withColumn("_hit", F.lit(True))
            out[name] = df.join(hit, run, "left").withColumn("deleted_at", F.when(c("_hit"), F.coalesce("deleted_at", now)).otherwise(c("deleted_at"))).drop("_hit")
        else:
            out[name] = df.join(ids, run, "left_anti")
    return out


# --- manual entries --------------------------------------------------------

def _identity(df: DataFrame) -> DataFrame:
    return df.withColumns({"_b": F.lower("bssid"), "_t": c("survey_time")})


ENTRY = ["_r", "_b", "_t"]


def _entry(df: DataFrame) -> DataFrame:
    """Manual entries belong to one run's address and time."""
    return _identity(df).withColumn("_r", c("test_run_id"))


def latest_entries(entries: DataFrame) -> DataFrame:
    """The newest entry with a level of each run, address and time."""
    e = _entry(entries).groupBy(*ENTRY).agg(F.max_by(F.struct("survey_rssi_dbm", "survey_snr_db", "entered_at"), "entered_at").alias("_e"))
    return e.select(*ENTRY, "_e.*").filter(c("survey_rssi_dbm").isNotNull())


def _entered(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each entry's identity, beside the entry; entries without a candidate are errors and change nothing."""
    e = latest_entries(entries)
    best = top1(_entry(candidates).join(e.select(*ENTRY), ENTRY, "left_semi"), ENTRY, BEST)
    return best.join(e, ENTRY)


def apply_entries(entries: DataFrame, candidates: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enter a batch of manual levels: (candidates, matches) after it.

    The newest entry of an identity (run, address, time) counts. It replaces the
    match of that identity, is compared with the best candidate, and completes
    every candidate of the identity. ``apply_observations`` is the same step for
    the observations.
    """
    offset = case_map(c("band"), BAND_OFFSETS)
    made = _entered(entries, candidates)
    made = made.withColumn("vendor_offset_db", offset).withColumns(calibrated_delta(c("badge_rssi_dbm"), c("survey_rssi_dbm"), offset))
    made = made.withColumnRenamed("id", "candidate_match_id")
    m = _entry(matches).join(made.select(*ENTRY), ENTRY, "left_anti").drop(*ENTRY)
    new_matches = m.unionByName(made.drop(*ENTRY), allowMissingColumns=True)
    hit = made.select(*ENTRY, c("manual_entry_status").alias("_s"))
    new_candidates = _entry(candidates).join(hit, ENTRY, "left").withColumn("manual_entry_status", F.coalesce("_s", "manual_entry_status")).select(*candidates.columns)
    return new_candidates, new_matches.select(*matches.columns)


def apply_observations(entries: DataFrame, candidates: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations after a batch of manual levels: those of an entered identity give way to one row with the candidate's place and the new level."""
    made = _entered(entries, candidates).withColumnsRenamed({"survey_rssi_dbm": "rssi_dbm", "survey_snr_db": "snr_db"})
    kept = _entry(observations).join(made.select(*ENTRY), ENTRY, "left_anti").drop(*ENTRY)
    return kept.unionByName(made.drop(*ENTRY), allowMissingColumns=True).select(*observations.columns)


def reset_entries(keys: DataFrame, candidates: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo manual entries of identities (run, address, time): matches go, candidates become pending."""
    k = _entry(keys).select(*ENTRY).distinct()
    left = _entry(matches).join(k, ENTRY, "left_anti").select(*matches.columns)
    hit = k.withColumn("_hit", F.lit(True))
    back = _entry(candidates).join(hit, ENTRY, "left").withColumn(
        "manual_entry_status", F.when(c("_hit"), "pending").otherwise(c("manual_entry_status"))).select(*candidates.columns)
    return back, left


def reset_observations(keys: DataFrame, observations: DataFrame, matches_left: DataFrame, observation_id: str, reference: str) -> DataFrame:
    """Observations after a reset: those of the identities go, unless a match that is left refers to them."""
    k = _entry(keys).select(*ENTRY).distinct()
    used = matches_left.select(c(reference).alias(observation_id)).filter(c(observation_id).isNotNull()).distinct()
    gone = _entry(observations).join(k, ENTRY, "left_semi").select(observation_id).join(used, observation_id, "left_anti")
    return observations.join(gone, observation_id, "left_anti").select(*observations.columns)


def reconcile(candidates: DataFrame, matches: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring candidates, matches and observations together: (candidates, matches, counts per step).

    Attach matches to candidates by identity; build missing matches from
    observations and the best candidate; drop repeated and superseded pending
    candidates; complete the rest that have a match; then count what remains.
    Each step is written once because the next ones and its count read it.
    """
    steps: list[DataFrame] = []

    def note(action: str, df: DataFrame) -> None:
        steps.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(action).alias("action"), "row_count"))

    cand, m = _identity(candidates), _identity(matches)
    link = ["test_run_id", "_b", "_t", "badge_event_id", "badge_candidate_index"]
    found = cand.groupBy(*link).agg(F.min("id").alias("_cid"))
    m = checkpointed(m.join(found, link, "left").withColumn("_attach", c("candidate_match_id").isNull() & c("_cid").isNotNull())
                     .withColumn("candidate_match_id", F.coalesce("candidate_match_id", "_cid")).drop("_cid"))
    note("attached_completed_matches_to_candidates", m.filter("_attach"))
    m = m.drop("_attach")
    done = m.filter(c("manual_entry_status").isin(DONE)).select("_b", "_t").distinct()

    obs = _identity(observations).join(done, ["_b", "_t"], "left_anti")
    best = top1(cand.join(obs.select("_b", "_t").distinct(), ["_b", "_t"], "left_semi"), ["_b", "_t"], BEST)
    pair = best.join(obs.select("_b", "_t", c("id").alias("observation_id"), c("test_run_id").alias("_run"), "rssi_dbm", "created_at"), ["_b", "_t"])
    pick = F.max_by(F.struct("observation_id", "rssi_dbm"), F.struct((c("_run") == c("test_run_id")), c("created_at"), c("observation_id")))
    chosen = pair.groupBy("_b", "_t").agg(pick.alias("_o")).select("_b", "_t", "_o.*")
    offset = case_map(c("band"), BAND_OFFSETS)
    made = best.join(chosen, ["_b", "_t"]).withColumn("vendor_offset_db", offset).withColumn("survey_rssi_dbm", c("rssi_dbm"))
    made = made.withColumns(calibrated_delta(c("badge_rssi_dbm"), c("survey_rssi_dbm"), offset)).withColumnRenamed("id", "candidate_match_id").drop("rssi_dbm")
    made = checkpointed(made)
    note("inserted_missing_completed_matches_from_manual_observations", made)
    m2 = m.unionByName(made, allowMissingColumns=True)
    done = checkpointed(m2.filter(c("manual_entry_status").isin(DONE)).select("_b", "_t").distinct())
    used = m2.filter(c("candidate_match_id").isNotNull()).select(c("candidate_match_id").alias("id")).distinct()

    pending = c("manual_entry_status") == "pending"
    open_ = cand.filter(pending).join(done, ["_b", "_t"], "left_anti")
    keep_ids = top1(open_, ["_b", "_t"], BEST).select("id")
    repeated = checkpointed(open_.join(keep_ids, "id", "left_anti").join(used, "id", "left_anti").select("id"))
    note("deleted_duplicate_pending_candidates_by_timestamp", repeated)
    superseded = checkpointed(cand.filter(pending).join(done, ["_b", "_t"], "left_semi").join(used, "id", "left_anti").select("id"))
    note("deleted_unreferenced_duplicate_pending_candidates", superseded)
    cand = cand.join(repeated.unionByName(superseded), "id", "left_anti")
    hit = done.withColumn("_hit", F.lit(True))
    closes = pending & F.coalesce(c("_hit"), F.lit(False))
    cand = checkpointed(cand.join(hit, ["_b", "_t"], "left").withColumn("_closed", closes).withColumn(
        "manual_entry_status", F.when(closes, "complete").otherwise(c("manual_entry_status"))).drop("_hit"))
    note("marked_duplicate_pending_candidates_complete", cand.filter("_closed"))
    note("remaining_duplicate_pending_candidates", cand.filter(pending).join(done, ["_b", "_t"], "left_semi"))
    note("remaining_repeated_pending_timestamp_bssid_identities", cand.filter(pending).groupBy("_b", "_t").agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > 1))
    return cand.select(*candidates.columns), m2.select(*matches.columns), union_all(*steps)


def apply_reviews(streams: DataFrame, reviews: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Latest review of each stream: class, status and notes; blanks leave the stored value."""
    from tidewire.operators.windows import latest_by
    r = latest_by(reviews, keys, order).withColumnsRenamed({x: f"_{x}" for x in ("stream_classification", "review_status")})
    d = streams.join(r.select(*keys, "_stream_classification", "_review_status"), keys, "left")
    return d.withColumns({x: F.coalesce(f"_{x}", x) for x in ("stream_classification", "review_status")}).select(*streams.columns)


# --- checks ----------------------------------------------------------------

def quality_checks(name: str, df: DataFrame, *, unique: list[str] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None,
                   enums: dict[str, list[str]] | None = None, not_null: list[str] = (), one_open: tuple[list[str], Column] | None = None) -> DataFrame:
    """Violations of declared constraints as (table_name, check_name, violations)."""
    found: list[DataFrame] = []

    def add(check: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("table_name"), F.lit(check).alias("check_name"), "violations"))

    if unique:
        add("unique:" + ",".join(unique), df.groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > 1))
    for col, (parent, key) in (foreign or {}).items():
        ids = parent.select(c(key).alias(col)).distinct()
        add(f"foreign:{col}", df.filter(c(col).isNotNull()).join(ids, col, "left_anti"))
    if enums or not_null:
        tests = {f"enum:{col}": c(col).isNotNull() & ~c(col).isin(words) for col, words in (enums or {}).items()}
        tests.update({f"not_null:{col}": c(col).isNull() for col in not_null})
        counted = df.agg(*[count_where(cond).alias(check) for check, cond in tests.items()])
        items = F.array(*[F.struct(F.lit(check).alias("check_name"), c(f"`{check}`").alias("violations")) for check in tests])
        found.append(counted.select(F.explode(items).alias("_i")).select(F.lit(name).alias("table_name"), "_i.*"))
    if one_open:
        keys, is_open = one_open
        add("one_open:" + ",".join(keys), df.filter(is_open).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > 1))
    return union_all(*found)


def audit(raw: DataFrame, stored: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6,
          invariants: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """Findings of a stored table against its source: key multisets, values within a tolerance, invariants."""
    diff = compare_counters(raw, stored, keys).select(F.lit("key_count").alias("finding"), F.abs("difference").cast("bigint").alias("n"))
    one = stored.groupBy(*keys).agg(*[F.avg(v).alias(f"_{v}") for v in values])
    mine = raw.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])
    both = mine.join(one, keys)
    off = both.agg(*[count_where(F.coalesce(F.abs(c(v) - c(f"_{v}")) > tolerance, c(v).isNull() != c(f"_{v}").isNull())).alias(v) for v in values])
    items = F.array(*[F.struct(F.lit(f"value:{v}").alias("finding"), c(v).alias("n")) for v in values])
    parts = [diff.groupBy("finding").agg(F.sum("n").alias("n")), off.select(F.explode(items).alias("_i")).select("_i.*")]
    for check, rule in (invariants or {}).items():
        parts.append(stored.agg(count_where(~rule(stored)).alias("n")).select(F.lit(f"invariant:{check}").alias("finding"), "n"))
    return union_all(*parts).filter(c("n") > 0)


# --- template and correlation ---------------------------------------------

def build_candidates(points: DataFrame, events: DataFrame, candidates: DataFrame, radio: DataFrame, names: DataFrame, window: float, tz: str) -> DataFrame:
    """Template rows: each point's nearest event within the window, with that event's candidates, the nearest
    radio sample of the same channel (else any), and AP names."""
    from tidewire.operators.nearest import nearest_with_fallback
    near = nearest_join(points, events, ["test_run_id"], point_ts="survey_time", event_ts="event_time", event_id="event_id", tz=tz, window=window)
    near = near.select("test_run_id", "survey_point_id", "survey_time", c("nearest_id").alias("event_id"), c("nearest_ts").alias("badge_time"), c("nearest_delta").alias("time_delta_seconds"))
    rows = near.join(candidates, "event_id").withColumn("match_quality", match_quality(c("time_delta_seconds"), F.lit(window)))
    rows = rows.join(names.select("bssid", "ap_name"), "bssid", "left")
    samples = radio.select("test_run_id", c("sample_id").alias("_sid"), c("sample_time").alias("_st"), "channel", c("snr_db").alias("_snr"))
    return nearest_with_fallback(rows, samples, ["test_run_id"], "channel", point_ts="badge_time", event_ts="_st", event_id="_sid", value="_snr", own="snr_db")


def correlate(rows: DataFrame, observations: DataFrame, window: float, tz: str) -> DataFrame:
    """Template rows with manual values and deltas; rows off the local date or outside the window are dropped."""
    o = observations.groupBy("survey_point_id", "bssid", "survey_time").agg(
        F.max_by(F.struct("rssi_dbm", "snr_db", c("band").alias("_oband")), "observation_id").alias("_o")).select("survey_point_id", "bssid", "survey_time", "_o.*")
    d = rows.filter((local_date(c("badge_time"), tz) == local_date(c("survey_time"), tz)) & (F.abs("time_delta_seconds") <= window))
    d = d.join(o, ["survey_point_id", "bssid", "survey_time"], "left")
    d = d.withColumns({"survey_rssi_dbm": F.coalesce("survey_rssi_dbm", "rssi_dbm"), "survey_snr_db": F.coalesce("survey_snr_db", "snr_db"), "band": F.coalesce("band", "_oband")})
    offset = case_map(c("band"), BAND_OFFSETS)
    d = d.withColumn("vendor_offset_db", offset)
    return d.withColumns(calibrated_delta(c("badge_rssi_dbm"), c("survey_rssi_dbm"), c("vendor_offset_db"))).drop("rssi_dbm", "snr_db", "_oband")


def total_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [f.agg(F.count(F.lit(1)).alias("n")) for f in frames]).agg(F.sum("n").alias("n"))
