import datetime as dt
import random
import re
import uuid

import pytest
from tablerows import rows
from pyspark.sql import functions as F

from tidewire.plans.maintenance import BatchLog, KeyedStore, reconcile, upsert_into
from tidewire.streaming import jobs as X

SCHEMA = "id long, k string, ts timestamp, v double"


def many_files(spark, tmp_path, n=6, shuffled=False):
    """Input in several files, one micro-batch each, in time order or not."""
    rnd = random.Random(5)
    src = tmp_path / f"in-{uuid.uuid4().hex}"
    t, rows_ = dt.datetime(2024, 1, 1), []
    for i in range(n):
        part = []
        for j in range(20):
            t += dt.timedelta(seconds=rnd.randint(1, 60))
            part.append((i * 20 + j, rnd.choice(["hot", "hot", "a", "b"]), t, float(rnd.randint(0, 30))))
        rows_ += part
    files = list(rows_)
    if shuffled:
        rnd.shuffle(files)
    for i in range(n):
        spark.createDataFrame(files[i * 20 : i * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    return stream, spark.createDataFrame(rows_, SCHEMA)


@pytest.mark.parametrize("shuffled", [False, True])
def test_counter_stream_equals_batch(spark, tmp_path, shuffled):
    stream, batch = many_files(spark, tmp_path, shuffled=shuffled)
    state, sink = KeyedStore(spark, f"{tmp_path}/s", ["k"]), BatchLog(spark, f"{tmp_path}/o")
    X.stream_rate_increments(stream, f"{tmp_path}/c", state, sink, ["k"], "ts", "v", "id").awaitTermination()
    want = X.counter_increments(batch, ["k"], "ts", "v", "id")
    assert rows(sink.latest(["k", "ts", "id"]), "id", "increment") == rows(want, "id", "increment")
    assert len(state.versions()) > 1


@pytest.mark.parametrize("shuffled", [False, True])
def test_stability_stream_equals_batch(spark, tmp_path, shuffled):
    stream, batch = many_files(spark, tmp_path, shuffled=shuffled)
    sig = F.floor(F.col("v") / 15).alias("sig")
    state, sink = KeyedStore(spark, f"{tmp_path}/s", ["k"]), BatchLog(spark, f"{tmp_path}/o")
    X.stream_stability(stream.select("id", "k", "ts", sig), f"{tmp_path}/c", state, sink, "k", "ts", ["sig"], 60.0, "id").awaitTermination()
    want = X.stability_decisions(batch.select("id", "k", "ts", sig), "k", "ts", ["sig"], 60.0, tie="id")
    assert rows(sink.latest(["k", "ts", "id"]), "k", "ts", "decision") == rows(want, "k", "ts", "decision")


def test_latest_and_replay(spark, tmp_path):
    stream, batch = many_files(spark, tmp_path)
    state = KeyedStore(spark, f"{tmp_path}/s", ["k"])
    X.stream_latest(stream, f"{tmp_path}/c", state, ["k"], "ts", "id").awaitTermination()
    want = batch.groupBy("k").agg(F.max("id").alias("id"))
    assert rows(state.read(), "k", "id") == rows(want, "k", "id")
    log = BatchLog(spark, f"{tmp_path}/log")
    log.write(batch, 0)
    log.write(X.idempotent_append(batch, log.read(except_batch=0), ["id"]), 0)  # the same batch again
    assert log.read().count() == batch.count()


def size_of(store, names):
    return sum(store._fs.getContentSummary(store._folder(n)).getLength() for n in names)


def test_keyed_store_writes_what_changes(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/t", ["k"], buckets=8)
    frame = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "k long, v string").select("k", F.concat("v", F.sha2(F.concat("v", F.col("k").cast("string")), 512)).alias("v"))
    store.write(frame(range(20_000), "old"), version=0)
    before = set(store._held(None))
    first = {f.getPath().toString(): f.getModificationTime() for n in before for f in store._fs.listStatus(store._folder(n))}
    store.write(frame(range(0, 20_000, 100), "new"), version=1)
    assert store._held(None)[-1] == "v00000001" and size_of(store, ["v00000001"]) < 0.03 * size_of(store, before)
    assert first == {f.getPath().toString(): f.getModificationTime() for n in before for f in store._fs.listStatus(store._folder(n))}
    now = {r["k"]: r["v"][:3] for r in store.read().collect()}
    assert len(now) == 20_000 and all((v == "new") == (k % 100 == 0) for k, v in now.items())
    assert {r["v"][:3] for r in store.read(at_most=0).collect()} == {"old"}
    one = store.read(among=frame([300, 301, -5], "x"))
    assert rows(one.select("k", F.substring("v", 1, 3).alias("v"))) == [(300, "new"), (301, "old")]
    assert re.search(r"PartitionFilters: \[[^]]*_bucket", one._jdf.queryExecution().toString())  # other buckets are not opened
    upsert_into(store, frame([7, 30_000], "up"))
    assert {r["v"][:2] for r in store.read(among=frame([7, 30_000], "x")).collect()} == {"up"} and store.read().count() == 20_001


def test_keyed_store_merges_and_replays(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/t", ["k"], buckets=4)
    assert store.read() is None
    want = {}
    for n in range(12):
        part = {(None if i == 3 else i): n for i in range(n % 5, n % 5 + 4)}
        for _ in range(2):  # every version is written twice, as a replayed batch would
            store.write(spark.createDataFrame([(k, v) for k, v in part.items()], "k long, v long"), version=n + 1)
        assert dict(map(tuple, store.read(at_most=n).collect())) == want if n else store.read(at_most=0) is None
        want |= part
        assert dict(map(tuple, store.read().collect())) == want
        assert dict(map(tuple, store.read(among=spark.createDataFrame([(None,), (2,)], "k long")).collect())) == {k: v for k, v in want.items() if k in (None, 2)}
    assert any(n.startswith("b") for n in store._held(None)) and len(store._held(None)) < 8
    store.write(spark.createDataFrame([], "k long, v long"))
    assert dict(map(tuple, store.read().collect())) == want


def test_ingest_reads_the_ledger_only(spark, tmp_path):
    stream, batch = many_files(spark, tmp_path)
    log = BatchLog(spark, f"{tmp_path}/log")
    log.write(batch.filter("id < 30"), 77)  # rows from before there was a ledger
    for run in (1, 2):
        X.ingest_new(stream, f"{tmp_path}/c{run}", log, ["id"], run).awaitTermination()
    assert rows(log.read(), "id") == [(i,) for i in sorted(range(120), key=lambda i: (False, str(i)))]
    ledger = KeyedStore(spark, f"{log.root}-keys", ["id"], 64)
    assert ledger.read().columns == ["id"] and ledger.read().count() == 120


def test_stability_decision_table(spark):
    t0 = dt.datetime(2024, 1, 1)
    looks = [(0, 10), (5, 10), (25, 10), (30, 11), (40, 11), (51, 11)]
    d = spark.createDataFrame([("f", t0 + dt.timedelta(seconds=s), z) for s, z in looks], "p string, ts timestamp, size int")
    got = X.stability_decisions(d, "p", "ts", ["size"], 20.0).orderBy("ts").collect()
    assert [r["decision"] for r in got] == ["wait_new", "wait_too_soon", "ready", "wait_changed", "wait_too_soon", "ready"]


def test_alert_hold_and_no_data(spark):
    t0 = dt.datetime(2024, 1, 1)
    vals = [(0, 0.9), (60, 0.5), (360, 0.4), (390, 0.9), (420, None), (800, None)]
    d = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=s), v) for s, v in vals], "k string, ts timestamp, v double")
    got = X.alerts(d, ["k"], "ts", "v", 0.8, 300.0).orderBy("ts").collect()
    assert [r["state"] for r in got] == ["normal", "pending", "firing", "normal", "pending", "firing"]


def test_open_intervals(spark):
    t0 = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("s", i, t0 + dt.timedelta(minutes=i), e) for i, e in enumerate(["stop", "start", "stop", "start", "start", "note", "stop", "start"])], "k string, id long, ts timestamp, e string")
    got = X.open_intervals(d, ["k"], "ts", F.col("e") == "start", F.col("e") == "stop", "id")
    assert rows(got, "start_id", "status") == [(1, "closed"), (3, "violation"), (4, "closed"), (7, "open")]


def test_reconcile_is_idempotent(spark):
    t0 = dt.datetime(2024, 1, 1)
    cand = spark.createDataFrame([(1, "r", "aa", t0, True, 5.0, -40.0, "5GHz", 1, 0, "pending"), (2, "r", "AA", t0, False, 9.0, -30.0, "5GHz", 1, 1, "pending"), (3, "r", "bb", t0, False, 1.0, -50.0, "5GHz", 2, 0, "pending"),
                                  (4, "r", "bb", t0, False, 2.0, -50.0, "5GHz", 2, 1, "pending")], "id long, test_run_id string, bssid string, survey_time timestamp, badge_selected boolean, badge_score double, badge_rssi_dbm double, "
                                                                                                 "band string, badge_event_id long, badge_candidate_index int, manual_entry_status string")
    m = spark.createDataFrame([], "candidate_match_id long, test_run_id string, bssid string, survey_time timestamp, badge_event_id long, badge_candidate_index int, band string, badge_rssi_dbm double, survey_rssi_dbm double, "
                                  "vendor_offset_db double, calibrated_delta_db double, manual_entry_status string")
    obs = spark.createDataFrame([(7, "r", "aa", t0, -35.0, t0)], "id long, test_run_id string, bssid string, survey_time timestamp, rssi_dbm double, created_at timestamp")
    c1, m1, s1 = reconcile(cand, m, obs)
    counts = {r["action"]: r["row_count"] for r in s1.collect()}
    assert counts["inserted_missing_completed_matches_from_manual_observations"] == 1 and counts["deleted_duplicate_pending_candidates_by_timestamp"] == 1
    assert rows(c1, "id", "manual_entry_status") == [(1, "complete"), (4, "pending")] and rows(m1, "candidate_match_id", "calibrated_delta_db") == [(1, 3.0)]
    c2, m2, s2 = reconcile(c1, m1, obs)
    assert sum(r["row_count"] for r in s2.collect()) == 0 and rows(c2, "id") == rows(c1, "id")
