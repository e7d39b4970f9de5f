"""Packet-flow statistics over an ordered packet table.

Packets are ``(capture_id, pkt_no, arrival, src_ip, src_port, dst_ip, dst_port,
dscp, udp_length, rtp STRUCT<pt, marker, seq, ts, ssrc>)``; ``rtp`` is null when no
header was seen. A flow is the 4-tuple of a capture, a candidate the flow with
its ssrc and payload type.

Gaps, timestamp deltas and jitter are windows and sums. Sequence accounting is a
state machine, whose state before a packet is a few running figures if one knows
which packets it accepted: the greatest number so far, the start of the segment
and the last ignored packet. So packets get labels from a look at their
neighbours, windows carry the figures, and each label is checked against what
the state machine says. Labels that agree throughout are its exact result; wrong
ones are mended and checked again. Flows that are mostly noise, whose labels
don't settle in a few rounds, are walked block by block in Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.predicates import is_future
from tidewire.functions.scalars import direction, mac_hex, role_for
from tidewire.operators.aggregates import count_where, mode_first
from tidewire.operators.blocked import Order, heavy_keys, join_back, scan
from tidewire.operators.quantiles import percentiles
from tidewire.session import checkpointed

FLOW = ["capture_id", "src_ip", "src_port", "dst_ip", "dst_port"]
CANDIDATE = [*FLOW, "ssrc", "pt"]
ORDER = Order("arrival", ("pkt_no",))

# Sequence rules.
SEQ_MOD, MAX_DROPOUT, MAX_MISORDER, REACH = 65536, 3000, 100, 32768
TS_MOD, TS_HALF = 2**32, 2**31


@dataclass(frozen=True)
class FlowConfig:
    """Thresholds and vocabularies of flow analysis; the numbers are fixed values."""
    media_ports: tuple[tuple[int, int], ...] = ()
    clock_rates: dict[int, int] = field(default_factory=lambda: {0: 8000, 8: 8000})
    default_clock_hz: int = 8000
    require_known_clock: bool = False
    strict: bool = True
    min_packets: int = 20
    max_transit_delta: float = 1.0
    min_duration: float = 0.25
    max_gap_ms: float = 500.0
    max_jitter_ms: float = 500.0
    min_sequence_progress: float = 0.80
    min_timestamp_progress: float = 0.80
    max_wallclock_error_ms: float = 250.0
    packetization_ms: tuple[float, float] = (5.0, 100.0)
    max_loss: float = 0.50
    max_duplicate: float = 0.50
    max_out_of_order: float = 0.50
    expected_dscp: int | None = None
    server_ips: tuple[str, ...] = ()
    badge_cidrs: tuple[str, ...] = ()


def split_flows(packets: DataFrame, cfg: FlowConfig) -> DataFrame:
    """Packets on media ports, with their candidate key; packets without a header share a null key."""
    d = packets
    if cfg.media_ports:
        hit = F.lit(False)
        for lo, hi in cfg.media_ports:
            hit = hit | F.col("src_port").between(lo, hi) | F.col("dst_port").between(lo, hi)
        d = d.filter(hit)
    return d.withColumns({"ssrc": F.col("rtp.ssrc"), "pt": F.col("rtp.pt"), "seq": F.col("rtp.seq"), "rtp_ts": F.col("rtp.ts")})


def rtp_candidates(packets: DataFrame) -> DataFrame:
    """Packets with a header, counted per capture and flow."""
    return packets.filter(F.col("rtp").isNotNull()).groupBy(*FLOW).agg(F.count(F.lit(1)).alias("candidate_packets"))


def clock_rate(pt: Column, cfg: FlowConfig) -> tuple[Column, Column]:
    """Clock in Hz of a payload type, and whether it is a configured one."""
    table = F.create_map(*[F.lit(x) for pair in cfg.clock_rates.items() for x in pair])
    rate = F.element_at(table, pt)
    return F.coalesce(rate, F.lit(cfg.default_clock_hz)), rate.isNotNull()


def ts_delta(current: Column, previous: Column) -> Column:
    """Signed difference of 32-bit timestamps."""
    d = current - previous
    return F.when(d < -TS_HALF, d + TS_MOD).when(d > TS_HALF, d - TS_MOD).otherwise(d)


# --- sequence accounting ---------------------------------------------------

_STATE = "highest bigint, bad int, first bigint, seen binary, forward bigint"
FIRST, FORWARD, DUPLICATE, MISORDER, RESTART, IGNORED = range(6)


def _extend(seq: int, highest: int) -> int:
    cand = (highest & ~0xFFFF) + seq
    if cand - highest < -REACH:
        return cand + SEQ_MOD
    if cand - highest > REACH:
        return cand - SEQ_MOD
    return cand


def _walk(seqs, state):
    """Classify sequence numbers in order; state is (highest, bad, first, seen bits below highest, forward)."""
    highest, bad, first, seen, forward = state
    bits = int.from_bytes(seen, "little") if seen else 0  # bit k: highest - k was seen
    mask = (1 << (REACH + 1)) - 1
    rows = []
    for seq in seqs:
        seq = int(seq)
        ahead = False
        if forward is None:
            forward = seq
        else:
            cand = _extend(seq, forward)
            ahead = 0 < cand - forward <= MAX_DROPOUT
            forward = cand if ahead else forward
        if highest is None:
            highest, first, bits, bad = seq, seq, 1, None
            rows.append((FIRST, 0, highest, ahead))
            continue
        cand = _extend(seq, highest)
        diff = cand - highest
        if diff <= 0 and bits >> -diff & 1:
            rows.append((DUPLICATE, 0, cand, ahead))
        elif 0 < diff <= MAX_DROPOUT:
            bits = (bits << diff | 1) & mask
            highest, bad = cand, None
            rows.append((FORWARD, diff - 1, cand, ahead))
        elif -MAX_MISORDER <= diff < 0:
            bits |= 1 << -diff
            bad = None
            rows.append((MISORDER, -1 if first is None or cand > first else 0, cand, ahead))
        elif seq == bad:
            highest, first, bits, bad = seq, seq, 1, None
            rows.append((RESTART, 0, cand, ahead))
        else:
            bad = (seq + 1) % SEQ_MOD
            rows.append((IGNORED, 0, cand, ahead))
    if first is not None and first < highest - MAX_MISORDER:
        first = None  # later packets cannot reach below the start of this segment
    return rows, (highest, bad, first, bits.to_bytes(REACH // 8 + 1, "little"), forward)


def _state_in(states: pd.DataFrame):
    none = (None, None, None, None, None)
    if len(states) == 0 or pd.isna(states["highest"].iloc[0]):
        return none
    r = states.iloc[0]
    num = lambda x: None if pd.isna(x) else int(x)
    return num(r["highest"]), num(r["bad"]), num(r["first"]), r["seen"], num(r["forward"])


def _wrapped(difference: Column) -> Column:
    """A difference of two 16-bit numbers, moved by one turn if it is more than half a turn."""
    return F.when(difference < -REACH, difference + SEQ_MOD).when(difference > REACH, difference - SEQ_MOD).otherwise(difference)


def _guessed(slim: DataFrame, keys: list[str]) -> DataFrame:
    """First labels: a packet goes on from most of the five before it, or is ignored. Blocks are short of neighbours at their borders, which only costs a mended label."""
    near = Window.partitionBy(*keys, "_blk").orderBy("_no")
    steps = [_wrapped(F.col("seq") - F.lag("seq", k).over(near)) for k in range(1, 6)]
    told = F.filter(F.array(*steps), lambda d: d.isNotNull())
    good = F.size(F.filter(told, lambda d: (d >= -MAX_MISORDER) & (d <= MAX_DROPOUT)))
    label = F.when(F.col("_no") == 1, FIRST).when(2 * good >= F.size(told), FORWARD).otherwise(IGNORED)
    return slim.withColumn("_label", label)


def _judged(labelled: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """What the state machine says of each packet (seq_class, lost_change, ext_seq), if all packets before it have the right labels; ``_at`` numbers its segment."""
    c = F.col
    order = Order("_no")
    starts, line = c("_label").isin(FIRST, RESTART), c("_label").isin(FIRST, FORWARD, MISORDER, RESTART)
    d = labelled.withColumns({
        "_line": F.when(line, c("seq")), "_mark": F.when(c("_label") == IGNORED, (c("seq") + 1) % SEQ_MOD).when(line, -1), "_start": starts.cast("int")})
    d = scan(d, keys, order, ffill_before={"_pl": "_line", "_bad": "_mark"}, heavy=heavy)
    d = d.withColumn("_step", F.when(line & ~starts, _wrapped(c("seq") - c("_pl"))).otherwise(0))
    d = scan(d, keys, order, running={"_run": "_step", "_seg": "_start"}, heavy=heavy)
    d = d.withColumns({"_base0": F.when(starts, c("seq") - c("_run")), "_first0": F.when(starts, c("seq"))})
    d = scan(d, keys, order, ffill={"_base": "_base0"}, ffill_before={"_first": "_first0"}, heavy=heavy)
    d = d.withColumn("_peak", F.when(line, F.struct(c("_seg").alias("seg"), (c("_base") + c("_run")).alias("ext"))))
    d = scan(d, keys, order, peak_before={"_high": "_peak"}, heavy=heavy)
    diff = _wrapped(c("seq") - F.pmod("_high.ext", F.lit(SEQ_MOD)))
    d = d.select(*labelled.columns, "_bad", "_first", c("_high.seg").alias("_at"), diff.alias("_diff"), F.coalesce(c("_high.ext") + diff, c("seq")).cast("long").alias("_ext"))
    same = Window.partitionBy(*keys, "_at", "_ext").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = (c("_ext") == c("_first")) | (F.coalesce(F.max(c("_label").isin(FORWARD, MISORDER)).over(same), F.lit(False)))
    d = d.withColumn("_seen", seen)
    kind = (
        F.when(c("_no") == 1, FIRST).when((c("_diff") <= 0) & c("_seen"), DUPLICATE).when((c("_diff") > 0) & (c("_diff") <= MAX_DROPOUT), FORWARD)
        .when((c("_diff") < 0) & (c("_diff") >= -MAX_MISORDER), MISORDER).when(c("seq") == c("_bad"), RESTART).otherwise(IGNORED))
    d = d.withColumn("seq_class", kind)
    lost = F.when(c("seq_class") == FORWARD, c("_diff") - 1).when((c("seq_class") == MISORDER) & (c("_ext") > c("_first")), -1).otherwise(0)
    return d.select(*labelled.columns, "_at", "seq_class", lost.cast("long").alias("lost_change"), c("_ext").alias("ext_seq"))


def _settled(rows: DataFrame, keys: list[str], rounds: int, judge, label: str, kind: str, mend) -> tuple[list[DataFrame], DataFrame | None]:
    """Judged packets of the flows whose labels agree with the judgement, and the keys of the flows that are left after ``rounds``.

    ``mend`` makes new labels of the judged packets. All flows go on in parallel, and only those that still change.
    """
    done: list[DataFrame] = []
    while True:
        judged = checkpointed(judge(rows))
        open_flows = checkpointed(judged.filter(F.col(label) != F.col(kind)).select(*keys).distinct().withColumn("_open", F.lit(True)))
        if not open_flows.limit(1).count():
            return [*done, judged], None
        marked = join_back(judged, open_flows, keys)
        done.append(marked.filter(F.col("_open").isNull()).drop("_open"))
        rounds -= 1
        if not rounds:
            return done, open_flows.drop("_open")
        rows = mend(marked.filter("_open").drop("_open"))


def _classed(slim: DataFrame, keys: list[str], rounds: int, heavy: DataFrame | None) -> tuple[list[DataFrame], DataFrame | None]:
    """Classes of the packets. Of the labels that don't agree, the first one in each short block of packets is mended, since those after it may have been judged by it;
    one that changes no figure but the count of repeats is mended at once."""
    c = F.col

    def mend(judged: DataFrame) -> DataFrame:
        harmless = c("_label").isin(FORWARD, MISORDER, DUPLICATE) & c("seq_class").isin(FORWARD, MISORDER, DUPLICATE)
        block = Window.partitionBy(*keys, "_blk", F.floor(c("_no") / 256))
        fixed = judged.withColumn("_fix", F.min(F.when((c("_label") != c("seq_class")) & ~harmless, c("_no"))).over(block))
        return fixed.withColumn("_label", F.when(harmless | (c("_no") <= c("_fix")), c("seq_class")).otherwise(c("_label"))).select(*slim.columns, "_label")

    return _settled(_guessed(slim, keys), keys, rounds, lambda d: _judged(d, keys, heavy), "_label", "seq_class", mend)


def _progressed(classed: DataFrame, keys: list[str], rounds: int, heavy: DataFrame | None) -> tuple[list[DataFrame], DataFrame | None]:
    """``classed`` with ``progressed``: whether a packet is up to the allowed gap ahead of the last one that was.

    That is a state machine of its own, which knows no restarts. Up to a flow's first restart it goes with the forward class; flows without one are done.
    """
    c = F.col
    forward = c("seq_class") == FORWARD
    restarted = checkpointed(classed.filter(c("seq_class") == RESTART).select(*keys).distinct().withColumn("_again", F.lit(True)))
    marked = join_back(classed, restarted, keys)
    plain = marked.filter(c("_again").isNull()).drop("_again").withColumn("progressed", forward)
    rows = marked.filter("_again").drop("_again").withColumn("_ahead", forward & (c("_at") <= 1))

    def judge(d: DataFrame) -> DataFrame:
        d = scan(d.withColumn("_led", F.when(c("_ahead") | (c("_no") == 1), c("seq"))), keys, Order("_no"), ffill_before={"_pa": "_led"}, heavy=heavy)
        step = _wrapped(c("seq") - c("_pa"))
        return d.withColumn("progressed", F.coalesce((c("_no") > 1) & (step > 0) & (step <= MAX_DROPOUT), F.lit(False))).drop("_led", "_pa")

    def mend(d: DataFrame) -> DataFrame:
        # a segment that has come within reach of the last one goes on from there
        d = scan(d.withColumn("_hit", F.when(c("progressed"), c("_at"))), keys, Order("_no"), ffill_before={"_joined": "_hit"}, heavy=heavy)
        joined = forward & c("_joined").eqNullSafe(c("_at")) & (c("_at") > 1)
        return d.withColumn("_ahead", c("progressed") | joined).drop("_hit", "_joined", "progressed")

    if not restarted.limit(1).count():
        return [plain], None
    done, left = _settled(rows, keys, rounds, judge, "_ahead", "progressed", mend)
    return [plain, *done], left


def sequence_scan(packets: DataFrame, keys: list[str] = CANDIDATE, order: Order = ORDER, block_packets: int = 65536, rounds: int = 3) -> DataFrame:
    """Packets of candidates with ``seq_class``, ``lost_change``, ``ext_seq`` and ``progressed``.

    Windows judge all flows whose labels settle within ``rounds``, whatever their length. The others, mostly noise, are walked in Python: a flow of up to
    ``block_packets`` packets is one block; longer flows are repeated block by block until no incoming state changes.
    The driver sees only whether flows are left.
    """
    numbered = scan(packets, keys, order, number="_no")
    slim = checkpointed(numbered.select(*keys, "_no", F.col("seq").cast("int").alias("seq"), F.floor(F.col("_no") / 4096).alias("_blk")))
    result = ["seq_class", "lost_change", "ext_seq", "progressed"]
    heavy = heavy_keys(slim, keys)
    classed, noisy = _classed(slim, keys, rounds, heavy)
    done, stuck = _progressed(reduce(DataFrame.unionByName, classed), keys, rounds, heavy)
    parts = [d.select(*keys, "_no", *result) for d in done]
    for flows in (noisy, stuck):
        if flows is not None:
            rows = join_back(slim, flows.withColumn("_left", F.lit(True)), keys).filter("_left").select(*keys, "_no", "seq")
            parts.append(_walked(rows, keys, block_packets).select(*keys, "_no", *result))
    return join_back(numbered, reduce(DataFrame.unionByName, parts), [*keys, "_no"]).drop("_no")


def _walked(numbered: DataFrame, keys: list[str], block_packets: int) -> DataFrame:
    """The state machine over blocks of flows, in Python."""
    numbered = numbered.withColumn("_part", F.floor((F.col("_no") - 1) / F.lit(block_packets)))
    parts = [*keys, "_part"]
    slim = numbered.select(*parts, "_no", "seq")
    kinds = dict(slim.dtypes)
    key_ddl = ", ".join(f"`{k}` {kinds[k]}" for k in parts)
    row_ddl = f"{key_ddl}, _no bigint, seq_class int, lost_change bigint, ext_seq bigint, progressed boolean"

    def states_of(pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 0:
            return pd.DataFrame(columns=[*parts, "highest", "bad", "first", "seen", "forward"])
        _, out = _walk(pdf.sort_values("_no")["seq"], _state_in(st))
        row = pdf[parts].iloc[:1].copy()
        for name, value in zip(("highest", "bad", "first", "seen", "forward"), out):
            row[name] = pd.Series([value], index=row.index, dtype=object)
        return row

    def rows_of(pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 0:
            return pd.DataFrame(columns=[*parts, "_no", "seq_class", "lost_change", "ext_seq", "progressed"])
        pdf = pdf.sort_values("_no")
        rows, _ = _walk(pdf["seq"], _state_in(st))
        out = pdf[[*parts, "_no"]].reset_index(drop=True)
        out[["seq_class", "lost_change", "ext_seq", "progressed"]] = pd.DataFrame(rows, columns=["seq_class", "lost_change", "ext_seq", "progressed"])
        return out

    def run(rows: DataFrame, states: DataFrame, fn, ddl: str) -> DataFrame:
        return rows.groupBy(*parts).cogroup(states.groupBy(*parts)).applyInPandas(fn, ddl)

    state_ddl = f"{key_ddl}, {_STATE}"
    spark = numbered.sparkSession
    empty = spark.createDataFrame([], state_ddl)
    long_flows = numbered.filter(F.col("_part") > 0).select(*keys).distinct()
    long_rows = slim.join(long_flows, keys, "left_semi")
    incoming = empty
    if long_flows.limit(1).count():
        long_rows = checkpointed(long_rows)
        outgoing = checkpointed(run(long_rows, empty, states_of, state_ddl))
        along = Window.partitionBy(*keys).orderBy("_part")
        fields = ["highest", "bad", "first", "seen", "forward"]
        while True:
            handed = outgoing.select(*parts, F.lag(F.struct(*fields)).over(along).alias("_in")).filter(F.col("_in").isNotNull()).select(*parts, "_in.*")
            old = incoming.select(*parts, F.struct(*fields).alias("_old"))
            fresh = join_back(handed.withColumn("_new", F.struct(*fields)), old, parts).filter(~F.col("_new").eqNullSafe(F.col("_old")))
            todo = checkpointed(fresh.select(*parts, *fields))
            if todo.limit(1).count() == 0:
                break
            again = run(long_rows.join(todo.select(*parts), parts, "left_semi"), todo, states_of, state_ddl)
            outgoing = checkpointed(outgoing.join(todo.select(*parts), parts, "left_anti").unionByName(again))
            incoming = checkpointed(incoming.join(todo.select(*parts), parts, "left_anti").unionByName(todo))
    return run(slim, incoming, rows_of, row_ddl)


def sequence_stats(scanned: DataFrame, keys: list[str] = CANDIDATE) -> DataFrame:
    """Expected, lost, duplicate and out-of-order packets per flow."""
    k = F.col("seq_class")
    g = scanned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), count_where(k.isin(FIRST, FORWARD, MISORDER, RESTART)).alias("_valid"),
        F.sum("lost_change").alias("lost_packets"), count_where(k == DUPLICATE).alias("duplicate_packets"),
        count_where(k == MISORDER).alias("out_of_order_packets"), count_where(k == RESTART).alias("restarts"))
    return g.withColumn("expected_packets", F.col("_valid") + F.col("lost_packets")).drop("_valid")


# --- timing ----------------------------------------------------------------

def gap_stats(packets: DataFrame, keys: list[str], order: Order = ORDER) -> DataFrame:
    """p50 and p95 (nearest rank) and the greatest of the non-negative gaps, in ms."""
    d = scan(packets, keys, order, lag={"_prev": "arrival"})
    gap = (F.col("arrival") - F.col("_prev")) * 1000
    d = d.withColumn("_gap", F.when(gap >= 0, gap)).select(*keys, "_gap")
    p = percentiles(d, keys, {"interarrival_p50_ms": ("_gap", 0.5, "nearest"), "interarrival_p95_ms": ("_gap", 0.95, "nearest")})
    return join_back(d.groupBy(*keys).agg(F.max("_gap").alias("interarrival_max_ms")), p, keys)


def with_deltas(packets: DataFrame, keys: list[str], cfg: FlowConfig, order: Order = ORDER) -> DataFrame:
    """Arrival, timestamp and transit differences to the packet before."""
    hz, known = clock_rate(F.col("pt"), cfg)
    d = packets.withColumns({"clock_hz": hz, "clock_known": known})
    d = d.withColumn("_transit", F.col("arrival") - F.col("rtp_ts") / F.col("clock_hz"))
    d = scan(d, keys, order, lag={"_pa": "arrival", "_pt": "rtp_ts", "_ptr": "_transit"}, number="packet_index")
    return d.withColumns({
        "arrival_delta": F.col("arrival") - F.col("_pa"), "rtp_delta": ts_delta(F.col("rtp_ts"), F.col("_pt")),
        "transit_delta": F.col("_transit") - F.col("_ptr")}).drop("_pa", "_pt", "_ptr", "_transit")


def jitter_ms(deltas: DataFrame, keys: list[str], cfg: FlowConfig, order: Order = ORDER) -> DataFrame:
    """Smoothed transit jitter: the sum of |D|/16 * (15/16)^(kept deltas after it).

    That is the running filter J += (|D| - J)/16 written out, so it needs only
    each kept delta's rank. Deltas above the transit limit are skipped.
    """
    keep = F.abs("transit_delta") <= cfg.max_transit_delta
    d = deltas.select(*keys, order.col, *order.ties, F.when(keep, F.abs("transit_delta")).alias("_d"))
    d = d.withColumn("_k", F.col("_d").isNotNull().cast("int"))
    d = scan(d, keys, order, running={"_rank": "_k"})
    totals = d.groupBy(*keys).agg(F.sum("_k").alias("_kept"))
    j = join_back(d, totals, keys)
    term = F.col("_d") / 16 * F.pow(F.lit(15.0 / 16.0), F.col("_kept") - F.col("_rank"))
    return j.groupBy(*keys).agg((F.coalesce(F.sum(term), F.lit(0.0)) * 1000).alias("jitter_ms"))


def debug_packets(packets: DataFrame, keys: list[str], cfg: FlowConfig, limit: int = 20) -> DataFrame:
    """Timing of the first packets of each flow; the others are dropped before their differences are taken, on the map side too."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER.columns()))
    first = packets.withColumn("_turn", turn).filter(F.col("_turn") <= max(0, limit)).drop("_turn")
    d = with_deltas(first, keys, cfg)
    return d.select(*keys, "packet_index", "arrival", "seq", "rtp_ts", (F.col("arrival_delta") * 1000).alias("arrival_delta_ms"),
                    (F.col("rtp_delta") / F.col("clock_hz") * 1000).alias("rtp_delta_ms"))


# --- plausibility and streams ---------------------------------------------

def plausibility(candidates: DataFrame, cfg: FlowConfig, keys: list[str] = CANDIDATE, block_packets: int = 65536) -> DataFrame:
    """Per candidate: sequence, timing and jitter figures, sorted reject reasons, acceptance.

    The classified packets are read by several aggregates, so they are written once.
    """
    scanned = sequence_scan(candidates, keys, block_packets=block_packets)
    d = with_deltas(scanned, keys, cfg)
    moved = F.col("progressed") & (F.col("rtp_delta") > 0)
    step = F.col("rtp_delta") / F.col("clock_hz")
    d = d.withColumns({"_err": F.when(moved, F.abs(F.col("arrival_delta") - step) * 1000), "_step": F.when(moved, step * 1000)})
    d = checkpointed(d.select(*keys, "arrival", "pkt_no", "seq", "rtp_ts", "progressed", "seq_class", "lost_change", "clock_known",
                              "transit_delta", "_err", "_step", moved.alias("_moved")))
    base = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packet_count"), F.min("arrival").alias("first_seen"), F.max("arrival").alias("last_seen"),
        F.min("clock_known").alias("clock_known"), count_where(F.col("progressed")).alias("_fwd"), count_where(F.col("_moved")).alias("_tsfwd"),
        F.count_distinct("seq").alias("_seqs"), F.count_distinct("rtp_ts").alias("_tss"))
    parts = [sequence_stats(d, keys).drop("packets"), gap_stats(candidates, keys), jitter_ms(d, keys, cfg),
             percentiles(d, keys, {"wallclock_error_ms": ("_err", 0.95, "nearest"), "packetization_ms": ("_step", 0.5, "nearest")})]
    for part in parts:
        base = join_back(base, part, keys)
    c = F.col
    r = base.withColumns({
        "duration": c("last_seen") - c("first_seen"),
        "loss_ratio": F.coalesce(F.try_divide(c("lost_packets"), c("expected_packets")), F.lit(0.0)),
        "duplicate_ratio": c("duplicate_packets") / c("packet_count"), "out_of_order_ratio": c("out_of_order_packets") / c("packet_count"),
        "sequence_progress": F.coalesce(F.try_divide(c("_fwd"), c("packet_count") - 1), F.lit(0.0)),
        "timestamp_progress": F.coalesce(F.try_divide(c("_tsfwd"), c("_fwd")), F.lit(0.0))})
    lo, hi = cfg.packetization_ms
    rules = {
        "too_few_packets": c("packet_count") < cfg.min_packets,
        "duration_too_short": (c("duration") <= 0) | (c("duration") < cfg.min_duration),
        "unknown_clock_rate": F.lit(cfg.require_known_clock) & ~c("clock_known"),
        "sequence_not_progressing": c("sequence_progress") < cfg.min_sequence_progress,
        "timestamp_not_progressing": c("timestamp_progress") < cfg.min_timestamp_progress,
        "timestamp_wallclock_mismatch": c("wallclock_error_ms") > cfg.max_wallclock_error_ms,
        "packetization_implausible": (c("packetization_ms") < lo) | (c("packetization_ms") > hi),
        "interarrival_gap_too_large": c("interarrival_p95_ms") > cfg.max_gap_ms,
        "loss_ratio_implausible": c("loss_ratio") > cfg.max_loss,
        "duplicate_ratio_implausible": c("duplicate_ratio") > cfg.max_duplicate,
        "out_of_order_ratio_implausible": c("out_of_order_ratio") > cfg.max_out_of_order,
        "jitter_implausible": c("jitter_ms") > cfg.max_jitter_ms}
    reasons = F.array_sort(F.filter(F.array(*[F.when(cond, name) for name, cond in rules.items()]), lambda x: x.isNotNull()))
    legacy = (c("packet_count") >= cfg.min_packets) & (c("_seqs") >= max(2, cfg.min_packets // 2)) & (c("_tss") >= 2)
    r = r.withColumn("reasons", reasons)
    return r.withColumn("plausible", F.size("reasons") == 0 if cfg.strict else legacy).drop("_fwd", "_tsfwd", "_seqs", "_tss")


def packet_rate(count: Column, first: Column, last: Column) -> Column:
    return F.when(last > first, count / (last - first))


def stream_stats(packets: DataFrame, keys: list[str], cfg: FlowConfig) -> DataFrame:
    """Counts, bytes, first-seen mode of the marking, rate, mismatch flag, roles and direction per stream."""
    g = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("packet_count"), F.sum("udp_length").alias("byte_count"), F.min("arrival").alias("first_seen"),
                                   F.max("arrival").alias("last_seen"))
    numbered = packets.withColumn("_at", F.struct("arrival", "pkt_no"))
    d = join_back(g, mode_first(numbered, keys, "dscp", "_at", out="dscp"), keys)
    src, dst = (role_for(F.col(x), list(cfg.server_ips), list(cfg.badge_cidrs)) for x in ("src_ip", "dst_ip"))
    mismatch = F.lit(False) if cfg.expected_dscp is None else F.col("dscp") != cfg.expected_dscp
    return d.withColumns({"packet_rate_pps": packet_rate(F.col("packet_count"), F.col("first_seen"), F.col("last_seen")), "dscp_mismatch": mismatch,
                          "src_role": src, "dst_role": dst, "direction": direction(src, dst)})


def classify_streams(packets: DataFrame, cfg: FlowConfig, block_packets: int = 65536) -> DataFrame:
    """Streams of a capture: accepted candidates are RTP; rejected ones keep timing figures and their reasons;
    packets without a header form timing-only streams, a single such packet an unknown one."""
    routed = split_flows(packets, cfg)
    cand, other = routed.filter(F.col("rtp").isNotNull()), routed.filter(F.col("rtp").isNull())
    judged = plausibility(cand, cfg, block_packets=block_packets)
    quality = ["expected_packets", "lost_packets", "duplicate_packets", "out_of_order_packets", "loss_ratio", "jitter_ms"]
    ok = F.col("plausible")
    cols = [*CANDIDATE, *[F.when(ok, F.col(q)).alias(q) for q in quality], "interarrival_p50_ms", "interarrival_p95_ms", "interarrival_max_ms",
            F.when(ok, "rtp").otherwise("rtp_candidate_rejected").alias("measurement_mode"),
            F.when(ok, F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("rejection_reasons"), "clock_known"]
    a = join_back(stream_stats(cand, CANDIDATE, cfg), judged.select(*cols), CANDIDATE)
    b = join_back(stream_stats(other, FLOW, cfg), gap_stats(other, FLOW), FLOW).withColumns({
        "measurement_mode": F.when(F.col("packet_count") > 1, "udp_interarrival_only").otherwise("unknown_udp"),
        "rejection_reasons": F.array().cast("array<string>"), "clock_known": F.lit(True)})
    return a.unionByName(b, allowMissingColumns=True)


def capture_summary(packets: DataFrame, read_counts: DataFrame, now: Column, skew: float = 300.0) -> DataFrame:
    """Per capture: packets read and kept, last time, future outliers; all-future captures fail."""
    late = is_future(F.timestamp_micros((F.col("arrival") * 1e6).cast("bigint")), now, skew)
    g = packets.groupBy("capture_id").agg(count_where(~late).alias("udp_packets_seen"), count_where(late).alias("future_packets"),
                                          F.max(F.when(~late, F.col("arrival"))).alias("last_arrival"))
    d = read_counts.join(g, "capture_id", "left")
    d = d.withColumns({k: F.coalesce(F.col(k), F.lit(0)) for k in ("udp_packets_seen", "future_packets")})
    failed = (F.col("future_packets") > 0) & (F.col("udp_packets_seen") == 0)
    return d.withColumns({"success": ~failed, "error": F.when(failed, "all packet timestamps are in the future")})


#: An address in a path: twelve hexadecimal digits, alone or in pairs with separators.
PATH_MAC = r"(?i)((?:[0-9a-f]{2}[:._-]?){5}[0-9a-f]{2})"


def device_labels(streams: DataFrame, devices: DataFrame, path: str | None = None) -> DataFrame:
    """Primary device is the source's, else the destination's; a peer exists when both ends are known.

    Where neither end is known and ``path`` names the column of the capture's path, the device whose MAC (column ``mac``) stands in the
    path is the primary one.
    """
    def side(p: str) -> DataFrame:
        return devices.select(F.col("ip").alias(f"{p}_ip"), F.struct("name", "role", "config").alias(f"_{p}"))

    d = streams.join(side("src"), "src_ip", "left").join(side("dst"), "dst_ip", "left")
    main = F.coalesce("_src", "_dst")
    if path:
        inside = mac_hex(F.regexp_extract(path, PATH_MAC, 1))
        by_mac = devices.select(mac_hex(F.col("mac")).alias("_mac"), F.struct("name", "role", "config").alias("_m")).filter(F.length("_mac") == 12)
        by_mac = by_mac.groupBy("_mac").agg(F.min("_m").alias("_path"))
        d = d.withColumn("_mac", inside).join(by_mac, "_mac", "left").drop("_mac")
        main = F.coalesce("_src", "_dst", "_path")
    peer = F.when(F.col("_src").isNotNull() & F.col("_dst").isNotNull(), F.col("_dst"))
    names = {}
    for part in ("name", "role", "config"):
        names[f"device_{part}"] = F.coalesce(main[part], F.lit("unmapped"))
        names[f"peer_device_{part}"] = F.coalesce(peer[part], F.lit("unmapped"))
    return d.withColumns(names).drop("_src", "_dst", "_path")


def observation_rows(snapshots: DataFrame, items: str, manifest_phase: str = "phase", default_ip: str = "receiver_ip") -> DataFrame:
    """Observations inside snapshots as rows with stable ids; blank fields take the snapshot's values."""
    from tidewire.functions.scalars import stable_id
    d = snapshots.select("*", F.posexplode(items).alias("item_index", "_it")).drop(items)
    ident = stable_id(F.col("attempt_id"), F.col("snapshot_id"), F.col("item_index"), F.col("_it.evidence_source"), F.col("_it.group_ip"), F.col("_it.mgid"), F.col("_it.receiver_mac"))
    blank = lambda x, y: F.coalesce(F.nullif(x, F.lit("")), y)
    return d.select(ident.alias("observation_id"), "attempt_id", "snapshot_id", "item_index", "observed_at",
                    blank(F.col("_it.phase"), F.col(manifest_phase)).alias("phase"), blank(F.col("_it.receiver_ip"), F.col(default_ip)).alias("receiver_ip"),
                    F.col("_it.evidence_source").alias("evidence_source"), F.col("_it.group_ip").alias("group_ip"), F.col("_it.mgid").alias("mgid"))
