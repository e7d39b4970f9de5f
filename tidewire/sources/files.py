"""Readers and writers of evidence files and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.scalars import (band_from_channel, band_from_frequency, band_from_text, ft_state, json_value, nullif_trim, normalize_mac,
                                        parse_rate, parse_timestamp_variants, seconds_from, strip_domain)
from tidewire.operators.blocked import join_back
from tidewire.session import checkpointed

c = F.col


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzip text with file name and 1-based line number.

    Files stay splittable: a line's number is its position in its split plus the
    lines of the splits before it.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", c("_metadata.file_path").alias("path"), c("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    part = ["path", "_start"]
    sizes = raw.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*part, F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = raw.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy("_id")))
    d = join_back(local, before, part)
    return d.select("path", (c("_rn") + c("_before")).alias("line_no"), "value")


def classify_files(files: DataFrame, types: list[tuple[str, str]], min_size: int = 0) -> DataFrame:
    """Rows (path, size_bytes, mtime) with file name, folder and a type by name rule (first matching regex); small and unknown files go."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = None
    for regex, label in types:
        kind = F.when(name.rlike(regex), label) if kind is None else kind.when(name.rlike(regex), label)
    d = files.select("path", name.alias("file_name"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "size_bytes", "mtime", kind.alias("file_type"))
    return d.filter((c("size_bytes") >= min_size) & c("file_type").isNotNull())


def file_inventory(spark: SparkSession, root: str, types: list[tuple[str, str]], min_size: int = 0) -> DataFrame:
    """Files under a folder, classified."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    return classify_files(d.select("path", c("length").alias("size_bytes"), c("modificationTime").alias("mtime")), types, min_size)


def newest_per_folder(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("folder").agg(F.max_by(F.struct("path", "size_bytes", "mtime", "file_type"), F.struct("mtime", "path")).alias("_r")).select("folder", "_r.*")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), sort_by: list[str] = ()) -> None:
    """Write Parquet clustered by its partition columns, sorted for statistics. Rebalancing gives a small folder one file and splits
    a large one over tasks of the advisory size."""
    out = df.hint("rebalance", *[c(p) for p in partition_by]) if partition_by else df
    if sort_by:
        out = out.sortWithinPartitions(*partition_by, *sort_by)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


# --- CSV -------------------------------------------------------------------

# The column order of the manual-entry template.
TEMPLATE = [
    ("test_run_id", "string"), ("survey_point_id", "string"), ("survey_time", "timestamp"), ("badge_event_id", "string"), ("badge_candidate_index", "int"),
    ("badge_time", "timestamp"), ("time_delta_seconds", "double"), ("match_quality", "string"), ("floor", "string"), ("area", "string"), ("x_m", "double"),
    ("y_m", "double"), ("badge_mac", "string"), ("badge_model", "string"), ("ssid", "string"), ("bssid", "string"), ("ap_name", "string"), ("channel", "int"),
    ("band", "string"), ("badge_rssi_dbm", "double"), ("badge_cu_percent", "double"), ("badge_score", "double"), ("badge_selected", "boolean"),
    ("survey_rssi_dbm", "double"), ("survey_snr_db", "double"), ("notes", "string")]
TEMPLATE_SCHEMA = ", ".join(f"{n} {k}" for n, k in TEMPLATE)


def write_template_csv(df: DataFrame, path: str) -> None:
    """Candidate rows in the fixed column order; missing columns are blank."""
    cols = [c(n).cast(k) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in TEMPLATE]
    df.select(*[col.alias(n) for col, (n, _) in zip(cols, TEMPLATE)]).write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def read_template_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEMPLATE_SCHEMA).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def manual_observations(rows: DataFrame, tz: str) -> DataFrame:
    """Observations of text-typed manual rows; those without a level, an address or a time are dropped. The
    band comes from its column, else the frequency, else the channel."""
    t = lambda n: nullif_trim(c(n)) if n in rows.columns else F.lit(None).cast("string")
    d = rows.select(
        t("test_run_id").alias("test_run_id"), t("survey_point_id").alias("survey_point_id"), parse_timestamp_variants(t("survey_time"), tz).alias("survey_time"),
        F.coalesce(normalize_mac(t("bssid")), F.lower(t("bssid"))).alias("bssid"), t("channel").try_cast("int").alias("channel"), t("frequency_mhz").try_cast("int").alias("_mhz"),
        t("band").alias("_band"), t("survey_rssi_dbm").try_cast("double").alias("rssi_dbm"), t("survey_snr_db").try_cast("double").alias("snr_db"), t("notes").alias("notes"))
    d = d.withColumn("band", F.coalesce("_band", band_from_frequency(c("_mhz")), band_from_channel(c("channel")))).drop("_band", "_mhz")
    return d.filter(c("rssi_dbm").isNotNull() & c("bssid").isNotNull() & c("survey_time").isNotNull())


def read_manual_csv(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    names = [n for n, _ in TEMPLATE]
    return manual_observations(spark.read.schema(", ".join(f"{n} STRING" for n in names)).option("header", True).csv(path), tz)


# --- throughput results ----------------------------------------------------

FILE_NAME = r"([^/]+)\.json$"
# Names of latency fields, in order of preference.
LATENCY_SECONDS = ["raw_latency_seconds", "latency_seconds", "rtt_seconds", "ping_rtt_seconds"]
LATENCY_MS = ["raw_latency_ms", "latency_ms", "rtt_ms", "ping_rtt_ms", "ping_avg_ms", "ping_rtt_avg_ms"]


def throughput_results(files: DataFrame, tz: str = "UTC") -> DataFrame:
    """Results of throughput tests, one JSON document per row (``path``, ``content``, ``mtime``).

    The optional envelope is unwrapped; the receiver's summary is preferred over
    the total and the sender's; labels fall back from metadata to the test's own
    start record to the file path. A file that is not JSON gives ``parse_error``.
    """
    parsed = F.try_parse_json(c("content"))
    d = files.withColumn("_v", parsed)
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    name = F.regexp_extract("path", FILE_NAME, 1)

    def inner(path: str, kind: str = "string") -> Column:
        return F.when(get("$.iperf3", "string").isNotNull(), get(f"$.iperf3.{path}", kind)).otherwise(get(f"$.{path}", kind))

    def meta(key: str, kind: str = "string") -> Column:
        return nullif_trim(get(f"$.metadata.{key}")) if kind == "string" else get(f"$.metadata.{key}", kind)

    kinds = ["sum_received", "sum", "sum_sent"]
    which = F.coalesce(*[F.when(F.coalesce(inner(f"end.{k}"), F.lit("{}")) != "{}", k) for k in kinds])
    number = lambda key: F.coalesce(*[F.when(c("_sum") == k, inner(f"end.{k}.{key}", "double")) for k in kinds])
    d = d.withColumn("_sum", which)
    stamp = F.try_to_timestamp(F.regexp_extract(name, r"-(\d{8}-\d{6})$", 1), F.lit("yyyyMMdd-HHmmss"))
    started = F.timestamp_micros((inner("start.timestamp.timesecs", "double") * 1e6).cast("bigint"))
    error = F.coalesce(nullif_trim(inner("error")), nullif_trim(get("$.error")))
    unknown = F.lit("unknown")
    port = F.coalesce(meta("target_port"), inner("start.connecting_to.port"), inner("start.connected[0].remote_port"), unknown)
    target = F.coalesce(meta("target"), inner("start.connecting_to.host"), inner("start.connected[0].remote_host"), unknown)
    seconds = seconds_from([meta(k, "double") for k in LATENCY_SECONDS], [meta(k, "double") for k in LATENCY_MS])
    return d.select(
        "path", c("_v").isNull().alias("parse_error"), name.endswith(".tmp").alias("is_temp"),
        F.coalesce(meta("device"), F.nullif(F.regexp_extract("path", r"([^/]+)/raw/[^/]+$", 1), F.lit("")), unknown).alias("device"),
        *[F.coalesce(meta(k), unknown).alias(k) for k in ("site", "ssid", "role", "mode", "tos")],
        F.coalesce(meta("direction"), F.nullif(F.regexp_extract(name, r"^([A-Za-z_]+)-\d{8}-\d{6}$", 1), F.lit("")), unknown).alias("direction"),
        target.alias("target"), F.coalesce(meta("target_name"), target).alias("target_name"), port.alias("target_port"), F.coalesce(inner("start.test_start.protocol"), unknown).alias("protocol"),
        F.when(F.coalesce(inner("start.test_start.reverse", "int"), F.lit(0)) != 0, "1").otherwise("0").alias("reverse"),
        F.coalesce(started, F.to_utc_timestamp(stamp, tz), c("mtime")).alias("ts"), F.when(error.isNull() & c("_sum").isNotNull(), 1).otherwise(0).alias("up"),
        *[number(k).alias(k) for k in ("seconds", "bytes", "bits_per_second", "jitter_ms", "lost_packets", "packets", "lost_percent")], seconds.alias("raw_latency_seconds"),
        parse_rate(meta("bitrate")).alias("configured_bits_per_second"), error.alias("error"))


def read_iperf_json(spark: SparkSession, path: str, tz: str = "UTC") -> DataFrame:
    """Throughput results of a folder of JSON files, one document per file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).select(
        c("_metadata.file_path").alias("path"), c("value").alias("content"), c("_metadata.file_modification_time").alias("mtime"))
    return throughput_results(files, tz)


def with_target_config(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Target names by host:port, then by host."""
    from tidewire.operators.joins import coalesced_lookup
    d = results.withColumn("_hp", F.concat_ws(":", "target", "target_port"))
    d = coalesced_lookup(d, targets, ["_hp", "target"], "name", "_cfg").drop("_hp")
    return d.withColumn("target_name", F.when(c("target_name") == c("target"), F.coalesce("_cfg", "target_name")).otherwise(c("target_name"))).drop("_cfg")


# --- survey exports --------------------------------------------------------

def survey_points(files: DataFrame, tz: str = "UTC", keys: list[str] = ("timestamp", "time", "measuredAt"), floor_plans: DataFrame | None = None) -> DataFrame:
    """Points of survey exports (``path``, ``content``).

    Native form: route points with an offset from the survey's start, in
    nanoseconds, milliseconds or seconds by the survey's largest offset. Any
    other form: every object that carries a timestamp key, at any depth.
    ``floor_plans`` (id, name) turns plan ids into floor names.
    """
    d = files.withColumn("_v", F.try_parse_json("content"))
    surveys = d.select("path", F.explode_outer(F.try_variant_get("_v", "$.surveys", "array<variant>")).alias("_s")).filter(c("_s").isNotNull())
    get = lambda col, p, k="string": F.try_variant_get(col, p, k)
    pts = surveys.select("path", get("_s", "$.id").alias("survey_id"), get("_s", "$.name").alias("survey_name"), get("_s", "$.startTime").alias("_start"), get("_s", "$.floorPlanId").alias("floor"),
                         F.posexplode(get("_s", "$.routePoints", "array<variant>")).alias("point_index", "_p"))
    pts = pts.withColumn("_off", get("_p", "$.time", "double"))
    top = pts.groupBy("path", "survey_id").agg(F.max(F.abs("_off")).alias("_max"))
    scale = F.when(c("_max") >= 1e9, 1e9).when(c("_max") >= 1.0, 1e3).otherwise(1.0)
    start = parse_timestamp_variants(c("_start"), tz)
    native = join_back(pts, top, ["path", "survey_id"]).select(
        "path", "survey_id", "survey_name", "point_index", F.timestamp_micros(F.unix_micros(start) + F.round(c("_off") / scale * 1e6).cast("bigint")).alias("measured_at"),
        "floor", get("_p", "$.location.x", "double").alias("x_m"), get("_p", "$.location.y", "double").alias("y_m"))
    level = d.join(surveys.select("path").distinct(), "path", "left_anti").select("path", c("_v").alias("_o"), F.lit("$").alias("json_path"))
    found = None
    while found is None or level.limit(1).count():  # one round per level of nesting; each is written once
        stamp = F.coalesce(*[parse_timestamp_variants(get("_o", f"$.{k}"), tz) for k in keys])
        hits = level.select("path", "json_path", stamp.alias("measured_at"), get("_o", "$.id").alias("survey_id"), get("_o", "$.floor").alias("floor"),
                            get("_o", "$.x", "double").alias("x_m"), get("_o", "$.y", "double").alias("y_m")).filter(c("measured_at").isNotNull())
        found = hits if found is None else found.unionByName(hits)
        level = checkpointed(_children(level))
    generic = found.select("path", "survey_id", F.lit(None).cast("string").alias("survey_name"), F.lit(None).cast("int").alias("point_index"), "measured_at", "floor", "x_m", "y_m")
    out = native.unionByName(generic).filter(c("measured_at").isNotNull())
    if floor_plans is None:
        return out
    names = floor_plans.groupBy(c("id").alias("floor")).agg(F.min("name").alias("_floor_name"))
    return out.join(names, "floor", "left").withColumn("floor", F.coalesce("_floor_name", "floor")).select(*out.columns)


def _children(level: DataFrame) -> DataFrame:
    """Objects one level down in JSON values."""
    return level.sparkSession.sql("""
        SELECT path, concat(json_path, coalesce('.' || key, '[' || pos || ']')) AS json_path, value AS _o
        FROM {level}, LATERAL variant_explode(_o)""", level=level)


def ap_name_lookup(aps: DataFrame, radios: DataFrame, measurements: DataFrame) -> DataFrame:
    """BSSID to AP name over three files: APs (id, name), radios (ap_id, measurement_ids, pos), measurements
    (id, mac). The last radio that claims a BSSID wins."""
    r = radios.select("ap_id", "pos", F.posexplode("measurement_ids").alias("_i", "measurement_id"))
    a = aps.select(c("id").alias("ap_id"), c("name").alias("ap_name"))
    m = measurements.select(c("id").alias("measurement_id"), normalize_mac(c("mac")).alias("bssid")).filter(c("bssid").isNotNull())
    return r.join(a, "ap_id").join(m, "measurement_id").groupBy("bssid").agg(F.max_by("ap_name", F.struct("pos", "_i")).alias("ap_name"))


# --- client detail ---------------------------------------------------------

# Aliases of client fields; (alias, factor) for numbers.
CLIENT_TEXT = {
    "client_mac": ["client_mac", "clientMac", "macAddress", "hostMac", "host_mac", "mac"], "akm": ["akm", "authKeyMgmt", "auth_key_mgmt", "authenticationMethod"],
    "ft": ["ft_state", "ftState", "fastTransitionState", "80211rState"], "ssid": ["ssid", "wlanSsid", "wlanProfileName"],
    "badge_model": ["badge_model", "badgeModel", "deviceModel", "model", "deviceType", "device_type"], "device_group": ["device_group", "deviceGroup"],
    "wlc": ["wlc", "wlcName", "controller", "controllerName", "wirelessControllerName"], "ap_name": ["ap_name", "apName", "clientConnection", "nwDeviceName", "connectedDeviceName", "accessPoint"],
    "site_tag": ["site_tag", "siteTag", "site", "siteName"], "policy_tag": ["policy_tag", "policyTag"], "rf_tag": ["rf_tag", "rfTag"],
    "band": ["band", "frequency", "radioType", "radioBand"], "channel": ["channel", "radioChannel"]}
CLIENT_NUMBERS = {
    "rssi_dbm": [("rssi_dbm", 1), ("rssi", 1)], "snr_db": [("snr_db", 1), ("snr", 1)],
    "rx_retry_pct": [("rx_retry_pct", 1), ("rxRetriesPct", 1), ("rxRetryPercent", 1), ("rxRetryPercentage", 1)],
    "latency_voice_us": [("latency_voice_us", 1), ("voiceLatencyUs", 1), ("latency_voice_ms", 1000), ("voiceLatencyMs", 1000), ("latencyVoice", 1), ("voiceLatency", 1)],
    "latency_be_us": [("latency_be_us", 1), ("beLatencyUs", 1), ("bestEffortLatencyUs", 1), ("latency_be_ms", 1000), ("beLatencyMs", 1000), ("bestEffortLatencyMs", 1000),
                      ("latencyBe", 1), ("beLatency", 1), ("bestEffortLatency", 1)],
    "max_roaming_duration_ms": [("max_roaming_duration_ms", 1), ("maxRoamingDuration", 1)], "average_auth_duration_ms": [("average_auth_duration_ms", 1), ("averageAuthDuration", 1)],
    "average_assoc_duration_ms": [("average_assoc_duration_ms", 1), ("averageAssocDuration", 1)], "average_dhcp_duration_ms": [("average_dhcp_duration_ms", 1), ("averageDhcpDuration", 1)],
    "session_duration_s": [("session_duration_s", 1), ("sessionDurationSeconds", 1), ("sessionDuration", 1)], "onboarding_attempts": [("onboarding_attempts", 1)]}
SIGNED = ["rssi_dbm", "snr_db", "rx_retry_pct"]


def canonical_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def json_leaves(records: DataFrame, record_id: str, content: str) -> DataFrame:
    """Scalar members of JSON records at any level: canonical key, text, and place in document order.

    An object's own members come before those of the objects in it, and these in the order of the text. Members are parsed twice: as text,
    which keeps the order of nested objects, and as variants, which tell strings from objects. Empty values are skipped.
    """
    level = records.select(c(record_id), c(content).alias("_o"), F.array().cast("array<int>").alias("_in")).filter(F.try_parse_json(content).isNotNull())
    found = None
    while found is None or level.limit(1).count():  # one round per level of nesting; each is written once
        is_list = F.ltrim("_o").startswith("[")
        text = F.when(is_list, F.transform(F.from_json("_o", "array<string>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))).otherwise(
            F.map_entries(F.from_json("_o", "map<string,string>")))
        kind = F.when(is_list, F.from_json("_o", "array<variant>")).otherwise(F.transform(F.map_entries(F.from_json("_o", "map<string,variant>")), lambda x: x["value"]))
        each = level.select(record_id, "_in", F.posexplode(F.arrays_zip(text.alias("t"), kind.alias("v"))).alias("_at", "_m")).select(
            record_id, "_in", "_at", c("_m.t.key").alias("_name"), c("_m.t.value").alias("_text"), F.schema_of_variant("_m.v").alias("_kind"))
        nested = F.coalesce(c("_kind").startswith("OBJECT") | c("_kind").startswith("ARRAY"), F.lit(False))
        leaf = each.filter(~nested & (c("_kind") != "VOID") & c("_name").isNotNull() & (c("_text") != "")).select(
            record_id, canonical_key(c("_name")).alias("_key"), "_text", F.struct("_in", "_at").alias("_pos"))
        found = leaf if found is None else found.unionByName(leaf)
        level = checkpointed(each.filter(nested).select(record_id, c("_text").alias("_o"), F.concat("_in", F.array("_at")).alias("_in")))
    return found


def client_detail_job(records: DataFrame, record_id: str, content: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """Normalised client snapshots of vendor JSON records; those without a valid MAC are skipped.

    Each field takes the first alias that is present anywhere in the record, an
    object's own members before those inside it, then in the order of the text. Numbers may carry units; millisecond aliases become
    microseconds.
    """
    base = {"ssid": "unknown", "badge_model": "unknown", "device_group": "unknown", "wlc": "unknown", **(defaults or {})}
    wanted = {canon: None for names in CLIENT_TEXT.values() for canon in map(_canon, names)}
    wanted.update({_canon(a): None for pairs in CLIENT_NUMBERS.values() for a, _ in pairs})
    leaves = json_leaves(records, record_id, content).filter(c("_key").isin(list(wanted)))
    per_key = leaves.groupBy(record_id, "_key").agg(F.min_by("_text", "_pos").alias("_text"))
    g = per_key.groupBy(record_id).agg(F.map_from_entries(F.collect_list(F.struct("_key", "_text"))).alias("_m"))
    at = lambda alias: F.try_element_at("_m", F.lit(_canon(alias)))
    text = lambda field: F.coalesce(*[at(a) for a in CLIENT_TEXT[field]])
    named = lambda field: F.coalesce(nullif_trim(text(field)), F.lit(base.get(field, "unknown")))

    def number(field: str) -> Column:
        tries = [F.nullif(F.regexp_extract(F.replace(at(a), F.lit(",")), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double") * float(k) for a, k in CLIENT_NUMBERS[field]]
        value = F.coalesce(*tries)
        return value if field in SIGNED else F.when(value >= 0, value)

    mac = normalize_mac(text("client_mac"))
    akm = F.coalesce(nullif_trim(text("akm")), F.lit("unknown"))
    return g.select(
        record_id, mac.alias("client_mac"), named("device_group").alias("device_group"), named("badge_model").alias("badge_model"), strip_domain(named("wlc")).alias("wlc"), named("ssid").alias("ssid"),
        *[named(f).alias(f) for f in ("ap_name", "site_tag", "policy_tag", "rf_tag", "channel")], band_from_text(text("band")).alias("band"),
        *[number(f).alias(f) for f in CLIENT_NUMBERS], akm.alias("akm"), ft_state(text("ft"), akm).alias("ft_state")).filter(c("client_mac").isNotNull())


def _canon(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())
