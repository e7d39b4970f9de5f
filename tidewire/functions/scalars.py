"""Scalar column functions. Each takes and returns a Column; none uses Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel sets and the survey-to-device level offsets per band.
DFS_CHANNELS = [52, 56, 60, 64, 100, 104, 108, 112, 116, 120, 124, 128, 132, 136, 140, 144]
UNII1_CHANNELS = [36, 40, 44, 48]
UNII2_CHANNELS = [52, 56, 60, 64]
UNII3_CHANNELS = [149, 153, 157, 161, 165]
BAND_OFFSETS = {"2.4GHz": -5.0, "5GHz": -8.0}

# Vocabularies.
TRUTHY_WORDS = ["true", "t", "1", "yes", "y", "on", "selected", "select", "run", "delete", "clear", "create"]
FT_WORDS = ["ft", "fast_transition", "802.11r", "80211r", "enabled", "true", "yes"]
NON_FT_WORDS = ["non_ft", "nonft", "not_ft", "disabled", "false", "no"]
GENERATIONS = {
    "wifi7mlo": "wifi7_mlo",
    "wifi7nonmlo": "wifi7_non_mlo",
    "nonwifi6": "non_wifi6",
    "wifi6": "wifi6",
}
SPEED_UNITS_GBPS = {
    "gbps": 1.0, "gbit/s": 1.0, "g": 1.0,
    "mbps": 1e-3, "mbit/s": 1e-3, "m": 1e-3,
    "kbps": 1e-6, "kbit/s": 1e-6, "k": 1e-6,
}
UNKNOWN_SPEEDS = ["", "-1", "unknown", "none", "null", "n/a"]


def case_map(col: Column, mapping: dict, default: Column | None = None) -> Column:
    """CASE over a small fixed mapping."""
    out = None
    for key, value in mapping.items():
        cond = col == F.lit(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out if default is None else out.otherwise(default)


# --- addresses -------------------------------------------------------------

def mac_hex(col: Column) -> Column:
    """Only the hex digits, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^0-9a-f]", "")


def normalize_mac(col: Column) -> Column:
    """Colon-separated lower-case MAC, null when the text does not hold exactly 12 hex digits."""
    digits = mac_hex(col)
    return F.when(F.length(digits) == 12, F.regexp_replace(digits, "(..)(?=.)", "$1:"))


def normalize_mac_lenient(col: Column) -> Column:
    """Dotted form becomes colon form; any other text passes in trimmed lower case."""
    text = F.lower(F.trim(col))
    dotted = text.rlike(r"^[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}$")
    return F.when(dotted, F.regexp_replace(F.regexp_replace(text, r"\.", ""), "(..)(?=.)", "$1:")).otherwise(text)


def ipv4_number(col: Column) -> Column:
    """Dotted quad as BIGINT; null when it is not an IPv4 address."""
    ok = col.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    # one expression over the parts: written out per part, the check and the split would run once for each
    return F.aggregate(F.split(F.when(ok, col), r"\."), F.lit(0).cast("bigint"), lambda total, part: total * 256 + part.cast("bigint"))


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a block, as numbers."""
    base, _, prefix = cidr.partition("/")
    number = 0
    for octet in base.split("."):
        number = number * 256 + int(octet)
    size = 1 << (32 - int(prefix or 32))
    first = number - number % size
    return first, first + size - 1


def in_pool(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a CIDR block; false for anything that is not IPv4."""
    lo, hi = cidr_bounds(cidr)
    return F.coalesce(F.exists(F.array(ipv4_number(ip)), lambda n: n.between(lo, hi)), F.lit(False))


def multicast_mac_number(ip_number: Column) -> Column:
    """RFC 1112: prefix 01:00:5e and the low 23 bits of the group address."""
    return F.lit(0x01005E000000) + ip_number.bitwiseAND(F.lit(0x7FFFFF).cast("bigint"))


def multicast_mac(ip: Column) -> Column:
    """MAC of a multicast group address, null outside 224.0.0.0/4."""
    number = ipv4_number(ip)
    digits = F.lower(F.lpad(F.hex(multicast_mac_number(number)), 12, "0"))
    lo, hi = cidr_bounds("224.0.0.0/4")
    return F.when(number.between(lo, hi), F.regexp_replace(digits, "(..)(?=.)", "$1:"))


def mac_in_range(mac: Column, cidr: str) -> Column:
    """Whether a MAC lies in the range derived from the first and last host of a multicast block."""
    lo, hi = cidr_bounds(cidr)
    if hi - lo > 1:
        lo, hi = lo + 1, hi - 1
    number = F.conv(F.regexp_replace(normalize_mac(mac), ":", ""), 16, 10).cast("bigint")
    first, last = (0x01005E000000 + (n & 0x7FFFFF) for n in (lo, hi))
    return F.coalesce(number.between(first, last), F.lit(False))


def mapping_is_valid(ip: Column, mac: Column) -> Column:
    """Whether a MAC is the RFC 1112 image of a group address."""
    return F.coalesce(normalize_mac(mac) == multicast_mac(ip), F.lit(False))


def find_ips(text: Column, cidr: str | None = None) -> Column:
    """Distinct IPv4 addresses of a text in order of first appearance, optionally only those of one block."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:\d{1,3}\.){3}\d{1,3})\b"), 1))
    keep = (lambda ip: in_pool(ip, cidr)) if cidr else (lambda ip: ipv4_number(ip).isNotNull())
    return F.filter(found, keep)


# --- radio vocabulary ------------------------------------------------------

def band_from_channel(channel: Column, op_class: Column | None = None) -> Column:
    base = F.when(channel.between(1, 14), "2.4GHz").when(channel.between(32, 177), "5GHz")
    if op_class is None:
        return base
    return F.when(channel.isNotNull() & op_class.between(131, 137), "6GHz").otherwise(base)


def band_from_frequency(mhz: Column) -> Column:
    return (
        F.when((mhz >= 2400) & (mhz < 2500), "2.4GHz")
        .when((mhz >= 4900) & (mhz < 5925), "5GHz")
        .when((mhz >= 5925) & (mhz <= 7125), "6GHz")
    )


def band_from_slot(slot: Column) -> Column:
    return case_map(F.trim(slot.cast("string")), {"0": "2.4ghz", "1": "5ghz", "2": "6ghz"}, F.lit("unknown"))


def band_from_text(text: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    packed = F.regexp_replace(plain, "[ _-]", "")
    return (
        F.when(plain == "", "unknown")
        .when(packed.contains("2.4") | packed.startswith("24") | packed.startswith("2g"), "24ghz")
        .when((packed.contains("5") & packed.contains("ghz")) | packed.startswith("5g"), "5ghz")
        .when((packed.contains("6") & packed.contains("ghz")) | packed.startswith("6g"), "6ghz")
        .when(packed.isin("80211a", "a"), "5ghz")
        .when(packed.isin("80211b", "80211g", "b", "g"), "24ghz")
        .otherwise(plain)
    )


def is_dfs(channel: Column) -> Column:
    return F.coalesce(channel.isin(DFS_CHANNELS), F.lit(False))


def channel_family(channel: Column) -> Column:
    return (
        F.when(channel.isNull(), "unknown")
        .when(channel.isin(UNII1_CHANNELS), "UNII-1 non-DFS")
        .when(channel.isin(UNII2_CHANNELS), "UNII-2 DFS")
        .when(channel.between(100, 144), "UNII-2e DFS")
        .when(channel.isin(UNII3_CHANNELS), "UNII-3 non-DFS")
        .otherwise("other")
    )


def ft_state(value: Column, key_mgmt: Column) -> Column:
    """Fast-transition state from an explicit word, else from the key-management text."""
    word = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[- ]", "_")
    akm = F.lower(F.coalesce(key_mgmt, F.lit("")))
    by_akm = akm.contains("802.11r") | akm.contains("80211r") | akm.rlike(r"\bft\b")
    return F.when(word.isin(FT_WORDS), "ft").when(word.isin(NON_FT_WORDS), "non_ft").when(by_akm, "ft").otherwise("unknown")


def strip_domain(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def slug(text: Column) -> Column:
    """Lower case, runs of other characters become one underscore; 'unknown' when nothing is left."""
    body = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(body, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


access_category = slug


def generation(text: Column) -> Column:
    packed = F.regexp_replace(F.lower(F.trim(text)), "[-/ ]", "")
    return case_map(packed, GENERATIONS, slug(text))


# --- time ------------------------------------------------------------------

def local_date(ts: Column, tz: Column | str) -> Column:
    """Calendar date of an instant in a zone (the session zone is UTC)."""
    zone = F.lit(tz) if isinstance(tz, str) else tz
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_text(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd HH:mm:ss")


def epoch_to_ts(number: Column) -> Column:
    """Epoch seconds, or milliseconds when the number is above 1e10."""
    seconds = F.when(number > 1e10, number / 1000.0).otherwise(number)
    return F.timestamp_micros(F.round(seconds * 1e6).cast("bigint"))


def parse_timestamp_variants(text: Column, tz: str = "UTC") -> Column:
    """Epoch seconds or milliseconds, ISO with Z or offset, and three zone-less formats read in ``tz``."""
    trimmed = F.trim(text)
    is_number = trimmed.rlike(r"^\d+(\.\d+)?$")
    has_zone = trimmed.rlike(r"\d(Z|[+-]\d{2}:?\d{2})$") & trimmed.contains(":")
    from_epoch = epoch_to_ts(F.when(is_number, trimmed).cast("double"))
    zoned = F.try_to_timestamp(F.when(has_zone, F.regexp_replace(trimmed, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    bare_iso = F.when(~is_number & ~has_zone & trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), trimmed)
    naive = F.coalesce(
        F.try_to_timestamp(bare_iso),
        F.try_to_timestamp(trimmed, F.lit("MM/dd/yyyy HH:mm:ss")),
        F.try_to_timestamp(trimmed, F.lit("MM/dd/yy HH:mm:ss")),
    )
    return F.coalesce(from_epoch, zoned, F.to_utc_timestamp(naive, tz))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def age_seconds(ts: Column, now: Column) -> Column:
    """Seconds since ``ts``, never below zero."""
    return F.greatest((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(1e6), F.lit(0.0))


def near_edge(delta: Column, window: Column | float) -> Column:
    """A match in the outer fifth of its window."""
    return F.abs(delta) > F.lit(0.8) * window


def overlap_window(first_a: Column, last_a: Column, first_b: Column, last_b: Column, margin_seconds: int) -> Column:
    """Common span of two ranges widened by a margin; null when they do not meet."""
    margin = F.expr(f"INTERVAL {int(margin_seconds)} SECONDS")
    start = F.greatest(first_a, first_b) - margin
    end = F.least(last_a, last_b) + margin
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


# --- numbers and units -----------------------------------------------------

def parse_rate(text: Column) -> Column:
    """Bits per second from text such as 64K or 1.5M."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"^([+-]?\d+(?:\.\d+)?)\s*[kKmMgG]?$", 1)
    suffix = F.lower(F.right(trimmed, F.lit(1)))
    factor = case_map(suffix, {"k": 1e3, "m": 1e6, "g": 1e9}, F.lit(1.0))
    return F.nullif(number, F.lit("")).cast("double") * factor


def link_speed_gbps(*texts: Column) -> Column:
    """First readable link speed in Gbps; a bare number is in kbps; zero and below are unknown."""

    def one(text: Column) -> Column:
        raw = F.regexp_replace(F.lower(F.trim(text)), ",", "")
        number = F.regexp_extract(raw, r"^([+-]?\d+(?:\.\d+)?)\s*(?:[gmk](?:bps|bit/s)?)?$", 1)
        unit = F.regexp_extract(raw, r"([gmk](?:bps|bit/s)?)$", 1)
        speed = F.nullif(number, F.lit("")).cast("double") * case_map(unit, SPEED_UNITS_GBPS, F.lit(1e-6))
        return F.when(~raw.isin(UNKNOWN_SPEEDS) & (speed > 0), speed)

    return F.coalesce(*[one(t) for t in texts])


def format_speed(gbps: Column) -> Column:
    whole = F.concat(F.format_string("%d", gbps.cast("bigint")), F.lit(" Gbps"))
    digits = F.regexp_replace(F.format_string("%.3f", gbps), r"\.?0+$", "")
    return (
        F.when(gbps.isNull(), "unknown")
        .when(gbps == F.floor(gbps), whole)
        .otherwise(F.concat(digits, F.lit(" Gbps")))
    )


def seconds_from(second_cols: list[Column], ms_cols: list[Column]) -> Column:
    """First present value: second-valued columns, then millisecond-valued ones divided by 1000."""
    return F.coalesce(*second_cols, *[c / 1000.0 for c in ms_cols])


def clamp_min(value: Column, floor: float) -> Column:
    """Raise a value to a floor; an absent value stays absent."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(floor))))


def safe_ratio(num: Column, den: Column, mode: str = "null") -> Column:
    """Ratio that is null on a zero denominator, or divides by at least 1 in ``clamp`` mode."""
    if mode == "clamp":
        return num / clamp_min(den, 1)
    return F.try_divide(num.cast("double"), den)


# --- text and ids ----------------------------------------------------------

def nullif_trim(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def truthy(col: Column) -> Column:
    return F.lower(F.trim(F.coalesce(col, F.lit("")))).isin(TRUTHY_WORDS)


def stable_id(*cols: Column, prefix: str = "") -> Column:
    """Prefix and the first 24 hex digits of SHA-256 over the pipe-joined parts; null counts as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def concat_notes(*cols: Column, sep: str = " | ") -> Column:
    """Join the parts that are present and not blank."""
    return F.concat_ws(sep, *[nullif_trim(c.cast("string")) for c in cols])


def normalize_scope(col: Column, aliases: dict[str, str], default: str) -> Column:
    """Slug of a scope name through an alias map; blank means the default scope."""
    word = F.lower(F.regexp_replace(F.coalesce(nullif_trim(col), F.lit(default)), "[^a-zA-Z0-9]+", "_"))
    return case_map(word, aliases, word)


def scope_of(run_id: Column, prefixes: dict[str, str], default: str) -> Column:
    """Scope by the prefix of a run id."""
    out = None
    for prefix, scope in prefixes.items():
        cond = F.coalesce(run_id, F.lit("")).startswith(prefix)
        out = F.when(cond, scope) if out is None else out.when(cond, scope)
    return out.otherwise(default)


def vendor_offset(model: Column, band: Column, by_model: dict[tuple[str, str], float], by_band: dict[str, float]) -> Column:
    """Offset of (model, band) if configured, else of the band, else null."""
    out = None
    for (m, b), value in by_model.items():
        cond = (F.upper(model) == m.upper()) & (band == b)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    fallback = case_map(band, by_band)
    return fallback if out is None else out.otherwise(fallback)


def calibrated_delta(device_rssi: Column, survey_rssi: Column, offset: Column) -> dict[str, Column]:
    """Expected level, raw and calibrated deltas, and entry status of one match."""
    expected = survey_rssi + offset
    calibrated = device_rssi - expected
    return {
        "expected_rssi_dbm": expected,
        "raw_delta_db": device_rssi - survey_rssi,
        "calibrated_delta_db": calibrated,
        "absolute_calibrated_delta_db": F.abs(calibrated),
        "manual_entry_status": F.when(survey_rssi.isNull(), "pending_manual_entry")
        .when(offset.isNull(), "missing_vendor_offset")
        .otherwise("complete"),
    }


def direction(src_role: Column, dst_role: Column) -> Column:
    return F.concat(src_role, F.lit("_to_"), dst_role)


def role_for(ip: Column, server_ips: list[str], badge_cidrs: list[str]) -> Column:
    """Server by exact address, badge by subnet, else unknown."""
    badge = F.lit(False)
    for cidr in badge_cidrs:
        badge = badge | in_pool(ip, cidr)
    return F.when(ip.isin(server_ips), "server").when(badge, "badge").otherwise("unknown")


def confidence_arcs(confidence: Column) -> dict[str, Column]:
    """Green, yellow and red flags of a confidence level."""
    high, medium = confidence == "high", confidence == "medium"
    return {
        "arc_high": high.cast("int"),
        "arc_medium": medium.cast("int"),
        "arc_low": (~(high | medium)).cast("int"),
    }


def state_confidence(states: list[Column], active: list[str], down: list[str]) -> Column:
    """High if any state is an active word, else low if any is a down word, else medium."""
    words = [F.lower(F.trim(F.coalesce(s, F.lit("")))) for s in states]
    any_active = F.lit(False)
    any_down = F.lit(False)
    for w in words:
        any_active = any_active | w.isin(active)
        any_down = any_down | w.isin(down)
    return F.when(any_active, "high").when(any_down, "low").otherwise("medium")


def speed_color(gbps: Column, scheme: list[tuple[float, str]], unknown: str) -> Column:
    """Colour of the first threshold (high to low) that the speed reaches."""
    out = F.when(gbps.isNull(), unknown)
    for threshold, color in scheme:
        out = out.when(gbps >= threshold, color)
    return out.otherwise(unknown)


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a shell glob with * and ?."""
    out = ""
    for ch in pattern:
        out += ".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in r"\.[]{}()+^$|" else ch
    return f"^{out}$"


def layer_for(host: Column, role: Column, globs: list[tuple[str, int]], roles: dict[str, int],
              families: dict[str, int], default: int = 5) -> Column:
    """Topology layer: first matching host glob, then exact role, then family word inside the role."""
    name, kind = F.upper(host), F.upper(F.trim(role))
    out = None
    rules = [(name.rlike(glob_to_regex(g)), layer) for g, layer in globs]
    rules += [(kind == r, layer) for r, layer in roles.items()]
    rules += [(kind.contains(f), layer) for f, layer in families.items()]
    for cond, layer in rules:
        out = F.when(cond, layer) if out is None else out.when(cond, layer)
    return F.lit(default) if out is None else out.otherwise(default)


# --- JSON ------------------------------------------------------------------

def json_value(col: Column, path: str, kind: str = "string") -> Column:
    """Value at a JSON path; null when the text is not JSON or the path is absent."""
    return F.try_variant_get(F.try_parse_json(col), path, kind)


def json_has(col: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(col), key), F.lit(False))


def json_length(col: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(col, path))


def json_build(**fields: Column) -> Column:
    """Object text that keeps null members."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})
