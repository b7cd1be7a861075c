"""Row-local text extraction and classification as Column functions (no Python UDFs)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logwarden import fixed_values as fv

_BLANKS = " \t\n\r\f\x0b\u00a0\ufeff"
DASH = "—"
ELLIPSIS = "…"


def pattern(text: str, ignore_case: bool = True) -> str:
    """A fixed-value pattern as a Java regex.

    Java's ``\\b`` consults Unicode letters while ``\\w`` is ASCII, so the ASCII boundary is
    spelled out. In these patterns a boundary stands before a word character, or after one at
    the end of an alternative, where it needs one look-around only.
    """
    body = re.sub(r"\\b(?=\||$)", r"(?!\\w)", text).replace(r"\b", r"(?<!\w)")
    return f"(?i){body}" if ignore_case else body


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns evaluated once per row.

    They come out of a generator over one struct, so the optimizer does not copy a costly
    expression into each filter and projection that uses its column.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def non_empty(col: Column) -> Column:
    """Null instead of the empty string."""
    return F.when(F.length(col) > 0, col)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def _first_group(text: Column, regex: str, group: int = 1, ignore_case: bool = True) -> Column:
    return non_empty(F.regexp_extract(text, pattern(regex, ignore_case), group))


def clamp(lo, hi, value: Column) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def round_half_up(value: Column) -> Column:
    """Halves round towards +infinity: floor(x + 0.5)."""
    return F.floor(value + F.lit(0.5))


def pick(fields: Column, aliases: tuple[str, ...]) -> Column:
    """First non-blank value among ordered aliases of a map<string,string>, trimmed."""
    return F.coalesce(*[non_empty(strip(F.try_element_at(fields, F.lit(a)))) for a in aliases])


# ---- extraction ------------------------------------------------------------


def all_ips(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(fv.IPV4_PATTERN, False)), F.lit(0))


def first_ip(text: Column, ips: Column | None = None) -> Column:
    """The labelled source address, else the first address in the text (``ips``: those already found)."""
    found = all_ips(text) if ips is None else ips
    return F.coalesce(_first_group(text, fv.LABELED_SOURCE_PATTERN), F.get(found, F.lit(0)))


def second_ip(text: Column, ips: Column | None = None) -> Column:
    """The labelled destination address, else the second address in the text."""
    found = all_ips(text) if ips is None else ips
    return F.coalesce(_first_group(text, fv.LABELED_DEST_PATTERN), F.get(found, F.lit(1)))


def clamp_port(value: Column) -> Column:
    """A port number in 1..65535, else null; text is read as a decimal number."""
    numeric = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), value)
    number = strip(numeric).try_cast("double")
    return F.when((number > 0) & (number <= 65535), number.cast("int"))


def port_text(text: Column) -> Column:
    return F.coalesce(*[_first_group(text, p) for p in fv.PORT_PATTERNS])


def extract_port(text: Column) -> Column:
    """A labelled port of at most five digits, when it lies in 1..65535."""
    number = port_text(text).cast("int")
    return F.when(number.between(1, 65535), number)


def extract_user(text: Column) -> Column:
    return F.coalesce(*[_first_group(text, p) for p in fv.USER_PATTERNS])


def extract_host(text: Column) -> Column:
    return F.coalesce(
        _first_group(text, fv.HOST_LABEL_PATTERN),
        _first_group(text, fv.HOST_SYSLOG_PATTERN, ignore_case=False),
    )


def parse_time(text: Column) -> Column:
    """struct(ts, time_label, hour): ISO date-time, else syslog time, else a bare HH:MM.

    ``ts`` is read from the matched ISO prefix (with fraction and offset when they follow)
    in the session time zone; only ISO text yields it.
    """
    iso = pattern(fv.ISO_TIME_PATTERN, False)
    tail = iso + r"(\.\d{1,6})?\d*(Z|[+-]\d{2}:?\d{2})?"
    date, hh, mm = (F.regexp_extract(text, iso, g) for g in (1, 2, 3))
    seconds = F.coalesce(_first_group(text, tail, 4, False), F.lit("00"))
    stamp = F.concat(
        date, F.lit("T"), hh, F.lit(":"), mm, F.lit(":"), seconds,
        F.regexp_extract(text, tail, 5), F.regexp_extract(text, tail, 6),
    )

    def labelled(ts: Column, hour: Column, minute: Column) -> Column:
        return F.struct(
            ts.alias("ts"), F.concat(hour, F.lit(":"), minute).alias("time_label"),
            hour.cast("int").alias("hour"),
        )

    no_ts = F.lit(None).cast("timestamp")
    sys_, bare = pattern(fv.SYSLOG_TIME_PATTERN, False), pattern(fv.BARE_TIME_PATTERN, False)
    return (
        F.when(text.rlike(iso), labelled(stamp.try_cast("timestamp"), hh, mm))
        .when(text.rlike(sys_), labelled(no_ts, F.regexp_extract(text, sys_, 1), F.regexp_extract(text, sys_, 2)))
        .when(text.rlike(bare), labelled(no_ts, F.regexp_extract(text, bare, 1), F.regexp_extract(text, bare, 2)))
        .otherwise(F.lit(None).cast("struct<ts:timestamp,time_label:string,hour:int>"))
    )


# ---- classification --------------------------------------------------------


def classify(text: Column) -> Column:
    """struct(action, status) of the first matching rule; a block verb overrides the status."""
    blocked = text.rlike(pattern(fv.BLOCK_VERB_PATTERN))

    def outcome(action: str, status: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), status.alias("status"))

    def ruled(action: str, status: str) -> Column:
        return outcome(action, F.when(blocked, F.lit("blocked")).otherwise(F.lit(status)))

    first_regex, first_action, first_status = fv.CLASSIFICATION_RULES[0]
    chain = reduce(
        lambda acc, rule: acc.when(text.rlike(pattern(rule[0])), ruled(rule[1], rule[2])),
        fv.CLASSIFICATION_RULES[1:],
        F.when(text.rlike(pattern(first_regex)), ruled(first_action, first_status)),
    )
    return (
        chain.when(blocked, outcome("blocked_traffic", F.lit("blocked")))
        .when(text.rlike(pattern(fv.SYSTEM_ALERT_PATTERN)), outcome("system_alert", F.lit("flagged")))
        .otherwise(outcome("event", F.lit("info")))
    )


def normalize_action(raw: Column) -> Column:
    snake = F.regexp_replace(F.lower(strip(raw)), r"[\s\-]+", "_")
    return F.regexp_replace(snake, r"[^a-z0-9_]", "")


def normalize_status(raw: Column, fallback: Column) -> Column:
    lowered = F.lower(raw)
    return reduce(
        lambda acc, rule: acc.when(lowered.rlike(pattern(rule[0], False)), F.lit(rule[1])),
        fv.STATUS_WORD_PATTERNS[1:],
        F.when(lowered.rlike(pattern(fv.STATUS_WORD_PATTERNS[0][0], False)), F.lit(fv.STATUS_WORD_PATTERNS[0][1])),
    ).otherwise(fallback)


def is_alert(status: Column) -> Column:
    return F.coalesce(status.isin(*fv.ALERT_STATUSES), F.lit(False))


def feed_status(status: Column) -> Column:
    return F.when(status == "info", F.lit("success")).otherwise(status)


# ---- scoring bands and display text ----------------------------------------


def severity_from_risk(risk: Column) -> Column:
    (top, name), *rest = fv.SEVERITY_BANDS
    return reduce(lambda acc, b: acc.when(risk >= b[0], b[1]), rest, F.when(risk >= top, name)).otherwise("Low")


def status_from_severity(severity: Column) -> Column:
    return (
        F.when(severity.isin("Critical", "High"), "Investigating")
        .when(severity == "Medium", "Open")
        .otherwise("Monitoring")
    )


def asset_type(name: Column) -> Column:
    lowered = F.lower(name)
    (first, label), *rest = fv.ASSET_TYPE_PATTERNS
    return reduce(
        lambda acc, p: acc.when(lowered.rlike(p[0]), p[1]), rest, F.when(lowered.rlike(first), label)
    ).otherwise(fv.DEFAULT_ASSET_TYPE)


def humanize_action(action: Column) -> Column:
    words = F.transform(
        F.split(action, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    )
    return F.array_join(words, " ")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit(ELLIPSIS))).otherwise(text)


def shortened(digest: Column) -> Column:
    return F.concat(F.left(digest, F.lit(4)), F.lit(ELLIPSIS), F.right(digest, F.lit(4)))


def sha256_short(text: Column) -> Column:
    return shortened(F.sha2(text, 256))


def normalize_question(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def shift_time(hhmm: Column, minutes: Column | int) -> Column:
    """HH:MM moved by whole minutes, modulo 24 hours."""
    delta = F.lit(minutes) if isinstance(minutes, int) else minutes
    parts = F.split(hhmm, ":")
    total = F.pmod(parts[0].cast("int") * 60 + parts[1].cast("int") + delta, F.lit(1440))
    return F.concat(
        F.lpad(F.floor(total / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((total % 60).cast("string"), 2, "0"),
    )


def run_label(label: str | None = None) -> Column:
    """The caller's label, else the current time as ``yyyy-MM-dd HH:mm UTC``."""
    if label:
        return F.lit(label)
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def source_name(url: Column) -> Column:
    """host/last-path-segment of a URL; text that is no URL keeps its first 60 characters."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)
    tail = F.try_element_at(segments, F.lit(-1))
    return F.when(F.length(host) == 0, F.substring(url, 1, 60)).otherwise(
        F.when(tail.isNull(), host).otherwise(F.concat(host, F.lit("/"), tail))
    )


def dataset_label(names: Column) -> Column:
    """Label of a list of source names: the first URL, the only file, or the file count."""
    url = F.get(F.filter(names, lambda n: n.startswith("http")), F.lit(0))
    return (
        F.when(url.isNotNull(), F.concat(F.lit("Connected: "), url))
        .when(F.size(names) == 1, names[0])
        .otherwise(F.concat(F.size(names).cast("string"), F.lit(" uploaded files")))
    )


# ---- scores of the model side ----------------------------------------------


def risk_score(raw: Column, score_low: Column | float, score_high: Column | float) -> Column:
    """0-100 risk of a decision value (higher = more normal) between calibration bounds."""
    low = F.lit(score_low) if isinstance(score_low, (int, float)) else score_low
    high = F.lit(score_high) if isinstance(score_high, (int, float)) else score_high
    clipped = F.greatest(low, F.least(high, raw))
    normal_ness = (clipped - low) / (high - low + F.lit(1e-12))
    return clamp(0.0, 100.0, (F.lit(1.0) - normal_ness) * 100.0)


def risk_bucket(risk: Column) -> Column:
    return F.when(risk <= 25, "Low").when(risk <= 50, "Medium").when(risk <= 75, "High").otherwise("Critical")


def score_tone(score: Column) -> Column:
    return F.when(score >= 70, "signal").when(score >= 40, "caution").otherwise("clearance")
