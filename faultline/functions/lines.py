"""Expressions over one log line: timestamps, levels, masks, tokens, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import (as_col, bound, compute_once, contains_any, first_match, found, found_all, has_sign,
                                      lookup, squeeze, strip)
from faultline.rules import formats, patterns

# ---------------------------------------------------------------- timestamps


def _instant(text: Column) -> Column:
    """Parse ``Y-m-d H:M:S[.f]`` as UTC whatever the session zone is; null if it is no date."""
    return F.concat(F.regexp_replace(text, r"\s+", " "), F.lit("Z")).try_cast("timestamp")


def _uptime(seconds: Column, base_micros: Column | None) -> Column:
    micros = (seconds.try_cast("decimal(20,6)") * F.lit(1000000)).cast("bigint")
    if base_micros is not None:
        micros = micros + base_micros
    return F.timestamp_micros(micros)


_MONTHS = {m: f"{i:02d}" for i, m in enumerate(
    ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"], 1)}


def _syslog(text: Column, year: Column) -> Column:
    month = lookup(_MONTHS, F.initcap(F.left(text, F.lit(3))))
    day = F.lpad(F.regexp_extract(text, r"^\w{3}\s+(\d{1,2})", 1), 2, "0")
    clock = F.regexp_extract(text, r"(\d{2}:\d{2}:\d{2}(?:\.\d+)?)$", 1)
    return _instant(F.concat(year.cast("string"), F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock))


def _iso(raw: Column) -> Column:
    """ISO text with zone keeps its zone; without one it is UTC."""
    zoned = raw.rlike(r"(Z|[+-]\d{2}:\d{2})$")
    return F.when(zoned, raw.try_cast("timestamp")).otherwise(_instant(raw))


def _gate(line: Column, ref_date, year, strict):
    base = F.unix_micros(ref_date) if ref_date is not None else None
    syslog_year = F.year(ref_date) if ref_date is not None else year

    def iso(raw):
        if strict:  # a Z suffix without a fraction is refused
            return F.when(~raw.rlike(r"Z$") | raw.rlike(r"\.\d{1,6}Z$"), _iso(raw))
        return _iso(raw)

    return [
        ("kernel", F.coalesce(found(line, formats.KERNEL_PRIORITY), found(line, formats.KERNEL_ANYWHERE)),
         lambda raw: _uptime(raw, base)),
        ("dtv_svc", found(line, formats.SERVICE), _instant),
        ("scpl", found(line, formats.SCPL_LEVELLED), lambda raw: _instant(F.translate(raw, ",", "."))),
        ("iso8601", found(line, formats.ISO), iso),
        ("syslog", found(line, formats.SYSLOG_START), lambda raw: _syslog(raw, syslog_year)),
    ]


def _multi(line: Column, ref_date, year, strict):
    def iso(raw):
        if strict:  # numeric zone offsets are refused
            return F.when(~raw.rlike(r"[+-]\d{2}:\d{2}$"), _iso(raw))
        return _iso(raw)

    return [
        ("iso8601", found(line, formats.ISO), iso),
        ("kernel_uptime", found(line, formats.KERNEL_START), lambda raw: _uptime(raw, None)),
        ("scpl", found(line, formats.SCPL_PLAIN), _instant),
        ("dtv_svc", found(line, formats.SLASHED), lambda raw: _instant(F.translate(raw, "/", "-"))),
        ("logcat", found(line, formats.LOGCAT), lambda raw: _instant(F.concat(year.cast("string"), F.lit("-"), raw))),
        ("syslog", found(line, formats.SYSLOG_ANYWHERE), lambda raw: _syslog(raw, year)),
    ]


def _engine(line: Column, ref_date, year, strict):
    def syslog(raw):
        if strict:  # a fraction on a syslog time is refused
            return F.when(~raw.contains("."), _syslog(raw, year))
        return _syslog(raw, year)

    return [
        ("iso8601", found(line, formats.ISO_UTC), _iso),
        ("logcat", found(line, formats.LOGCAT_START),
         lambda raw: _instant(F.concat(year.cast("string"), F.lit("-"), raw))),
        ("syslog", found(line, formats.SYSLOG_FRACTION), syslog),
        ("kernel_uptime", found(strip(line), formats.KERNEL_START), lambda raw: _uptime(raw, None)),
    ]


# Layouts per profile, whether a found text that is no date ends the search, and the name of no layout.
_PROFILES = {"gate": (_gate, False, "none"), "multi": (_multi, True, "unknown"),
             "engine": (_engine, False, "none")}


def with_timestamp(df: DataFrame, profile: str = "gate", line: str = "line",
                   ref_date: Column | str | None = None, year: Column | int = 2024,
                   strict: bool = False) -> DataFrame:
    """Add ``ts``, ``ts_format`` and ``ts_raw``.

    ``gate``   kernel, service, levelled, ISO, syslog; first that parses wins.
               ``ref_date`` (boot time, may be a column) anchors kernel uptimes and the syslog year.
    ``multi``  the first of six layouts that is found decides; ``year`` completes short dates.
    ``engine`` ISO, logcat, syslog, kernel; falls through where a text is no date.
    """
    ref = None if ref_date is None else as_col(ref_date)
    year_col = year if isinstance(year, Column) else F.lit(year)
    layouts, first_found, nothing = _PROFILES[profile]
    branches = layouts(F.col(line), ref, year_col, strict)
    # Staged, so every regex and every parse runs once per line.
    out = df.withColumns({f"_raw{i}": raw for i, (_, raw, _) in enumerate(branches)})
    out = out.withColumns({f"_at{i}": parse(F.col(f"_raw{i}")) for i, (_, _, parse) in enumerate(branches)})
    ts, name, text = F.lit(None).cast("timestamp"), F.lit(nothing), F.lit(None).cast("string")
    for i, (label, _, _) in reversed(list(enumerate(branches))):
        hit = F.col(f"_raw{i}" if first_found else f"_at{i}").isNotNull()
        ts = F.when(hit, F.col(f"_at{i}")).otherwise(ts)
        name = F.when(hit, F.lit(label)).otherwise(name)
        text = F.when(hit, F.col(f"_raw{i}")).otherwise(text)
    out = compute_once(out, {"ts": ts, "ts_format": name, "ts_raw": text})
    return out.drop(*[f"_{p}{i}" for p in ("raw", "at") for i in range(len(branches))])


def detect_ts_format(line: Column | str) -> Column:
    """Cheap layout guess from the characters a line contains."""
    line = as_col(line)
    head = F.regexp_extract(strip(line), r"^(\S+)", 1)
    one_dash = F.length(head) - F.length(F.replace(head, F.lit("-"), F.lit(""))) == 1
    return (
        F.when(line.contains("[  ") & line.contains("]") & line.contains("."), "KERNEL_UPTIME")
        .when(line.contains("T") & line.contains("Z"), "ISO8601")
        .when(line.contains("-") & line.contains(":") & line.contains("."),
              F.when(strip(line).rlike(r"^\d{2}-") & one_dash, "ANDROID_LOGCAT").otherwise("SYSLOG"))
        .otherwise("UNKNOWN")
    )


# -------------------------------------------------------------------- levels


def normalize_line(line: Column | str) -> Column:
    """Drop terminal colours and collapse white space."""
    return squeeze(F.regexp_replace(as_col(line), formats.ANSI, ""))


def log_level(line: Column | str, profile: str = "gate") -> Column:
    """Level named in a line; profiles ``gate``, ``utils`` and ``substr``."""
    line = as_col(line)
    if profile == "substr":
        upper = F.upper(line)
        out = F.lit(None).cast("string")
        for level in reversed(formats.CONTAINED_LEVELS):
            out = F.when(upper.contains(level), level).otherwise(out)
        return out
    regex, aliases = {
        "gate": (formats.GATE_LEVEL, formats.GATE_LEVEL_ALIASES),
        "utils": (formats.UTILS_LEVEL, formats.UTILS_LEVEL_ALIASES),
    }[profile]
    level = F.upper(found(line, regex))
    return F.coalesce(lookup(aliases, level), level)


def level_rank(level: Column | str) -> Column:
    return lookup(formats.LEVEL_RANK, as_col(level))


def is_error_level(line: Column | str) -> Column:
    return F.coalesce(log_level(line).isin("ERROR", "CRITICAL"), F.lit(False))


def http_status(line: Column | str) -> Column:
    line = as_col(line)
    return F.coalesce(*[found(line, formats.HTTP_STATUS, g) for g in (1, 2, 3)]).cast("int")


def is_http_error(line: Column | str) -> Column:
    return F.coalesce(http_status(line) >= 400, F.lit(False))


# ------------------------------------------------------------ masks and tokens


def mask_line(line: Column | str) -> Column:
    """Replace the varying parts of a line by placeholders, in the fixed rule order.

    Most rules match few lines, and their word boundaries are costly to look for: each is tried only where its cheap sign is found.
    """
    def masked(regex, value, sign):
        return lambda x: F.when(has_sign(x, sign), F.regexp_replace(x, regex, value)).otherwise(x)

    out = as_col(line)
    for regex, replacement in formats.MASKS:
        value, sign = replacement.replace("\\1", "$1"), formats.MASK_SIGNS[regex]
        out = F.regexp_replace(out, regex, value) if sign is None else bound(out, masked(regex, value, sign))
    return out


def mask_values(line: Column | str) -> Column:
    """What the rules with a placeholder find in a line, in rule order."""
    text = as_col(line)

    def values(regex):
        hits, sign = F.regexp_extract_all(text, F.lit(regex), 0), formats.MASK_SIGNS[regex]
        return hits if sign is None else F.when(text.isNull() | has_sign(text, sign), hits).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[values(regex) for regex, replacement in formats.MASKS if replacement]))


def upper_tokens(line: Column | str, limit: int | None = 3) -> Column:
    """Distinct upper-case tokens in order of appearance."""
    tokens = F.array_distinct(found_all(as_col(line), formats.UPPER_TOKEN))
    return tokens if limit is None else F.slice(tokens, 1, limit)


def ident_tokens(line: Column | str, limit: int | None = 5) -> Column:
    """Distinct identifier-like tokens in order of appearance."""
    tokens = F.array_distinct(found_all(as_col(line), formats.IDENT_TOKEN))
    return tokens if limit is None else F.slice(tokens, 1, limit)


def error_type(line: Column | str) -> Column:
    """First of the ten error classes found in a line, else null."""
    return first_match(as_col(line), patterns.ERROR_TYPES)


def is_hardware_error(line: Column | str) -> Column:
    return as_col(line).rlike("(?i)" + "|".join(patterns.HARDWARE_REGEXES))


def is_incident_line(line: Column | str) -> Column:
    return as_col(line).rlike("(?i)" + patterns.INCIDENT_REGEX)


def sanitizer_line(line: Column | str) -> Column:
    return as_col(line).rlike(formats.SANITIZER_LINE)


def sanitizer_labels(output: Column | str) -> Column:
    output = as_col(output)
    return F.array_compact(F.array(*[
        F.when(output.contains(needle), label) for needle, label in formats.SANITIZER_LABELS]))


def test_count(output: Column | str, which: str = "pass") -> Column:
    """Sum of the stated numbers, one for each bare word."""
    hits = found_all(as_col(output), formats.TEST_PASS if which == "pass" else formats.TEST_FAIL, 1)
    return F.aggregate(hits, F.lit(0).cast("bigint"),
                       lambda acc, x: acc + F.when(x == "", F.lit(1)).otherwise(x.cast("bigint")))


def has_generic_error(text: Column) -> Column:
    from faultline.rules.vocab import GENERIC_ERROR_WORDS

    return contains_any(F.lower(text), GENERIC_ERROR_WORDS)
