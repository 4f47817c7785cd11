"""Line expressions (timestamps, levels, masks, tokens, classes) over rendered logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.logview import BOOT, BOOT_US, LINES_SQL, YEAR, event_lines
from faultline.functions import lines as L
from faultline.rules import formats, patterns


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def ex(pattern: str, group: int = 1, col: str = "line") -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


MONTHS = "'JanFebMarAprMayJunJulAugSepOctNovDec'"


def inst(expr: str) -> str:
    return f"epoch_us(try_cast(regexp_replace({expr}, '\\s+', ' ', 'g') AS timestamp))"


def syslog(expr: str) -> str:
    month = f"lpad(cast((strpos({MONTHS}, substr({expr}, 1, 3)) + 2) // 3 AS varchar), 2, '0')"
    day = f"lpad(regexp_extract({expr}, '^\\w{{3}}\\s+(\\d{{1,2}})', 1), 2, '0')"
    clock = f"regexp_extract({expr}, '(\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?)$', 1)"
    return inst(f"'{YEAR}-' || {month} || '-' || {day} || ' ' || {clock}")


def uptime(expr: str, base: int) -> str:
    return f"cast(cast({expr} AS decimal(20,6)) * 1000000 AS bigint) + {base}"


def iso(expr: str) -> str:
    return f"epoch_us(try_cast(replace(replace({expr}, 'T', ' '), 'Z', '') AS timestamp))"


# ---- oracle timestamp of the three profiles, as a CTE over ``lines``
GATE_SQL = f"""g0 AS (
  SELECT *, coalesce({ex(formats.KERNEL_PRIORITY)}, {ex(formats.KERNEL_ANYWHERE)}) AS kr,
    {ex(formats.SERVICE)} AS sv, {ex(formats.SCPL_LEVELLED)} AS sc, {ex(formats.ISO)} AS io,
    {ex(formats.SYSLOG_START)} AS sy FROM lines),
g1 AS (SELECT *, {uptime('kr', BOOT_US)} AS t1, {inst('sv')} AS t2, {inst("replace(sc, ',', '.')")} AS t3,
    {iso('io')} AS t4, {syslog('sy')} AS t5 FROM g0),
gate AS (SELECT log_id, line_no, line, event_id, k, coalesce(t1, t2, t3, t4, t5) AS ts_us,
    CASE WHEN t1 IS NOT NULL THEN 'kernel' WHEN t2 IS NOT NULL THEN 'dtv_svc' WHEN t3 IS NOT NULL THEN 'scpl'
         WHEN t4 IS NOT NULL THEN 'iso8601' WHEN t5 IS NOT NULL THEN 'syslog' ELSE 'none' END AS ts_format,
    CASE WHEN t1 IS NOT NULL THEN kr WHEN t2 IS NOT NULL THEN sv WHEN t3 IS NOT NULL THEN sc
         WHEN t4 IS NOT NULL THEN io WHEN t5 IS NOT NULL THEN sy END AS ts_raw FROM g1)"""

MULTI_SQL = f"""m0 AS (
  SELECT *, {ex(formats.ISO)} AS io, {ex(formats.KERNEL_START)} AS kr, {ex(formats.SCPL_PLAIN)} AS sc,
    {ex(formats.SLASHED)} AS sl, {ex(formats.LOGCAT)} AS lc, {ex(formats.SYSLOG_ANYWHERE)} AS sy FROM lines),
multi AS (SELECT log_id, line_no, line, event_id, k,
    CASE WHEN io IS NOT NULL THEN {iso('io')} WHEN kr IS NOT NULL THEN {uptime('kr', 0)}
         WHEN sc IS NOT NULL THEN {inst('sc')} WHEN sl IS NOT NULL THEN {inst("replace(sl, '/', '-')")}
         WHEN lc IS NOT NULL THEN {inst(f"'{YEAR}-' || lc")} WHEN sy IS NOT NULL THEN {syslog('sy')} END AS ts_us,
    CASE WHEN io IS NOT NULL THEN 'iso8601' WHEN kr IS NOT NULL THEN 'kernel_uptime'
         WHEN sc IS NOT NULL THEN 'scpl' WHEN sl IS NOT NULL THEN 'dtv_svc'
         WHEN lc IS NOT NULL THEN 'logcat' WHEN sy IS NOT NULL THEN 'syslog' ELSE 'unknown' END AS ts_format
  FROM m0)"""

ENGINE_SQL = f"""e0 AS (
  SELECT *, {ex(formats.ISO_UTC)} AS io,
    {ex(formats.LOGCAT_START)} AS lc, {ex(formats.SYSLOG_FRACTION)} AS sy,
    {ex(formats.KERNEL_START, 1, 'trim(line)')} AS kr FROM lines),
e1 AS (SELECT *, {iso('io')} AS t1, {inst(f"'{YEAR}-' || lc")} AS t2, {syslog('sy')} AS t3,
    {uptime('kr', 0)} AS t4 FROM e0),
engine AS (SELECT log_id, line_no, line, event_id, k, coalesce(t1, t2, t3, t4) AS ts_us,
    CASE WHEN t1 IS NOT NULL THEN 'iso8601' WHEN t2 IS NOT NULL THEN 'logcat' WHEN t3 IS NOT NULL THEN 'syslog'
         WHEN t4 IS NOT NULL THEN 'kernel_uptime' ELSE 'none' END AS ts_format FROM e1)"""


def gate_lines(spark, sf):
    return L.with_timestamp(event_lines(spark, sf), "gate", ref_date=F.lit(BOOT).cast("timestamp"))


def multi_lines(spark, sf):
    return L.with_timestamp(event_lines(spark, sf), "multi", year=YEAR)


def engine_lines(spark, sf):
    return L.with_timestamp(event_lines(spark, sf), "engine", year=YEAR)


def _ts(df):
    return df.withColumn("ts_us", F.unix_micros("ts"))


@check("b1a_timestamps_gate", f"WITH {LINES_SQL}, {GATE_SQL} SELECT log_id, line_no, ts_us, ts_format, ts_raw FROM gate")
def b1a(spark, sf):
    return _ts(gate_lines(spark, sf)).select("log_id", "line_no", "ts_us", "ts_format", "ts_raw")


@check("b1b_timestamps_multi", f"WITH {LINES_SQL}, {MULTI_SQL} SELECT log_id, line_no, ts_us, ts_format FROM multi")
def b1b(spark, sf):
    return _ts(multi_lines(spark, sf)).select("log_id", "line_no", "ts_us", "ts_format")


@check("b1c_timestamps_engine", f"WITH {LINES_SQL}, {ENGINE_SQL} SELECT log_id, line_no, ts_us, ts_format FROM engine")
def b1c(spark, sf):
    return _ts(engine_lines(spark, sf)).select("log_id", "line_no", "ts_us", "ts_format")


@check("b2_timestamp_layout_guess", f"""WITH {LINES_SQL} SELECT log_id, line_no,
  CASE WHEN contains(line, '[  ') AND contains(line, ']') AND contains(line, '.') THEN 'KERNEL_UPTIME'
       WHEN contains(line, 'T') AND contains(line, 'Z') THEN 'ISO8601'
       WHEN contains(line, '-') AND contains(line, ':') AND contains(line, '.') THEN
         CASE WHEN regexp_matches(trim(line), '^\\d{{2}}-')
               AND len(string_split(string_split(trim(line), ' ')[1], '-')) = 2 THEN 'ANDROID_LOGCAT' ELSE 'SYSLOG' END
       ELSE 'UNKNOWN' END AS ts_format FROM lines""")
def b2(spark, sf):
    return event_lines(spark, sf).select("log_id", "line_no", L.detect_ts_format("line").alias("ts_format"))


@check("b3_normalized_lines", f"""WITH {LINES_SQL} SELECT log_id, line_no,
  trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines""")
def b3(spark, sf):
    coloured = F.concat(F.lit("\x1b[1;35m"), F.col("line"), F.lit(" \x1b[m\t "))
    return event_lines(spark, sf).select("log_id", "line_no", L.normalize_line(coloured).alias("line"))


LEVEL = f"upper({ex(formats.GATE_LEVEL)})"
LEVEL_SQL = f"""CASE {LEVEL} WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'CRIT' THEN 'CRITICAL'
  WHEN 'FATAL' THEN 'CRITICAL' ELSE {LEVEL} END"""
UTILS = f"upper({ex(formats.UTILS_LEVEL)})"


@check("b4_log_levels", f"""WITH {LINES_SQL} SELECT log_id, line_no, {LEVEL_SQL} AS gate_level,
  CASE {UTILS} WHEN 'WARN' THEN 'WARNING' WHEN 'ERR' THEN 'ERROR' WHEN 'WTF' THEN 'FATAL' ELSE {UTILS} END AS utils_level,
  CASE WHEN contains(upper(line), 'ERROR') THEN 'ERROR' WHEN contains(upper(line), 'ERR') THEN 'ERR'
       WHEN contains(upper(line), 'WARN') THEN 'WARN' WHEN contains(upper(line), 'INFO') THEN 'INFO'
       WHEN contains(upper(line), 'DEBUG') THEN 'DEBUG' END AS substr_level FROM lines""")
def b4(spark, sf):
    return event_lines(spark, sf).select(
        "log_id", "line_no", L.log_level("line").alias("gate_level"),
        L.log_level("line", "utils").alias("utils_level"), L.log_level("line", "substr").alias("substr_level"))


STATUS_SQL = "cast(coalesce(" + ", ".join(ex(formats.HTTP_STATUS, g) for g in (1, 2, 3)) + ") AS integer)"


@check("b5_error_lines_and_http", f"""WITH {LINES_SQL} SELECT log_id, line_no,
  coalesce({LEVEL_SQL} IN ('ERROR', 'CRITICAL'), false) AS is_error, {STATUS_SQL} AS http_status,
  coalesce({STATUS_SQL} >= 400, false) AS is_http_error FROM lines""")
def b5(spark, sf):
    return event_lines(spark, sf).select(
        "log_id", "line_no", L.is_error_level("line").alias("is_error"),
        L.http_status("line").alias("http_status"), L.is_http_error("line").alias("is_http_error"))


MASK_SQL = "line"
for _regex, _to in formats.MASKS:
    MASK_SQL = f"regexp_replace({MASK_SQL}, {q(_regex)}, {q(_to)}, 'g')"


@check("b6_masked_lines", f"WITH {LINES_SQL} SELECT log_id, line_no, {MASK_SQL} AS masked FROM lines")
def b6(spark, sf):
    return event_lines(spark, sf).select("log_id", "line_no", L.mask_line("line").alias("masked"))


def distinct_first(tokens: str, n: int | None) -> str:
    """First n distinct list elements in order of appearance."""
    kept = f"list_filter({tokens}, lambda x, i: list_position({tokens}, x) = i)"
    return f"({kept})[1:{n}]" if n else kept


UPPER_SQL = f"regexp_extract_all(line, {q(formats.UPPER_TOKEN)})"
IDENT_SQL = f"regexp_extract_all(line, {q(formats.IDENT_TOKEN)})"


@check("b7_tokens", f"""WITH {LINES_SQL} SELECT log_id, line_no,
  array_to_string({distinct_first(UPPER_SQL, 3)}, ' ') AS upper_tokens,
  array_to_string({distinct_first(IDENT_SQL, 5)}, ' ') AS ident_tokens FROM lines""")
def b7(spark, sf):
    return event_lines(spark, sf).select(
        "log_id", "line_no", F.array_join(L.upper_tokens("line"), " ").alias("upper_tokens"),
        F.array_join(L.ident_tokens("line"), " ").alias("ident_tokens"))


TYPE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(line, {q('(?i)' + p)}) THEN '{n}'" for n, p in patterns.ERROR_TYPES) + " END"


@check("b8_error_types", f"WITH {LINES_SQL} SELECT log_id, line_no, {TYPE_SQL} AS error_type FROM lines")
def b8(spark, sf):
    return event_lines(spark, sf).select("log_id", "line_no", L.error_type("line").alias("error_type"))
