"""Crash logs rendered from orders, kernel lines, browser traces and source maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, table
from checks.lines import q
from checks.logview import LINES_SQL, event_lines
from checks.temporal import rounded
from faultline.operators import browser, crash
from faultline.rules import formats, vocab
from faultline.sources import traces

# A crash per order: a maps section and a backtrace, one entry per order line.
_CRASH = """SELECT * FROM (
  SELECT o_orderkey AS crash_id, 1 AS line_no, 'signal 11 (SIGSEGV), code 1' AS line FROM {o}
  UNION ALL SELECT o_orderkey, 2, concat('/proc/', cast(o_custkey AS {s}), '/maps:') FROM {o}
  UNION ALL SELECT l_orderkey, 1000 + n, concat(lower(hex(base)), '-', lower(hex(base + 65536)), CASE WHEN l_returnflag = 'N' THEN ' rw-p ' ELSE ' r-xp ' END,
    '00000000 08:01 ', cast(l_partkey AS {s}), ' /3rd/loki/lib/lib', cast(l_suppkey % 9 AS {s}), '.so ') FROM li
  UNION ALL SELECT o_orderkey, 5000, ' ' FROM {o}
  UNION ALL SELECT l_orderkey, 4000 + n, 'ffff0000-ffff1000 r-xp 00000000 08:01 1 /late/lib0.so' FROM li WHERE l_quantity > 49
  UNION ALL SELECT o_orderkey, 5001, 'Backtrace:' FROM {o}
  UNION ALL SELECT l_orderkey, 6000 + n, concat('#', lpad(cast(n AS {s}), 2, '0'), ' pc ', lower(hex(base + cast(floor(l_extendedprice) AS bigint) % 60000)), CASE WHEN l_linenumber = 7 THEN ' /x/lib' ELSE ' lib' END,
    cast(l_suppkey % 9 AS {s}), CASE WHEN l_tax > 0.05 THEN '.so (run+4)' ELSE '.so' END) FROM li
) x"""
_LI = """SELECT *, 2130706432 + (l_suppkey % 9) * 1048576 + l_orderkey % 16 * 4096 AS base,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM {l}"""
CRASH_SQL = f"li AS ({_LI.format(l='lineitem')}), crash AS ({_CRASH.format(o='orders', s='varchar')})"
_SYMBOLS = """SELECT concat('lib', cast(s_suppkey % 7 AS {s}), '.so') AS library, cast(s_suppkey * 640 AS bigint) AS start_offset,
  cast(s_suppkey * 640 + 600 AS bigint) AS end_offset, CASE WHEN s_suppkey % 11 = 3 THEN '??' ELSE concat('fn', cast(s_suppkey AS {s})) END AS function,
  CASE WHEN s_suppkey % 11 = 3 THEN '??' ELSE 'a.cpp' END AS file, cast(s_suppkey % 90 AS int) AS line FROM {t}"""


# The same rows with each table read once: the lines of an order line, and of an order, are made from one row.
_CRASH_ONCE = """SELECT crash_id, v.line_no, v.line FROM (
  SELECT l_orderkey AS crash_id, inline(filter(array(
    struct(1000 + n AS line_no, concat(lower(hex(base)), '-', lower(hex(base + 65536)), CASE WHEN l_returnflag = 'N' THEN ' rw-p ' ELSE ' r-xp ' END,
      '00000000 08:01 ', cast(l_partkey AS string), ' /3rd/loki/lib/lib', cast(l_suppkey % 9 AS string), '.so ') AS line),
    CASE WHEN l_quantity > 49 THEN struct(4000 + n AS line_no, 'ffff0000-ffff1000 r-xp 00000000 08:01 1 /late/lib0.so' AS line) END,
    struct(6000 + n AS line_no, concat('#', lpad(cast(n AS string), 2, '0'), ' pc ', lower(hex(base + cast(floor(l_extendedprice) AS bigint) % 60000)), CASE WHEN l_linenumber = 7 THEN ' /x/lib' ELSE ' lib' END,
      cast(l_suppkey % 9 AS string), CASE WHEN l_tax > 0.05 THEN '.so (run+4)' ELSE '.so' END) AS line)), x -> x IS NOT NULL)) AS (line_no, line) FROM {li}
  UNION ALL SELECT o_orderkey, inline(array(struct(1 AS line_no, 'signal 11 (SIGSEGV), code 1' AS line), struct(2 AS line_no, concat('/proc/', cast(o_custkey AS string), '/maps:') AS line),
    struct(5000 AS line_no, ' ' AS line), struct(5001 AS line_no, 'Backtrace:' AS line))) AS (line_no, line) FROM {o}) v"""


def crash_lines(spark, sf):
    li = spark.sql(_LI.format(l="{l}"), l=table(spark, sf, "lineitem"))
    return spark.sql(_CRASH_ONCE, o=table(spark, sf, "orders"), li=li)


def symbols(spark, sf):
    return spark.sql(_SYMBOLS.format(s="string", t="{t}"), t=table(spark, sf, "supplier"))


def hexv(e: str) -> str:
    return f"cast(('0x' || {e}) AS bigint)"


MAPS_SQL = f"""maps AS (SELECT crash_id, line_no, regexp_extract(line, {q(formats.LOAD_MAP)}, ['a', 'b', 'p', 'f']) AS m FROM crash
    WHERE line_no > 2 AND line_no < 5000 AND regexp_matches(line, {q(formats.LOAD_MAP)})),
lm AS (SELECT crash_id, line_no, regexp_extract(trim(m.f), '[^/]*$') AS library, {hexv('m.a')} AS load_address, {hexv('m.b')} AS end_address, m.p AS permissions
  FROM maps WHERE contains(m.p, 'x')),
fr AS (SELECT crash_id, line_no, cast(m.n AS integer) AS frame_no, m.l AS library, {hexv('m.p')} AS pc FROM (
  SELECT crash_id, line_no, regexp_extract(line, {q(formats.FRAME)}, ['n', 'p', 'l', 's']) AS m FROM crash WHERE regexp_matches(line, {q(formats.FRAME)})))"""


def _ints(df, *columns):
    return df.withColumns({c: F.col(c).cast("bigint") for c in (*columns, "line_no")})


@check("g1_load_maps", f"WITH {CRASH_SQL}, {MAPS_SQL} SELECT * FROM lm")
def g1(spark, sf):
    return _ints(crash.parse_load_maps(crash_lines(spark, sf)), "load_address", "end_address")


@check("g1_load_maps_tombstone", f"""WITH {CRASH_SQL} SELECT crash_id, line_no, m.f AS library, {hexv('m.a')} AS load_address FROM (
  SELECT crash_id, line_no, regexp_extract(line, {q(formats.LOAD_MAP_TOMBSTONE)}, ['a', 'f']) AS m FROM crash WHERE regexp_matches(line, {q(formats.LOAD_MAP_TOMBSTONE)}))""")
def g1_tombstone(spark, sf):
    return _ints(crash.parse_load_maps(crash_lines(spark, sf), variant="tombstone"), "load_address")


@check("g2_backtrace", f"WITH {CRASH_SQL}, {MAPS_SQL} SELECT * FROM fr")
def g2(spark, sf):
    return _ints(crash.parse_backtrace(crash_lines(spark, sf)), "pc")


D7_SQL = """ba AS (SELECT crash_id, library, arg_max(load_address, line_no) AS base FROM lm GROUP BY ALL),
fo AS (SELECT fr.*, pc - base AS file_offset, CASE WHEN base IS NULL THEN 'ASLR_UNKNOWN' END AS status FROM fr LEFT JOIN ba USING (crash_id, library))"""


@check("d7_aslr_correct", f"WITH {CRASH_SQL}, {MAPS_SQL}, {D7_SQL} SELECT * FROM fo")
def d7(spark, sf):
    lines = crash_lines(spark, sf)
    return _ints(crash.aslr_correct(crash.parse_backtrace(lines), crash.parse_load_maps(lines)), "pc", "file_offset")


D8_SQL = f"""sy AS ({_SYMBOLS.format(s='varchar', t='supplier')}),
sf AS (SELECT fo.*, nullif(function, '??') AS function, nullif(file, '??') AS file, nullif(sy.line, 0) AS line FROM fo
  LEFT JOIN sy ON sy.library = fo.library AND file_offset >= start_offset AND file_offset < end_offset),
symd AS (SELECT crash_id, line_no, frame_no, library, file_offset, function, file, line, coalesce(status, CASE WHEN library NOT IN (SELECT library FROM sy) THEN 'NO_DEBUG_ELF'
  WHEN function IS NULL AND file IS NULL THEN 'ADDR2LINE_FAIL' ELSE 'OK' END) AS status FROM sf)"""


def symbolicated(spark, sf):
    return crash.symbolicate(crash_lines(spark, sf), symbols(spark, sf))


@check("d8_g3_symbolicate", f"WITH {CRASH_SQL}, {MAPS_SQL}, {D7_SQL}, {D8_SQL} SELECT * FROM symd")
def d8(spark, sf):
    out = symbolicated(spark, sf).select("crash_id", "line_no", "frame_no", "library", "file_offset", "function", "file", "line", "status")
    return _ints(out, "file_offset")


@check("e14_symbolication_rate", f"""WITH {CRASH_SQL}, {MAPS_SQL}, {D7_SQL}, {D8_SQL} SELECT crash_id, count(*) AS frames,
  round(count(*) FILTER (WHERE status = 'OK') / count(*), 6) AS success_rate FROM symd GROUP BY crash_id""")
def e14(spark, sf):
    return rounded(crash.symbolication_rate(symbolicated(spark, sf)), "success_rate")


_FW = "concat(cast(4 + p_partkey % 4 AS {s}), '.', cast(p_size % 12 AS {s}), CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '.x' ELSE '.22.1' END)"


@check("d6_resolve_version", f"""WITH p AS (SELECT p_partkey, {_FW.format(s='varchar')} AS firmware FROM part),
  v AS (SELECT *, CASE WHEN contains(firmware, 'x') THEN [0, 0, 0] ELSE list_transform((string_split(firmware, '.'))[1:3], lambda x: x::int) END AS a FROM p)
  SELECT p_partkey, firmware, CASE WHEN a >= [5, 0, 0] AND a < [5, 5, 0] THEN 'v1.8.0' WHEN a >= [5, 5, 0] AND a < [5, 9, 0] THEN 'v1.9.0'
    WHEN a >= [5, 9, 0] AND a < [6, 0, 0] THEN 'v2.0.0' ELSE 'v2.1.0' END AS interface_version FROM v""")
def d6(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.expr(_FW.format(s="string")).alias("firmware"))
    return crash.resolve_version(parts).select("p_partkey", "firmware", "interface_version")


# Kernel text: every log line becomes one of a few dmesg lines.
_KERNEL = """CASE event_id % 13
  WHEN 0 THEN concat('[ 12.5] Unable to handle kernel NULL pointer dereference at virtual address ', lower(hex(event_id)))
  WHEN 1 THEN 'pc : [<7f8a51a4>] lr : [<7f8a5000>]' WHEN 2 THEN 'CPU: 0 Tainted: G    W  O' WHEN 3 THEN 'Call Trace:'
  WHEN 4 THEN '[<7f8a51a4>] mtk_vdec_run+0x1c/0x80' WHEN 5 THEN ' mali_kbase_job+0x20/0x44' WHEN 6 THEN 'raw trace line'
  WHEN 7 THEN '---[ end trace ]---' WHEN 8 THEN 'Kernel panic - not syncing: Fatal exception' WHEN 9 THEN ''
  WHEN 10 THEN 'kernel BUG at fs/ext4.c:12!' WHEN 11 THEN 'Internal error: Oops: 17 [#1]' ELSE line END"""


def kernel_lines(spark, sf):
    return event_lines(spark, sf).withColumn("line", F.expr(_KERNEL))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, {q(regex)}) THEN {{}}".format(q(name)) for name, regex in formats.OOPS_SIGNATURES) + " END"
_ADDRESS = "CASE " + " ".join(f"WHEN regexp_matches(line, {q(regex)}) THEN regexp_extract(line, {q(regex)}, 1)" for _, regex in formats.OOPS_SIGNATURES) + " END"
_SUBSYSTEM = "CASE " + " ".join("WHEN len(list_filter(call_trace, lambda x: " + " OR ".join(f"contains(lower(x), {q(n)})" for n in needles) + f")) > 0 THEN {q(name)}"
                                for name, needles in vocab.SUBSYSTEMS) + " ELSE 'UNKNOWN' END"


def oops_sql(source: str) -> str:
    """Recursive walk over the signatures of each log; the common table expressions end in ``oops``."""
    return f"""sg AS (SELECT log_id, line_no AS start, {_KIND} AS oops_type, {_ADDRESS} AS address FROM {source} WHERE {_KIND} IS NOT NULL),
bl AS (SELECT s.log_id, s.start, list(k.line ORDER BY k.line_no) AS l FROM sg s JOIN {source} k ON k.log_id = s.log_id AND k.line_no BETWEEN s.start AND s.start + 49 GROUP BY ALL),
px AS (SELECT *, nullif(regexp_extract(list_filter(l, lambda x: regexp_matches(x, {q(formats.OOPS_PC)}) AND NOT regexp_matches(x, {q(formats.OOPS_PC_SKIP)}))[1], {q(formats.OOPS_PC)}, 1), '') AS pc,
  regexp_extract(list_filter(l, lambda x: regexp_matches(x, {q(formats.OOPS_TAINTED)}))[1], {q(formats.OOPS_TAINTED)}, 1) AS flags,
  list_position(list_transform(l, lambda x: regexp_matches(x, {q(formats.OOPS_TRACE_START)})), true) AS opened FROM bl),
af AS (SELECT *, CASE WHEN opened > 0 THEN l[opened + 1:] ELSE [] END AS aft FROM px),
ef AS (SELECT *, list_position(list_transform(aft, lambda x: trim(x, {_BLANKS}) = '' OR contains(x, '---') OR contains(x, 'Unable to handle')), true) AS e FROM af),
tc AS (SELECT *, list_transform(list_filter(CASE WHEN e > 0 THEN aft[:e - 1] ELSE aft END, lambda x: NOT regexp_matches(x, {q(formats.OOPS_TRACE_START)})),
  lambda x: CASE WHEN regexp_matches(x, {q(formats.OOPS_TRACE_LINE)}) THEN regexp_extract(x, {q(formats.OOPS_TRACE_LINE)}, 1) || '+0x' || regexp_extract(x, {q(formats.OOPS_TRACE_LINE)}, 2)
    ELSE trim(x, {_BLANKS}) END) AS call_trace FROM ef),
pr AS (SELECT *, pc IS NOT NULL OR oops_type IN ('KERNEL_PANIC', 'BUG') AS accepted FROM tc JOIN sg USING (log_id, start)),
nx AS (SELECT a.log_id, a.start, min(b.start) AS nxt FROM pr a JOIN pr b ON b.log_id = a.log_id
  AND b.start >= a.start + CASE WHEN a.accepted THEN least(len(a.call_trace) + 5, 15) ELSE 1 END GROUP BY ALL),
wk AS (SELECT log_id, min(start) AS start FROM pr GROUP BY log_id UNION ALL SELECT wk.log_id, nxt FROM wk JOIN nx USING (log_id, start)),
oops AS (SELECT log_id, start AS line_no, oops_type,
  CASE WHEN regexp_matches(address, '^\\s*(0x)?[0-9a-fA-F]+\\s*$') THEN cast('0x' || regexp_replace(trim(address), '^0x', '') AS bigint) END AS faulting_address,
  coalesce({hexv('pc')}, 0) AS instruction_pointer, array_to_string(call_trace, ' | ') AS call_trace, coalesce(trim(flags, {_BLANKS}) <> '', false) AS tainted,
  try_cast(nullif(regexp_extract(l[1], '\\[\\s*(\\d+\\.\\d+)\\]', 1), '') AS double) AS uptime_seconds, {_SUBSYSTEM} AS subsystem
  FROM pr JOIN wk USING (log_id, start) WHERE accepted)"""


KERNEL_SQL = f"{LINES_SQL}, kl AS (SELECT log_id, line_no, {_KERNEL} AS line FROM lines), {oops_sql('kl')}"


@check("g4_parse_oops", f"WITH RECURSIVE {KERNEL_SQL} SELECT * FROM oops")
def g4(spark, sf):
    out = crash.parse_oops(kernel_lines(spark, sf))
    out = out.withColumn("call_trace", F.array_join("call_trace", " | "))
    return _ints(out, "faulting_address", "instruction_pointer")


@check("e13_g5_subsystem_counts", f"WITH RECURSIVE {KERNEL_SQL} SELECT subsystem, count(*) AS n FROM oops GROUP BY subsystem")
def e13(spark, sf):
    return crash.subsystem_counts(crash.parse_oops(kernel_lines(spark, sf)))


# Browser traces: a list, an envelope, a single event or broken text per conversation turn.
_EVENT = """concat('{"method":"', CASE turn % 4 WHEN 0 THEN 'Runtime.exceptionThrown' WHEN 1 THEN 'Console.messageAdded' WHEN 2 THEN 'Network.requestFailed' ELSE 'Page.load' END,
  '","params":{"timestamp":', cast(1700000000000 + conv_id AS STR), ',"errorText":"net::ERR","url":"http://a/', cast(conv_id AS STR),
  '.js","message":{"level":"', CASE WHEN conv_id % 2 = 0 THEN 'error' ELSE 'info' END, '","text":"m', cast(turn AS STR), '"},"exceptionDetails":{"text":"TypeError: x', cast(conv_id AS STR),
  '","url":"http://a/', cast(conv_id % 9 AS STR), '.js","lineNumber":', cast(1 + turn AS STR), ',"columnNumber":', cast(conv_id % 300 AS STR),
  ',"stackTrace":{"callFrames":[{"url":"http://b/', cast(conv_id % 12 AS STR), '.js","lineNumber":2,"columnNumber":', cast(conv_id % 50 AS STR), ',"functionName":"f"},{"url":"http://c.js"}]}}}}')"""


def trace_rows(spark, sf):
    c = table(spark, sf, "conversations")
    ev = F.expr(_EVENT.replace("STR", "string"))
    case = F.col("conv_id") % 5
    payload = (F.when(case == 0, F.concat(F.lit("["), ev, F.lit(",7,"), ev, F.lit("]")))
               .when(case == 1, F.concat(F.lit('{"traceEvents":['), ev, F.lit(',{"name":"x"}]}')))
               .when(case == 2, ev).when(case == 3, F.lit('{"other":1}')).otherwise(F.concat(F.lit("broken "), ev)))
    return c.select("conv_id", "turn", payload.alias("payload"))


# The oracle needs no parsing: it knows which turns carry which event.
_N = "tr AS (SELECT conv_id, turn, unnest(CASE conv_id % 5 WHEN 0 THEN [0, 2] WHEN 1 THEN [0] WHEN 2 THEN [0] ELSE [] END)::bigint AS position FROM conversations)"
_METHOD = "CASE turn % 4 WHEN 0 THEN 'Runtime.exceptionThrown' WHEN 1 THEN 'Console.messageAdded' WHEN 2 THEN 'Network.requestFailed' ELSE 'Page.load' END"


def _events(spark, sf):
    return traces.trace_events(trace_rows(spark, sf), keys=["conv_id", "turn"])


@check("a8_trace_events", f"WITH {_N} SELECT conv_id, turn, position, {_METHOD} AS method, (1700000000000 + conv_id) * 1000 AS ts_us FROM tr")
def a8(spark, sf):
    out = _events(spark, sf)
    return out.select("conv_id", "turn", F.col("position").cast("bigint").alias("position"), "method", F.unix_micros("ts").alias("ts_us"))


@check("g6_trace_exceptions", f"""WITH {_N} SELECT conv_id, turn, position, 'TypeError' AS exception_type, 'TypeError: x' || conv_id AS message,
  'f at http://b/' || conv_id % 12 || '.js:2:' || conv_id % 50 || ' | <anonymous> at http://c.js:0:0' AS stack, 'http://a/' || conv_id % 9 || '.js' AS url,
  1 + turn AS line_number, conv_id % 300 AS column_number FROM tr WHERE turn % 4 = 0""")
def g6(spark, sf):
    out = browser.trace_exceptions(_events(spark, sf), keys=["conv_id", "turn"])
    return out.select("conv_id", "turn", F.col("position").cast("bigint").alias("position"), "exception_type", "message",
                      F.array_join("stack_trace", " | ").alias("stack"), "url", "line_number", "column_number")


@check("g6_console_and_network_errors", f"""WITH {_N} SELECT conv_id, turn, position, CASE turn % 4 WHEN 1 THEN 'm' || turn
  ELSE 'Network error: net::ERR for http://a/' || conv_id || '.js' END AS text FROM tr WHERE turn % 4 = 2 OR (turn % 4 = 1 AND conv_id % 2 = 0)""")
def g6_text(spark, sf):
    events, keys = _events(spark, sf), ["conv_id", "turn"]
    out = browser.console_errors(events, keys).unionByName(browser.network_errors(events, keys))
    return out.withColumn("position", F.col("position").cast("bigint"))


# Source-map segments straight from order lines; one bundle per part.
_SEGMENTS = """SELECT concat('http://a/', cast(l_partkey % 7 AS {s}), '.js') AS url, cast(l_linenumber AS bigint) AS gen_line, l_suppkey * 3 AS gen_col,
  min(l_orderkey) AS orig_line, max(l_partkey) AS orig_col, min(CASE WHEN l_quantity > 1 THEN concat('s', cast(l_quantity AS {s})) END) AS source,
  cast(NULL AS {s}) AS name, cast(0 AS int) AS segment_no FROM {l} GROUP BY 1, 2, 3"""


@check("d9_map_js_frames", f"""WITH {_N}, sg AS ({_SEGMENTS.format(s='varchar', l='lineitem')}),
  fr AS (SELECT conv_id, turn, position, 0 AS frame_no, 'http://a/' || conv_id % 9 || '.js' AS url, 1 + turn AS line, conv_id % 300 AS col FROM tr WHERE turn % 4 = 0
    UNION ALL SELECT conv_id, turn, position, 1, 'http://b/' || conv_id % 12 || '.js', 2, conv_id % 50 FROM tr WHERE turn % 4 = 0
    UNION ALL SELECT conv_id, turn, position, 2, 'http://c.js', 0, 0 FROM tr WHERE turn % 4 = 0)
  SELECT conv_id, turn, position, frame_no, fr.url, fr.line, fr.col, source AS original_file, CASE WHEN source IS NOT NULL THEN orig_line END AS original_line,
    CASE WHEN fr.url NOT IN (SELECT url FROM sg) THEN 'NO_SOURCE_MAP' WHEN source IS NULL THEN 'PARSE_ERROR' ELSE 'OK' END AS status
  FROM fr ASOF LEFT JOIN sg ON fr.url = sg.url AND fr.line = sg.gen_line AND fr.col >= sg.gen_col""")
def d9(spark, sf):
    keys = ["conv_id", "turn"]
    frames = browser.exception_frames(browser.trace_exceptions(_events(spark, sf), keys), keys)
    segments = spark.sql(_SEGMENTS.format(s="string", l="{l}"), l=table(spark, sf, "lineitem"))
    out = browser.map_js_frames(frames, segments)
    return out.select("conv_id", "turn", F.col("position").cast("bigint").alias("position"), "frame_no", "url", "line", "col",
                      "original_file", "original_line", "status")


# All digits drawn are below 32, so each letter is a value of its own, and a segment has four of them; the last may have fewer.
@check("g7_decode_source_maps", """WITH t AS (SELECT url || '#' || page_id AS key, url, translate(regexp_replace(html, '[^A-Za-z0-9+/]', '', 'g'),
    'ghijklmnopqrstuvwxyz0123456789+/', 'ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEF') AS x FROM pages),
  s AS (SELECT key, url, i, list_transform(list_transform(string_split(substr(x, 4 * i + 1, 4), ''), lambda c: position(c IN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef') - 1),
    lambda v: CASE WHEN v % 2 = 1 THEN -(v // 2) ELSE v // 2 END) AS v FROM (SELECT *, unnest(range(0, (length(x) + 3) // 4)) AS i FROM t)),
  r AS (SELECT *, len(v) = 4 AS m, sum(v[1]) OVER w AS g, sum(v[2]) FILTER (WHERE len(v) = 4) OVER w AS sn, sum(v[3]) FILTER (WHERE len(v) = 4) OVER w AS ln,
    sum(v[4]) FILTER (WHERE len(v) = 4) OVER w AS cn FROM s WINDOW w AS (PARTITION BY key ORDER BY i))
  SELECT key AS url, 1::bigint AS gen_line, g::bigint AS gen_col, i::bigint AS segment_no, CASE WHEN m AND sn = 0 THEN url END AS source,
    CASE WHEN m THEN ln::bigint + 1 END AS orig_line, CASE WHEN m THEN cn::bigint END AS orig_col, NULL::varchar AS name FROM r""")
def g7(spark, sf):
    """Maps whose segments are drawn from the pages' own text."""
    letters = F.translate(F.regexp_replace("html", "[^A-Za-z0-9+/]", ""),
                          "ghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEF")
    mappings = F.regexp_replace(letters, "(.{4})(?=.)", "$1,")
    doc = F.to_json(F.struct(F.lit(3).alias("version"), F.array(F.col("url")).alias("sources"), F.array(F.lit("n")).alias("names"), mappings.alias("mappings")))
    maps = table(spark, sf, "pages").select(F.concat("url", F.lit("#"), F.col("page_id")).alias("url"), doc.alias("json"))
    return browser.decode_source_maps(maps).withColumn("segment_no", F.col("segment_no").cast("bigint"))
