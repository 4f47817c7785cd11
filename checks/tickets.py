"""Ticket text, names, steps and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, table
from checks.lines import q
from checks.logview import LINES_SQL, event_lines
from faultline.functions import lines as L
from faultline.functions import tickets as T
from faultline.rules import formats, vocab
from faultline.sources import tickets as source

# Conversation turns with the wording of device tickets in front, the same text in both engines.
_TICKETS = """SELECT concat('T-', cast(conv_id AS {str}), '-', cast(turn AS {str})) AS ticket_id, conv_id, turn,
  CASE (conv_id * 5 + turn) % 8
    WHEN 0 THEN 'Netflix freeze, no sound after reboot P0'
    WHEN 1 THEN 'Black screen and OOM in `Video.Decoder` with SIGSEGV'
    WHEN 2 THEN 'Hulu buffering, remote not working (DRM license)'
    WHEN 3 THEN 'watch free max hang: mali hdcp widevine "open_file.cpp"'
    WHEN 4 THEN 'slow timeout, memory leak on mt5670 P1'
    WHEN 5 THEN 'Amazon prime video crash, black frozen I/O error'
    WHEN 6 THEN 'Pluto TV audio mute; heap_oom race_condition'
    ELSE 'Nothing special' END AS summary,
  text AS description,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'Blocker' WHEN 1 THEN 'critical' WHEN 2 THEN 'High' WHEN 3 THEN 'P3'
    WHEN 4 THEN 'lowest' WHEN 5 THEN 'odd' END AS priority
  FROM {src}"""
TICKETS_SQL = "tickets AS (" + _TICKETS.format(str="varchar", src="conversations") + \
    "), tx AS (SELECT *, summary || ' ' || description AS t FROM tickets)"


def tickets(spark, sf):
    return spark.sql(_TICKETS.format(str="string", src="{c}"), c=table(spark, sf, "conversations"))


def _texts(spark, sf):
    return tickets(spark, sf).withColumn("t", T.ticket_text("summary", "description"))


def arr(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "[]::varchar[]"


def cases(pairs) -> str:
    """Concatenate the terms of all true conditions."""
    parts = [f"CASE WHEN {cond} THEN {arr(terms)} ELSE []::varchar[] END" for cond, terms in pairs]
    return "flatten([" + ", ".join(parts) + "])"


W = f"regexp_extract_all(lower(t), {q(formats.WORD)})"
INTAKE_SQL = f"""list_sort(list_distinct(flatten([
  {cases([(f"contains(lower(t), {q(p)})", terms) for p, terms in vocab.INTAKE_PHRASES.items()])},
  list_filter({W}, lambda w: list_contains({arr(vocab.INTAKE_COMPONENTS)}, w)),
  {cases([(f"regexp_matches(t, {q(p)})", terms) for p, terms in vocab.INTAKE_CODES])},
  list_transform(list_filter(regexp_extract_all(t, {q('["`]([^"`]{3,50})["`]')}, 1),
    lambda x: regexp_full_match(x, {q('[\\p{L}\\p{N}_:/.-]+')})), lambda x: lower(x)),
  CASE WHEN regexp_matches(t, '\\bP0\\b|\\bP1\\b') THEN ['critical'] ELSE []::varchar[] END])))"""


@check("b9a_intake_keywords", f"WITH {TICKETS_SQL} SELECT ticket_id, array_to_string({INTAKE_SQL}, ' ') AS keywords FROM tx")
def b9a(spark, sf):
    return _texts(spark, sf).select("ticket_id", F.array_join(T.intake_keywords("t"), " ").alias("keywords"))


_weights = ", ".join(f"({q(k)}, {w})" for k, w in vocab.KEYWORD_WEIGHTS.items())
CONTEXT_SQL = f"""list_distinct(flatten([{cases([(f"list_contains({W}, {q(t)})", k) for t, k in vocab.CONTEXT_TERMS.items()])},
  list_filter({W}, lambda w: list_contains({arr(vocab.KEYWORD_WEIGHTS)}, w))]))"""


@check("b9b_context_keywords", f"""WITH {TICKETS_SQL}, wt AS (SELECT * FROM (VALUES {_weights}) v(k, w)),
  u AS (SELECT ticket_id, unnest({CONTEXT_SQL}) AS k FROM tx),
  r AS (SELECT ticket_id, k, row_number() OVER (PARTITION BY ticket_id ORDER BY coalesce(w, 0.5) DESC, k) AS n FROM u LEFT JOIN wt USING (k))
  SELECT ticket_id, coalesce(string_agg(k, ' ' ORDER BY n) FILTER (WHERE n <= 10), '') AS keywords
  FROM tx LEFT JOIN r USING (ticket_id) GROUP BY ticket_id""")
def b9b(spark, sf):
    return _texts(spark, sf).select("ticket_id", F.array_join(T.context_keywords("t"), " ").alias("keywords"))


ENGINE_KW_SQL = "list_sort(list_distinct(" + cases(
    [(f"contains(lower(t), {q(p)})", terms) for p, terms in vocab.ENGINE_PHRASES.items()]) + "))"
SEED_SQL = f"""list_transform((list_filter(regexp_split_to_array(t, {q(formats.WHITESPACE + '+')}),
  lambda w: regexp_full_match(w, '\\p{{L}}{{4,}}')))[1:20], lambda w: lower(w))"""
APP_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), {q(p)}) THEN {q(n)}" for n, p in vocab.APP_PATTERNS) + " END"


@check("b9c_b9d_b10_engine_seed_and_app", f"""WITH {TICKETS_SQL} SELECT ticket_id, array_to_string({ENGINE_KW_SQL}, ' ') AS engine_keywords,
  array_to_string({SEED_SQL}, ' ') AS seed_keywords, {APP_SQL} AS app FROM tx""")
def b9c(spark, sf):
    return _texts(spark, sf).select(
        "ticket_id", F.array_join(T.engine_keywords("t"), " ").alias("engine_keywords"),
        F.array_join(T.seed_keywords("t"), " ").alias("seed_keywords"), T.detect_app("t").alias("app"))


@check("b11_ticket_priority", f"""WITH {TICKETS_SQL} SELECT ticket_id, CASE upper(priority) WHEN 'P3' THEN 'P3'
  WHEN 'BLOCKER' THEN 'P0' WHEN 'CRITICAL' THEN 'P0' WHEN 'HIGH' THEN 'P1' WHEN 'LOWEST' THEN 'P3' ELSE 'P2' END AS priority,
  CASE priority WHEN 'Blocker' THEN 'P0' WHEN 'High' THEN 'P1' ELSE 'P2' END AS issue_priority FROM tickets""")
def b11(spark, sf):
    return tickets(spark, sf).select("ticket_id", T.ticket_priority("priority").alias("priority"),
                                     T.issue_priority("priority").alias("issue_priority"))


_STEP = ("concat(CASE {i} % 5 WHEN 0 THEN '  Launch Netflix' WHEN 1 THEN 'Press down key' WHEN 2 THEN 'wait for 12 seconds' "
         "WHEN 3 THEN 'wait a bit' ELSE 'look at screen' END, ' ', cast({i} AS {str}), ' ')")


@check("b12_repro_steps", f"""WITH s AS (SELECT conv_id, turn, conv_id + turn AS i FROM conversations),
  d AS (SELECT conv_id, turn AS step, trim({_STEP.format(i='i', str='varchar')}) AS txt FROM s WHERE conv_id % 3 > 0),
  e AS (SELECT DISTINCT conv_id FROM s WHERE conv_id % 3 = 0)
  SELECT conv_id, 'DETERMINISTIC' AS strategy, row_number() OVER (PARTITION BY conv_id ORDER BY step) - 1 AS step_no,
    CASE WHEN contains(lower(txt), 'launch') THEN 'launch_app' WHEN contains(lower(txt), 'press') THEN 'send_key' ELSE 'wait' END AS action,
    CASE WHEN contains(lower(txt), 'launch') THEN 'Netflix' WHEN contains(lower(txt), 'press') THEN 'Down' END AS argument,
    CASE WHEN contains(lower(txt), '12 sec') THEN 12 WHEN contains(lower(txt), 'wait') THEN 5 WHEN contains(lower(txt), 'look') THEN 2 END::bigint AS seconds,
    txt AS description FROM d
  UNION ALL SELECT conv_id, 'EXPLORATORY', 0, 'launch_app', 'Hulu', NULL, 'Launch Hulu' FROM e WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, 'EXPLORATORY', 1, 'wait', NULL, 10, 'Wait for app to load and error to manifest' FROM e WHERE conv_id % 2 = 0
  UNION ALL SELECT conv_id, 'EXPLORATORY', 0, 'wait', NULL, 5, 'Wait for error to manifest' FROM e WHERE conv_id % 2 = 1""")
def b12(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("i", F.col("conv_id") + F.col("turn"))
    step = F.expr(_STEP.format(i="i", str="string"))
    per = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", step.alias("s")))).alias("l"))
    per = per.select(
        "conv_id", F.when(F.col("conv_id") % 2 == 0, "Hulu").alias("streaming_app"),
        F.when(F.col("conv_id") % 3 > 0, F.transform("l", lambda s: s["s"])).alias("repro_steps"))
    out = T.parse_repro_steps(per, "conv_id")
    return out.withColumn("step_no", F.col("step_no").cast("bigint"))


_VER = "concat(cast({a} % 4 AS {s}), '.', cast({b} % 10 AS {s}), '.', cast({c} % 3 AS {s}))"


@check("b13_firmware_and_api_version", f"""WITH v AS (SELECT p_partkey, {_VER.format(a='p_partkey', b='p_size', c='p_size', s='varchar')} AS tv,
    CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'beta' ELSE
    {_VER.format(a='p_partkey', b='p_partkey', c='p_partkey', s='varchar')} END AS need FROM part)
  SELECT p_partkey, need IS NULL OR tv = need OR (need <> 'beta' AND split_part(tv, '.', 1) = split_part(need, '.', 1)
    AND split_part(tv, '.', 2) = split_part(need, '.', 2)) AS compatible,
    CASE WHEN need IS NULL OR need = 'beta' THEN 'v3.0' ELSE 'v' || split_part(need, '.', 1) || '.' || split_part(need, '.', 2) END AS api FROM v""")
def b13(spark, sf):
    v = table(spark, sf, "part").select(
        "p_partkey", F.expr(_VER.format(a="p_partkey", b="p_size", c="p_size", s="string")).alias("tv"),
        F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'beta' ELSE "
               + _VER.format(a="p_partkey", b="p_partkey", c="p_partkey", s="string") + " END").alias("need"))
    return v.select("p_partkey", T.firmware_compatible("tv", "need").alias("compatible"), T.api_version("need").alias("api"))


# A word ends where no letter, digit or underscore of any script follows.  The SQL engine's own word boundary knows ASCII only, so every other
# character is doubled first, and each match takes one on either side.
_EDGE = r"[^\p{L}\p{Nd}_]"
_FILES = formats.SYMBOL_FILE.split("(?:")[1].split(")")[0]
_SYMBOLS = [rf"(?:^|{_EDGE})([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", rf"(?:^|{_EDGE})([A-Z][a-zA-Z0-9]+)(?:$|{_EDGE})", rf"(?:^|{_EDGE})([a-zA-Z_][a-zA-Z0-9_]*\.\.(?i:{_FILES}))(?:$|{_EDGE})"]
SYM_SQL = "list_sort(list_distinct(list_transform(flatten([" + ", ".join(f"regexp_extract_all(twice, {q(p)}, 1)" for p in _SYMBOLS) + "]), lambda x: replace(x, '..', '.')) || [url]))"


@check("b14_code_symbols", f"""WITH p AS (SELECT page_id, url, regexp_replace(html, {q('(' + _EDGE + ')')}, '\\1\\1', 'g') AS twice FROM pages)
  SELECT page_id, md5(array_to_string({SYM_SQL}, ' ')) AS symbols, len({SYM_SQL}) AS n FROM p""")
def b14(spark, sf):
    out = table(spark, sf, "pages").select("page_id", T.code_symbols("html", F.array("url")).alias("s"))
    return out.select("page_id", F.md5(F.array_join("s", " ")).alias("symbols"), F.size("s").cast("bigint").alias("n"))


_OUT = """concat('run ', cast(o_orderkey AS {s}), CASE WHEN o_orderstatus = 'F' THEN ' PASS FAIL PASS' ELSE '' END,
  CASE WHEN o_custkey % 3 = 0 THEN concat(' [  PASSED  ] ', cast(o_custkey % 40 AS {s}), ' tests') ELSE ' ERROR: AddressSanitizer: x' END,
  CASE WHEN o_custkey % 4 = 0 THEN ' [  FAILED  ] 2 WARNING: ThreadSanitizer: data race' ELSE ' ERROR: LeakSanitizer' END)"""


@check("b15_sanitizer_and_test_counts", f"""WITH o AS (SELECT o_orderkey, {_OUT.format(s='varchar')} AS t FROM orders),
  n AS (SELECT *, regexp_extract_all(t, {q(formats.TEST_PASS)}, 1) AS p, regexp_extract_all(t, {q(formats.TEST_FAIL)}, 1) AS f FROM o)
  SELECT o_orderkey, regexp_matches(t, {q(formats.SANITIZER_LINE)}) AS finding,
    concat_ws(', ', {', '.join(f"CASE WHEN contains(t, {q(a)}) THEN {q(b)} END" for a, b in formats.SANITIZER_LABELS)}) AS labels,
    coalesce(list_sum(list_transform(p, lambda x: CASE WHEN coalesce(x, '') = '' THEN 1 ELSE x::bigint END)), 0)::bigint AS passes,
    coalesce(list_sum(list_transform(f, lambda x: CASE WHEN coalesce(x, '') = '' THEN 1 ELSE x::bigint END)), 0)::bigint AS fails FROM n""")
def b15(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_OUT.format(s="string")).alias("t"))
    return o.select("o_orderkey", L.sanitizer_line("t").alias("finding"),
                    F.array_join(L.sanitizer_labels("t"), ", ").alias("labels"),
                    L.test_count("t", "pass").alias("passes"), L.test_count("t", "fail").alias("fails"))


_CATS = ["LOKI_SEGFAULT_NULL_DEREF", "COMPANION_LIB_TIMING", "SHAKA_ERROR_3016", "KEYDOWN_NOT_FIRED"]
_CAT_SQL = "CASE line_no % 4 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATS)) + " END"
_TARGET_SQL = " OR ".join(
    f"({_CAT_SQL} = {q(c)} AND ({' OR '.join(f'contains(lower(line), {q(n.lower())})' for n in ns)}))"
    for c, ns in vocab.TARGET_ERRORS_DEVICE.items())


def _occ(needle: str) -> str:
    return f"(length(lower(line)) - length(replace(lower(line), {q(needle)}, ''))) // {len(needle)}"


@check("b16_target_errors", f"""WITH {LINES_SQL} SELECT log_id, line_no, {_TARGET_SQL} AS target,
  contains(lower(line), 'focus lost') OR {' OR '.join(f"contains(lower(line), {q(w)})" for w in vocab.GENERIC_ERROR_WORDS)} AS present,
  ({_occ('focus')} + {_occ('error')} + {_occ('exception')} + {_occ('fatal')})::bigint AS n FROM lines""")
def b16(spark, sf):
    lines = event_lines(spark, sf)
    return lines.select(
        "log_id", "line_no", T.target_error_present("line", F.expr(_CAT_SQL)).alias("target"),
        T.error_present("line", F.array(F.lit("Focus Lost"))).alias("present"),
        T.count_errors("line", F.array(F.lit("Focus"))).alias("n"))


@check("b19_record_texts", """SELECT doc_id, concat('Bug: ', source, ' Layer: ', lang, ' Category: ', 'C', ' Strategy: ', 'S',
    ' Files: ', array_to_string((string_split(source, '.'))[1:5], ' '), ' Root cause: ', substr(text, 1, 200)) AS fix_text,
  concat('CORRECTION: ', source, chr(10), 'MISTAKE: ', lang, chr(10), 'CORRECT APPROACH: ', text, chr(10), 'LESSON: ', lang) AS correction_text
  FROM documents""")
def b19(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.fix_description("source", "lang", F.lit("C"), F.lit("S"), F.split("source", r"\."), "text").alias("fix_text"),
        T.correction_text("source", "lang", "text", "lang").alias("correction_text"))


_NAME = """concat(CASE p_partkey % 6 WHEN 0 THEN 'logs/' WHEN 1 THEN 'tombstone_' ELSE '' END, replace(p_name, ' ', '_'),
  CASE p_size % 5 WHEN 0 THEN '.LOG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.tar.dmesg' END)"""


@check("a3_is_log_file", f"""WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part)
  SELECT p_partkey, name, regexp_matches(lower(name), '[^./](\\.log|\\.txt|\\.dmesg|\\.crash|\\.tombstone|\\.logcat)$')
    OR regexp_matches(regexp_extract(name, '[^/]*$'), {q(formats.LOG_NAME)}) AS is_log FROM n""")
def a3(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.expr(_NAME).alias("name"))
    return names.withColumn("is_log", T.is_log_file("name"))


@check("a4_is_binary", """WITH b AS (SELECT page_id, encode(html) AS c FROM pages),
  n AS (SELECT page_id, octet_length(c) AS n, length(regexp_replace(html, '[^\\x09\\x0a\\x0d\\x20-\\x7e]', '', 'g')) AS p FROM b JOIN pages USING (page_id))
  SELECT page_id, n > 0 AND p / n < 0.70 AS is_binary, n::bigint AS size FROM n""")
def a4(spark, sf):
    content = F.encode("html", "UTF-8")
    return table(spark, sf, "pages").select("page_id", T.is_binary(content).alias("is_binary"),
                                            F.octet_length(content).cast("bigint").alias("size"))


_PAYLOAD = """concat('{"webhookEvent":"', CASE conv_id % 4 WHEN 0 THEN 'jira:issue_created' WHEN 1 THEN 'issue_updated'
  WHEN 2 THEN 'comment_created' ELSE 'jira:issue_updated' END, '","issue":{"key":"', CASE WHEN conv_id % 5 = 0 THEN ''
  ELSE concat('SMART-', cast(conv_id AS STR)) END, '","fields":{"turn":', cast(turn AS STR), '}}}')"""


@check("a7_ticket_events", f"""WITH p AS (SELECT conv_id, turn, {_PAYLOAD.replace('STR', 'varchar')} AS payload FROM conversations)
  SELECT json_extract_string(payload, '$.webhookEvent') AS event_type, json_extract_string(payload, '$.issue.key') AS ticket_key,
    json_extract_string(payload, '$.issue') AS issue FROM p WHERE conv_id % 4 <> 2 AND conv_id % 5 <> 0""")
def a7(spark, sf):
    payloads = table(spark, sf, "conversations").select(F.expr(_PAYLOAD.replace("STR", "string")).alias("payload"))
    return source.ticket_events(payloads)
