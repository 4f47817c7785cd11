"""Correlations, incidents, anomalies and cascades over rendered logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.lines import ENGINE_SQL, IDENT_SQL, MULTI_SQL, TYPE_SQL, UPPER_SQL, distinct_first, engine_lines, multi_lines, q
from checks.logview import LINES_SQL, event_lines
from faultline.operators import anomalies, cascades, correlate, incidents
from faultline.rules import patterns


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def corr_sql(per_line: int | None) -> str:
    return f"""tok AS (SELECT log_id, line_no, ts_us AS us, unnest({distinct_first(IDENT_SQL, per_line)}) AS token
  FROM multi WHERE ts_us IS NOT NULL),
pairs AS (SELECT x.log_id, x.token AS pattern_a, y.token AS pattern_b, count(*) AS n,
    sum(abs(x.us - y.us)) / count(*) / 1000000 AS mean
  FROM tok x JOIN tok y ON x.log_id = y.log_id AND x.token < y.token AND abs(x.us - y.us) <= 5000000 GROUP BY ALL),
corr AS (SELECT * FROM (SELECT log_id, pattern_a, pattern_b, n AS co_occurrence_count, mean AS avg_delta_seconds,
      least(1.0, n / 10 / (1 + mean)) AS score,
      row_number() OVER (PARTITION BY log_id ORDER BY round(least(1.0, n / 10 / (1 + mean)), 9) DESC,
                         pattern_a, pattern_b) AS rank FROM pairs) WHERE rank <= 200)"""


def token_correlations(spark, sf):
    return correlate.correlate_tokens(multi_lines(spark, sf))


@check("d2_correlate_tokens", f"""WITH {LINES_SQL}, {MULTI_SQL}, {corr_sql(None)}
  SELECT log_id, pattern_a, pattern_b, co_occurrence_count, round(avg_delta_seconds, 6) AS avg_delta_seconds,
    round(score, 6) AS score, rank FROM corr""")
def d2(spark, sf):
    out = token_correlations(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))
    return rounded(out, "avg_delta_seconds", "score")


TYPES_SQL = f"""cl AS (SELECT log_id, line_no, {TYPE_SQL} AS et FROM lines),
tpairs AS (SELECT x.log_id, x.et AS error1, y.et AS error2, count(*) AS count FROM cl x JOIN cl y
  ON x.log_id = y.log_id AND y.line_no BETWEEN x.line_no + 1 AND x.line_no + 10 AND x.et <> y.et
  GROUP BY ALL HAVING count(*) >= 2)"""


def type_correlations(spark, sf):
    return correlate.correlate_types(event_lines(spark, sf))


@check("d3_correlate_types", f"""WITH {LINES_SQL}, {TYPES_SQL} SELECT log_id, error1, error2, count,
  0.0::double AS avg_time_diff_seconds, round(least(count / 10, 1.0), 6) AS confidence FROM tpairs""")
def d3(spark, sf):
    return rounded(type_correlations(spark, sf), "confidence")


# Pairs only: triples are checked against brute force in the tests.
CASC_SQL = f"""up AS (SELECT log_id, ts_us AS us, unnest({distinct_first(UPPER_SQL, None)}) AS token
  FROM multi WHERE ts_us IS NOT NULL),
tot AS (SELECT log_id, count(*) AS total FROM up GROUP BY log_id HAVING count(*) >= 3),
fst AS (SELECT log_id, token, min(us) AS f FROM up GROUP BY ALL),
ord AS (SELECT c.log_id, pattern_a, pattern_b, count(*) AS n FROM corr c
  JOIN fst ON fst.log_id = c.log_id AND fst.token = pattern_a
  JOIN up ON up.log_id = c.log_id AND up.token = pattern_b AND up.us BETWEEN f AND f + 30000000 GROUP BY ALL)"""


# Chains go out from the pairs of the first five tokens of each line.
CHAIN_TOKENS = 5


@check("d4_cascades_tokens", f"""WITH {LINES_SQL}, {MULTI_SQL}, {corr_sql(CHAIN_TOKENS)}, {CASC_SQL},
  ev AS (SELECT DISTINCT log_id, line_no, ts_us AS us, unnest({distinct_first(UPPER_SQL, None)}) AS token
    FROM multi WHERE ts_us IS NOT NULL),
  ab AS (SELECT x.log_id, o.pattern_a AS a, o.pattern_b AS b, x.us AS a_us, x.line_no AS a_line, x.c,
      min({{'us': y.us, 'line': y.line_no}}) AS nxt
    FROM (SELECT log_id, token, us, min(line_no) AS line_no, count(*) AS c FROM ev GROUP BY ALL) x
    JOIN ord o ON o.log_id = x.log_id AND o.pattern_a = x.token
    JOIN ev y ON y.log_id = x.log_id AND y.token = o.pattern_b AND y.us BETWEEN x.us AND x.us + 30000000
      AND (y.us, y.line_no, y.token) > (x.us, x.line_no, x.token) GROUP BY ALL),
  abc AS (SELECT ab.log_id, ab.a, ab.b, o.pattern_b AS z, ab.a_us, ab.c
    FROM ab JOIN ord o ON o.log_id = ab.log_id AND o.pattern_a = ab.b AND o.pattern_b <> ab.a
    WHERE EXISTS (SELECT 1 FROM ev y WHERE y.log_id = ab.log_id AND y.token = o.pattern_b
      AND y.us <= ab.a_us + 30000000 AND (y.us, y.line_no, y.token) > (ab.nxt.us, ab.nxt.line, ab.b))),
  ch AS (SELECT log_id, [pattern_a, pattern_b] AS chain, n FROM ord
    UNION ALL SELECT log_id, [a, b, z], sum(c)::bigint FROM abc GROUP BY log_id, a, b, z),
  sc AS (SELECT log_id, chain, round(least(1.0, n / greatest(total / 10, 1.0)), 3) AS confidence, n
    FROM ch JOIN tot USING (log_id) WHERE n >= 2)
  SELECT log_id, array_to_string(chain, ' ') AS chain, confidence, n AS occurrence_count, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY confidence DESC, chain) AS rank FROM sc) WHERE rank <= 50""")
def d4(spark, sf):
    lines = multi_lines(spark, sf)
    out = cascades.cascades_tokens(lines, correlate.correlate_tokens(lines, per_line=CHAIN_TOKENS))
    return out.select("log_id", F.array_join("chain", " ").alias("chain"), "confidence", "occurrence_count",
                      F.col("rank").cast("bigint").alias("rank"))


def type_cascades(spark, sf):
    return cascades.cascades_types(type_correlations(spark, sf))


D5_SQL = """strong AS (SELECT log_id, error1, error2 FROM tpairs WHERE least(count / 10, 1.0) >= 0.5),
walk AS (
  SELECT DISTINCT log_id, [error1] AS chain, false AS done FROM strong
  UNION ALL
  SELECT w.log_id, list_append(w.chain, s.error2), list_contains(w.chain, s.error2) FROM walk w
  JOIN strong s ON s.log_id = w.log_id AND s.error1 = w.chain[-1] WHERE NOT w.done),
ends AS (SELECT log_id, chain FROM walk w WHERE len(chain) >= 2 AND (done OR NOT EXISTS (
  SELECT 1 FROM strong s WHERE s.log_id = w.log_id AND s.error1 = w.chain[-1]))),
tcasc AS (SELECT * FROM (SELECT log_id, chain, row_number() OVER (PARTITION BY log_id ORDER BY chain) AS position FROM ends)
  WHERE position <= 5)"""


@check("d5_cascades_types", f"""WITH RECURSIVE {LINES_SQL}, {TYPES_SQL}, {D5_SQL}
  SELECT log_id, position, array_to_string(chain, ' ') AS chain FROM tcasc""")
def d5(spark, sf):
    return type_cascades(spark, sf).select("log_id", F.col("position").cast("bigint").alias("position"),
                                           F.array_join("chain", " ").alias("chain"))


ANOM_SQL = f"""anc AS (SELECT log_id, arg_min(ts_us, line_no) AS anchor FROM multi WHERE ts_us IS NOT NULL GROUP BY log_id),
ct AS (SELECT log_id, anchor, cast(floor((coalesce(ts_us, anchor) - anchor) / 60000000) AS bigint) AS b, token, count(*) AS n
  FROM (SELECT m.log_id, ts_us, anchor, unnest({distinct_first(UPPER_SQL, 3)}) AS token FROM multi m JOIN anc USING (log_id))
  GROUP BY ALL),
tt AS (SELECT log_id, token, sum(n) AS total FROM ct GROUP BY ALL),
nb AS (SELECT log_id, count(DISTINCT b) AS buckets FROM ct GROUP BY ALL),
sp AS (SELECT *, n / (total / buckets) AS factor FROM ct JOIN tt USING (log_id, token) JOIN nb USING (log_id))"""


@check("e5_anomalies_tokens", f"""WITH {LINES_SQL}, {MULTI_SQL}, {ANOM_SQL}
  SELECT log_id, token, round(factor, 2) AS spike_factor, anchor + b * 60000000 AS start_us, n AS count,
    round(total / buckets, 2) AS baseline_avg,
    CASE WHEN factor >= 10 THEN 'critical' WHEN factor >= 5 THEN 'high' ELSE 'medium' END AS severity
  FROM sp WHERE factor >= 3""")
def e5(spark, sf):
    out = anomalies.anomalies_tokens(multi_lines(spark, sf))
    return out.select("log_id", "token", "spike_factor", F.unix_micros("window_start").alias("start_us"), "count",
                      "baseline_avg", "severity")


EV_SQL = f"ev AS (SELECT * FROM (SELECT log_id, ts_us AS us, {TYPE_SQL} AS et FROM engine WHERE ts_us IS NOT NULL) WHERE et IS NOT NULL)"

SPIKE_SQL = """lg AS (SELECT log_id, count(*) AS total, greatest(max(us) - min(us), 0) / 1000000 AS span FROM ev GROUP BY log_id),
bt AS (SELECT ev.log_id, et, count(*) / any_value(CASE WHEN span = 0 THEN 1.0 ELSE span END) AS base
  FROM ev JOIN lg USING (log_id) WHERE total >= 10 GROUP BY ALL),
ahead AS (SELECT x.log_id, x.et, x.us, count(*) AS n FROM (SELECT DISTINCT * FROM ev) x JOIN ev y
  ON x.log_id = y.log_id AND x.et = y.et AND y.us BETWEEN x.us AND x.us + 30000000 GROUP BY ALL),
spikes AS (SELECT log_id, et, min(us) AS us, arg_min(n, us) AS n, any_value(base) AS base FROM ahead JOIN bt USING (log_id, et)
  WHERE n >= 2 AND n / 30 > 3 * base GROUP BY ALL)"""


@check("e6_anomalies_types", f"""WITH {LINES_SQL}, {ENGINE_SQL}, {EV_SQL}, {SPIKE_SQL}
  SELECT log_id, et AS error_type, us AS start_us, us + 30000000 AS end_us, round(base, 9) AS baseline_rate_per_s,
    round(n / 30, 6) AS spike_rate_per_s, round(n / 30 / greatest(base, 1e-9), 3) AS spike_magnitude FROM spikes""")
def e6(spark, sf):
    out = anomalies.anomalies_types(engine_lines(spark, sf))
    return out.select("log_id", "error_type", F.unix_micros("window_start").alias("start_us"),
                      F.unix_micros("window_end").alias("end_us"),
                      F.round("baseline_rate_per_s", 9).alias("baseline_rate_per_s"),
                      F.round("spike_rate_per_s", 6).alias("spike_rate_per_s"),
                      F.round("spike_magnitude", 3).alias("spike_magnitude"))


INC_LINE_SQL = f"""er AS (SELECT *, lag(ts_us) OVER w AS p, row_number() OVER w AS rn FROM multi
    WHERE regexp_matches(line, {q('(?i)' + patterns.INCIDENT_REGEX)}) WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
gr AS (SELECT *, sum(CASE WHEN rn = 1 OR ts_us IS NULL OR p IS NULL OR ts_us - p > 60000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY log_id ORDER BY line_no)::bigint AS incident_id FROM er)"""


@check("e7_incidents_lines", f"""WITH {LINES_SQL}, {MULTI_SQL}, {INC_LINE_SQL},
  wd AS (SELECT log_id, incident_id, string_agg(DISTINCT upper(w), ',' ORDER BY upper(w)) AS pats FROM (
    SELECT log_id, incident_id, unnest(regexp_extract_all(line, {q('(?i)' + patterns.INCIDENT_REGEX)}, 1)) AS w FROM gr) GROUP BY ALL)
  SELECT log_id, incident_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS error_count,
    any_value(pats) AS unique_patterns, CASE WHEN regexp_matches(any_value(pats), 'SIGSEGV|SIGABRT|PANIC') THEN 'critical'
      WHEN regexp_matches(any_value(pats), 'FATAL|CRASH|OOPS') THEN 'high' ELSE 'medium' END AS severity
  FROM gr JOIN wd USING (log_id, incident_id) GROUP BY log_id, incident_id""")
def e7(spark, sf):
    out = incidents.incidents_lines(multi_lines(spark, sf))
    return out.select("log_id", "incident_id", F.unix_micros("start_time").alias("start_us"),
                      F.unix_micros("end_time").alias("end_us"), "error_count",
                      F.array_join("unique_patterns", ",").alias("unique_patterns"), "severity")


@check("e7_incident_line_tags", f"""WITH {LINES_SQL}, {MULTI_SQL}, {INC_LINE_SQL}
  SELECT log_id, line_no, incident_id FROM gr""")
def e7_tags(spark, sf):
    return incidents.tag_incidents(multi_lines(spark, sf)).select("log_id", "line_no", "incident_id")


INC_TYPE_SQL = """ig AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 60000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY log_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(us) OVER (PARTITION BY log_id ORDER BY us) AS p FROM ev)),
tinc AS (SELECT log_id, g::bigint AS incident_no, min(us) AS start_us, max(us) AS end_us, count(*) AS error_count,
    (max(us) - min(us)) / 1000000 AS duration_seconds, list_sort(list_distinct(list(et))) AS types
  FROM ig GROUP BY log_id, g)"""



def secs(col: str) -> str:
    whole = f"cast({col} // 1000000 AS varchar)"
    frac = f"regexp_replace(lpad(cast({col} % 1000000 AS varchar), 6, '0'), '0+$', '')"
    return f"{whole} || '.' || coalesce(nullif({frac}, ''), '0')"


@check("e8_incidents_types", f"""WITH {LINES_SQL}, {ENGINE_SQL}, {EV_SQL}, {INC_TYPE_SQL}
  SELECT log_id, incident_no, substr(md5({secs('start_us')} || {secs('end_us')}), 1, 12) AS incident_id, start_us, end_us,
    round(duration_seconds, 6) AS duration_seconds, error_count, array_to_string(types, ',') AS unique_error_types,
    CASE WHEN error_count > 10 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM tinc""")
def e8(spark, sf):
    out = incidents.incidents_types(engine_lines(spark, sf))
    return out.select("log_id", "incident_no", "incident_id", F.unix_micros("start_time").alias("start_us"),
                      F.unix_micros("end_time").alias("end_us"),
                      F.round("duration_seconds", 6).alias("duration_seconds"), "error_count",
                      F.array_join("unique_error_types", ",").alias("unique_error_types"), "severity")


CAUSES_SQL = """c3 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY count DESC, error1, error2) AS r FROM tpairs),
  al AS (SELECT log_id, 1 AS s, r AS place, 'Primary error: ' || error1 || ' causes ' || error2 AS text FROM c3
      WHERE r <= 3 AND least(count / 10, 1.0) >= 0.7
    UNION ALL SELECT log_id, 2, incident_no, 'Sustained incident (' || cast(round(duration_seconds, 0) AS bigint) || 's): ' || types[1]
      FROM tinc WHERE duration_seconds > 30
    UNION ALL SELECT log_id, 3, position, 'Cascading failure: ' || array_to_string(chain, ' → ') FROM tcasc),
  causes AS (SELECT log_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY s, place) AS pos FROM al) WHERE pos <= 5)"""


@check("e20_root_cause_candidates", f"""WITH RECURSIVE {LINES_SQL}, {ENGINE_SQL}, {EV_SQL}, {INC_TYPE_SQL}, {TYPES_SQL}, {D5_SQL}, {CAUSES_SQL}
  SELECT * FROM causes""")
def e20(spark, sf):
    correlations = type_correlations(spark, sf)
    found = incidents.incidents_types(engine_lines(spark, sf))
    out = incidents.root_cause_candidates(correlations, found, cascades.cascades_types(correlations))
    return out.withColumn("pos", F.col("pos").cast("bigint"))
