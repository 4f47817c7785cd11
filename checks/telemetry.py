"""Error rates, spikes, regressions over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, table
from checks.temporal import rounded
from faultline.operators import telemetry
from faultline.rules import vocab

AS_OF = "2024-01-20 00:00:00"


def _pick(dim: str, expr: str) -> str:
    values = vocab.MONITORED[dim]
    return f"CASE {expr} % {len(values) + 1} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " ELSE 'other' END"


_EVENTS = f"""SELECT ts, user_id, {_pick('app', 'user_id')} AS app, {_pick('layer', 'event_id')} AS layer, {_pick('chipset', 'user_id')} AS chipset,
  CASE event_type WHEN 'error' THEN 'EME_DRM_FAILURE' WHEN 'click' THEN 'COMPANION_LIB_TIMING' WHEN 'view' THEN 'KEYDOWN_NOT_FIRED'
    WHEN 'signup' THEN 'JS_HEAP_OOM' ELSE 'LOKI_SEGFAULT_NULL_DEREF' END AS error_category FROM {{e}}"""
EVENTS_SQL = "er AS (" + _EVENTS.format(e="events") + ")"


def error_events(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(_EVENTS.format(e="{e}"), e=events)


def as_of():
    return F.lit(AS_OF + " UTC").cast("timestamp")


_MON = ", ".join(f"('{d}', '{v}')" for d, vs in vocab.MONITORED.items() for v in vs)
RATE_SQL = f"""dm AS (SELECT ts, user_id, d.* FROM er, LATERAL (VALUES ('app', app), ('layer', layer), ('chipset', chipset), ('error_category', error_category)) d(dimension, value)),
mo AS (SELECT * FROM dm SEMI JOIN (VALUES {_MON}) m(dimension, value) USING (dimension, value)),
rt AS (SELECT dimension, value, count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS current_rate, count(*) / 168 AS baseline_rate,
  count(DISTINCT user_id) AS affected_users FROM mo WHERE ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR GROUP BY ALL)"""


@check("e19_error_rates", f"""WITH {EVENTS_SQL}, {RATE_SQL} SELECT dimension, value, current_rate::double AS current_rate,
  round(baseline_rate, 6) AS baseline_rate, affected_users FROM rt""")
def e19(spark, sf):
    out = telemetry.error_rates(telemetry.by_dimension(error_events(spark, sf)), as_of())
    return rounded(out.withColumn("current_rate", F.col("current_rate").cast("double")), "baseline_rate")


@check("k4_proactive_spikes", f"""WITH {EVENTS_SQL}, {RATE_SQL} SELECT dimension, value, round(current_rate / baseline_rate, 6) AS spike_factor,
  affected_users, (current_rate * 24)::bigint AS error_count, CASE WHEN current_rate / baseline_rate >= 3 THEN 'high' ELSE 'medium' END AS priority,
  'Proactive Detection: ' || upper(dimension) || '=' || value || ' error rate spike (' || cast(round(current_rate / baseline_rate, 1) AS decimal(20,1)) || 'x)' AS title
  FROM rt WHERE current_rate / baseline_rate >= 1 AND affected_users >= 5 AND current_rate * 24 >= 24""")
def k4(spark, sf):
    out = telemetry.proactive_spikes(error_events(spark, sf), as_of(), spike_threshold=1.0, min_users=5, min_errors=24)
    return rounded(out, "spike_factor").select("dimension", "value", "spike_factor", "affected_users", "error_count", "priority", "title")


# A change per order of the first customers' keys, spread over the month of the events.
_CHANGES = f"""SELECT o_orderkey AS change_id, concat('SMART-', cast(o_custkey AS {{s}})) AS ticket_id, {{at}} AS merged_at,
  {_pick('error_category', 'o_orderkey')} AS error_category, CASE WHEN o_custkey % 3 = 0 THEN {_pick('app', 'o_custkey')} END AS app,
  CASE WHEN o_custkey % 4 = 0 THEN {_pick('chipset', 'o_custkey')} END AS chipset FROM {{o}}"""
CHANGES_SQL = "cg AS (" + _CHANGES.format(s="varchar", o="orders", at="make_timestamp(epoch_us(TIMESTAMP '2024-01-08') + (o_orderkey * 977 % 1900000) * 1000003)") + ")"


def changes(spark, sf):
    return spark.sql(_CHANGES.format(s="string", o="{o}", at="timestamp_micros(unix_micros(timestamp '2024-01-08 00:00:00 UTC') + (o_orderkey * 977 % 1900000) * 1000003)"),
                     o=table(spark, sf, "orders"))


REGRESSION_SQL = """hits AS (SELECT change_id, merged_at, e.ts, cast(floor((epoch_us(e.ts) - epoch_us(merged_at)) / 3600000000) AS bigint) + 1 AS h
  FROM cg c JOIN er e ON e.error_category = c.error_category AND (c.app IS NULL OR c.app = e.app) AND (c.chipset IS NULL OR c.chipset = e.chipset)
    AND e.ts >= merged_at - INTERVAL 168 HOUR AND e.ts < merged_at + INTERVAL 72 HOUR),
base AS (SELECT change_id, count(*) / 168 AS baseline FROM hits WHERE ts < merged_at GROUP BY change_id),
hourly AS (SELECT change_id, h, count(*) AS n FROM hits WHERE ts >= merged_at GROUP BY ALL),
fst AS (SELECT change_id, min(h) AS h, arg_min(n, h) AS n, any_value(baseline) AS baseline FROM hourly JOIN base USING (change_id) WHERE n / baseline >= 1.5 GROUP BY change_id),
al AS (SELECT c.*, h AS hours_after_merge, n AS current_rate, baseline AS baseline_rate, n / baseline AS spike_factor,
    CASE WHEN app IS NOT NULL THEN 'app' ELSE 'error_category' END AS dimension, coalesce(app, error_category) AS value FROM fst JOIN cg c USING (change_id)),
us AS (SELECT change_id, count(DISTINCT user_id) AS affected_users FROM al JOIN er e ON CASE WHEN al.dimension = 'app' THEN e.app ELSE e.error_category END = al.value
  AND e.ts >= merged_at + to_hours(hours_after_merge - 1) AND e.ts < merged_at + to_hours(hours_after_merge) GROUP BY change_id),
alerts AS (SELECT al.*, coalesce(affected_users, 0) AS affected_users FROM al LEFT JOIN us USING (change_id))"""


@check("k5_regressions", f"""WITH {EVENTS_SQL}, {CHANGES_SQL}, {REGRESSION_SQL} SELECT change_id, ticket_id, hours_after_merge, current_rate::double AS current_rate,
  round(baseline_rate, 6) AS baseline_rate, round(spike_factor, 6) AS spike_factor, dimension, value, affected_users, spike_factor >= 2.0 AS revert_recommended FROM alerts""")
def k5(spark, sf):
    out = telemetry.regressions(changes(spark, sf), error_events(spark, sf))
    out = out.withColumn("hours_after_merge", F.col("hours_after_merge").cast("bigint"))
    return rounded(out, "baseline_rate", "spike_factor").select(
        "change_id", "ticket_id", "hours_after_merge", "current_rate", "baseline_rate", "spike_factor", "dimension", "value",
        "affected_users", "revert_recommended")


@check("k6_regression_corrections", f"""WITH {EVENTS_SQL}, {CHANGES_SQL}, {REGRESSION_SQL} SELECT change_id::varchar AS correction_id, ticket_id AS jira_ticket,
  error_category, 'REGRESSION' AS mistake_type, 'PRODUCTION_REGRESSION' AS severity, 'TELEMETRY' AS detected_by, hours_after_merge::double AS time_to_detect_hours,
  epoch_us(merged_at) + hours_after_merge * 3600000000 AS created_us, 'Affected ' || affected_users || ' users.' AS ending FROM alerts""")
def k6(spark, sf):
    out = telemetry.regression_corrections(telemetry.regressions(changes(spark, sf), error_events(spark, sf)))
    return out.select("correction_id", "jira_ticket", "error_category", "mistake_type", "severity", "detected_by", "time_to_detect_hours",
                      F.unix_micros("created_at").alias("created_us"), F.regexp_extract("description", r"(Affected \d+ users\.)$", 1).alias("ending"))


@check("m4_monitor", f"""WITH {EVENTS_SQL}, {CHANGES_SQL}, {RATE_SQL}, {REGRESSION_SQL}
  SELECT 'spike' AS kind, dimension, value, NULL::bigint AS change_id, round(current_rate / baseline_rate, 6) AS spike_factor, affected_users FROM rt
    WHERE current_rate / baseline_rate >= 1 AND affected_users >= 5 AND current_rate * 24 >= 24
  UNION ALL SELECT 'regression', dimension, value, change_id, round(spike_factor, 6), affected_users FROM alerts
  UNION ALL SELECT 'correction', 'TELEMETRY', 'T-' || 0, change_id, NULL, NULL FROM cg WHERE change_id % 3 = 0 AND change_id NOT IN (SELECT change_id FROM alerts)
  UNION ALL SELECT 'correction', 'TELEMETRY', ticket_id, change_id, NULL, NULL FROM alerts""")
def m4(spark, sf):
    from faultline.plans.monitor import monitor

    # Every third change has a record from before; those of regressions are replaced, the others stay.
    old = {"jira_ticket": "T-0", "error_category": "X", "mistake_type": "OLD", "description": "", "what_went_wrong": "", "severity": "LOW", "detected_by": "TELEMETRY"}
    stored = changes(spark, sf).where("change_id % 3 = 0").select(
        F.col("change_id").cast("string").alias("correction_id"), *[F.lit(v).alias(k) for k, v in old.items()], F.lit(0.0).alias("time_to_detect_hours"),
        F.lit("2020-01-01").cast("timestamp").alias("created_at"))
    alerts, corrections = monitor(error_events(spark, sf), changes(spark, sf), as_of(), stored, spike_threshold=1.0, min_users=5, min_errors=24)
    alerts = rounded(alerts.select("kind", "dimension", "value", "change_id", "spike_factor", "affected_users"), "spike_factor")
    return alerts.unionByName(corrections.select(
        F.lit("correction").alias("kind"), F.col("detected_by").alias("dimension"), F.col("jira_ticket").alias("value"),
        F.col("correction_id").cast("bigint").alias("change_id"), F.lit(None).cast("double").alias("spike_factor"), F.lit(None).cast("bigint").alias("affected_users")))


