"""Streaming forms, run over the events table until it is used up, against the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import check, table
from checks.lines import ENGINE_SQL, LEVEL_SQL, MASK_SQL, TYPE_SQL, UPPER_SQL, distinct_first
from checks.logview import LINES_SQL, YEAR, _render, event_lines
from checks.telemetry import CHANGES_SQL, EVENTS_SQL, REGRESSION_SQL, _EVENTS, _MON, changes, error_events
from checks.temporal import EV_SQL, INC_TYPE_SQL
from checks.text import KEY_SQL
from faultline import streaming
from faultline.functions.lines import upper_tokens, with_timestamp
from faultline.operators import telemetry
from faultline.session import ensure_checkpoint_dir
from faultline.streaming.regressions import regression_sink


def _folder(spark) -> str:
    """A new folder on the storage the cluster shares."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _lines(spark, sf):
    return spark.sql(_render("spark", "{events}"), events=_events(spark, sf).select("event_id", "ts", "user_id", "event_type"))


def _run(spark, df):
    """Write a stream to files until its source is used up, and read them back."""
    folder = _folder(spark)
    query = (df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


# Rows of a window or session are final once the watermark, ten minutes behind the newest row, passes its end.
def _final(newest: str, end: str) -> str:
    return f"{end} <= floor(({newest} - 600000000) / 1000) * 1000"


@check("l1_stream_enrich", f"""WITH {LINES_SQL}, {ENGINE_SQL} SELECT log_id, event_id, k, ts_us, {LEVEL_SQL} AS level, {MASK_SQL} AS masked, {TYPE_SQL} AS error_type FROM engine""")
def l1(spark, sf):
    out = _run(spark, streaming.enrich(_lines(spark, sf), year=YEAR))
    return out.select("log_id", "event_id", F.col("k").cast("bigint").alias("k"), F.unix_micros("ts").alias("ts_us"), "level", "masked", "error_type")


@check("l2_stream_spikes", f"""WITH {EVENTS_SQL}, dm AS (SELECT ts, user_id, d.* FROM er, LATERAL (VALUES ('app', app), ('layer', layer), ('chipset', chipset), ('error_category', error_category)) d(dimension, value)),
  mo AS (SELECT * FROM dm SEMI JOIN (VALUES {_MON}) m(dimension, value) USING (dimension, value)),
  wn AS (SELECT dimension, value, user_id, (epoch_us(ts) // 300000000 + 1 + i) * 300000000 AS e FROM mo, range(12) r(i)),
  ct AS (SELECT dimension, value, e, count(*) AS n, count(DISTINCT user_id) AS users FROM wn GROUP BY ALL), bl AS (SELECT dimension, value, count(*) / 720 AS b FROM mo GROUP BY ALL)
  SELECT dimension, value, e AS as_of_us, n AS current_rate, round(n / b, 6) AS spike_factor, users AS affected_users,
    CASE WHEN n / b >= 3 THEN 'high' ELSE 'medium' END AS priority FROM ct JOIN bl USING (dimension, value)
  WHERE n / b >= 2 AND {_final('(SELECT max(epoch_us(ts)) FROM er)', 'e')}""")
def l2(spark, sf):
    batch = telemetry.by_dimension(error_events(spark, sf)).groupBy("dimension", "value").agg((F.count("*") / 720).alias("baseline_rate"))
    events = spark.sql(_EVENTS.format(e="{e}"), e=_events(spark, sf))
    out = _run(spark, streaming.spikes(events, batch, min_users=0, min_errors=0))
    return out.select("dimension", "value", F.unix_micros("as_of").alias("as_of_us"), "current_rate", F.round("spike_factor", 6).alias("spike_factor"),
                      "affected_users", "priority")


@check("l3_stream_incidents", f"""WITH {LINES_SQL}, {ENGINE_SQL}, {EV_SQL}, {INC_TYPE_SQL} SELECT log_id, start_us, end_us, error_count,
  array_to_string(types, ',') AS unique_error_types FROM tinc WHERE {_final('(SELECT max(us) FROM ev)', 'end_us + 60000000')}""")
def l3(spark, sf):
    lines = with_timestamp(_lines(spark, sf), "engine", year=YEAR)
    out = _run(spark, streaming.incidents(lines))
    return out.select("log_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "error_count",
                      F.array_join("unique_error_types", ",").alias("unique_error_types"))


@check("l4_stream_anomalies", f"""WITH {LINES_SQL}, {ENGINE_SQL}, tk AS (SELECT log_id, ts_us // 60000000 AS b, unnest({distinct_first(UPPER_SQL, 3)}) AS token FROM engine WHERE ts_us IS NOT NULL),
  ct AS (SELECT log_id, token, b, count(*) AS n FROM tk GROUP BY ALL), bl AS (SELECT log_id, token, avg(n) AS base FROM ct GROUP BY ALL)
  SELECT log_id, token, b * 60000000 AS start_us, n AS count, round(n / base, 6) AS spike_factor FROM ct JOIN bl USING (log_id, token)
  WHERE n / base >= 1.5 AND {_final('(SELECT max(ts_us) FROM engine)', '(b + 1) * 60000000')}""")
def l4(spark, sf):
    batch = with_timestamp(event_lines(spark, sf), "engine", year=YEAR).where("ts IS NOT NULL")
    counts = batch.select("log_id", F.window("ts", "60 seconds").alias("w"), F.explode(upper_tokens("line")).alias("token"))
    counts = counts.groupBy("log_id", "token", "w").agg(F.count("*").alias("n"))
    baseline = counts.groupBy("log_id", "token").agg(F.avg("n").alias("baseline_avg"))
    lines = with_timestamp(_lines(spark, sf), "engine", year=YEAR)
    out = _run(spark, streaming.anomalies(lines, baseline, multiplier=1.5))
    return out.select("log_id", "token", F.unix_micros("window_start").alias("start_us"), "count", F.round("spike_factor", 6).alias("spike_factor"))


@check("l5_stream_novel_templates", f"WITH {LINES_SQL} SELECT DISTINCT log_id, {KEY_SQL} AS template FROM lines")
def l5(spark, sf):
    return _run(spark, streaming.novel_templates(_lines(spark, sf))).select("log_id", "template")


@check("l6_stream_regressions", f"""WITH {EVENTS_SQL}, {CHANGES_SQL}, now AS (SELECT max(ts) AS t FROM er), {REGRESSION_SQL}
  SELECT change_id, hours_after_merge, round(spike_factor, 6) AS spike_factor, affected_users FROM alerts
  WHERE merged_at + to_hours(hours_after_merge) <= (SELECT t FROM now)""")
def l6(spark, sf):
    folder = _folder(spark)
    sink = regression_sink(lambda: changes(spark, sf), f"{folder}/events", f"{folder}/alerts")
    events = spark.sql(_EVENTS.format(e="{e}"), e=_events(spark, sf))
    query = (events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/alerts")
    return out.select("change_id", F.col("hours_after_merge").cast("bigint").alias("hours_after_merge"),
                      F.round("spike_factor", 6).alias("spike_factor"), "affected_users")
