"""Structured Streaming forms of the line, incident, anomaly and telemetry operators.

Every function takes and returns a streaming DataFrame; callers choose sink, trigger and
checkpoint location.  Late rows are dropped by the watermark and counted by Spark as
``numRowsDroppedByWatermark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.lines import error_type, log_level, mask_line, upper_tokens, with_timestamp
from faultline.functions.text import compute_once
from faultline.operators.anomalies import severity_of
from faultline.operators.filters import level_filter
from faultline.operators.incidents import type_mask, types_of
from faultline.operators.matching import match_patterns
from faultline.operators.telemetry import by_dimension
from faultline.operators.templates import template_key
from faultline.rules.patterns import ROUTER_PATTERNS
from faultline.session import materialized

WATERMARK = "10 minutes"
#: Parts of the users of a slice, so that no row holds all of them.
USER_PARTS = 8


def enrich(lines: DataFrame, profile: str = "engine", line: str = "line", min_level: str | None = None, **options) -> DataFrame:
    """Timestamp, level, masked text, tokens and error class per line; no state."""
    out = with_timestamp(lines, profile, line, **options)
    out = out.withColumns({"level": log_level(line), "masked": mask_line(line), "tokens": upper_tokens(line),
                           "error_type": error_type(line)})
    return level_filter(out, min_level, line) if min_level else out


def pattern_hits(lines: DataFrame, patterns=ROUTER_PATTERNS, line: str = "line", keep=("log_id",)) -> DataFrame:
    """Pattern hits per line; no state."""
    return match_patterns(lines, patterns, line, keep)


def incidents(lines: DataFrame, gap_s: int = 60, keys=("log_id",), line: str = "line", ts: str = "ts",
              watermark: str = WATERMARK) -> DataFrame:
    """Clusters of classified lines as session windows; emitted once the watermark passes their end."""
    rows = compute_once(lines.where(F.col(ts).isNotNull()).select(*keys, ts, line), {"etype": error_type(line)})
    rows = rows.where("etype IS NOT NULL").withWatermark(ts, watermark)
    out = rows.groupBy(*keys, F.session_window(ts, f"{gap_s} seconds").alias("w")).agg(
        F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count("*").alias("error_count"),
        F.bit_or(type_mask(F.col("etype"))).alias("mask"))
    return out.select(*keys, "start_time", "end_time", "error_count", types_of(F.col("mask")).alias("unique_error_types"),
                      F.when(F.col("error_count") > 10, "HIGH").otherwise("MEDIUM").alias("severity"))


def anomalies(lines: DataFrame, baseline: DataFrame, multiplier: float = 3.0, bucket_s: int = 60, keys=("log_id",),
              line: str = "line", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Token counts per epoch-aligned minute against a static ``(keys, token, baseline_avg)`` table."""
    rows = compute_once(lines.where(F.col(ts).isNotNull()).select(*keys, ts, line), {"tokens": upper_tokens(line)})
    rows = rows.withWatermark(ts, watermark).select(*keys, ts, F.explode("tokens").alias("token"))
    counts = rows.groupBy(*keys, "token", F.window(ts, f"{bucket_s} seconds").alias("w")).agg(F.count("*").alias("count"))
    # Computed once and not in every batch; it may be as large as the logs, so it is never broadcast.
    baseline = materialized(baseline.select(*keys, "token", "baseline_avg"), "baseline").hint("merge")
    out = counts.join(baseline, [*keys, "token"])
    factor = F.try_divide("count", "baseline_avg")
    return out.where(factor >= multiplier).select(
        *keys, "token", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count",
        factor.alias("spike_factor"), severity_of(factor).alias("severity"))


def novel_templates(lines: DataFrame, keys=("log_id",), line: str = "line", ts: str | None = None,
                    horizon: str | None = None) -> DataFrame:
    """Each template once per key.

    With ``ts`` and ``horizon`` a template is reported again after it stayed away for the
    horizon, and state is bounded by it; without, every template is remembered.
    """
    rows = compute_once(lines.select(*keys, line, *([ts] if ts else [])), {"template": template_key(line)}).drop(line)
    if ts and horizon:
        return rows.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([*keys, "template"])
    return rows.dropDuplicates([*keys, "template"])


def spikes(events: DataFrame, baseline: DataFrame, spike_threshold: float = 2.0, min_users: int = 50, min_errors: int = 100,
           monitored: dict[str, list[str]] | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Rate of the trailing hour every five minutes against a static ``(dimension, value, baseline_rate)``.

    Users are counted exactly.  Rows are combined by five minutes and a part of the users first, so only combined slices, and not rows or users,
    are spread over the twelve hours they belong to; state grows with slices and with the ids they hold.  A row is late once its slice is closed.
    """
    rows = by_dimension(events.withWatermark("ts", watermark), monitored=monitored)
    part = F.pmod(F.xxhash64("user_id"), F.lit(USER_PARTS)).alias("part")
    slices = rows.groupBy("dimension", "value", part, F.window("ts", "5 minutes").alias("s")).agg(
        F.count("*").alias("n"), F.collect_set("user_id").alias("users"))
    by_part = slices.groupBy("dimension", "value", "part", F.window(F.window_time("s"), "1 hour", "5 minutes").alias("w")).agg(
        F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("users")))).cast("bigint").alias("users"))
    hourly = by_part.groupBy("dimension", "value", "w").agg(F.sum("n").alias("current_rate"), F.sum("users").alias("affected_users"))
    out = hourly.join(baseline.where("baseline_rate > 0"), ["dimension", "value"])
    factor = F.try_divide("current_rate", "baseline_rate")
    out = out.where((factor >= spike_threshold) & (F.col("affected_users") >= min_users) & (F.col("current_rate") * 24 >= min_errors))
    return out.select("dimension", "value", F.col("w.end").alias("as_of"), "current_rate", "baseline_rate", factor.alias("spike_factor"),
                      "affected_users", F.when(factor >= 3.0, "high").otherwise("medium").alias("priority"))
