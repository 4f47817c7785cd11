"""Volume filters and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.lines import is_hardware_error, level_rank, log_level
from faultline.functions.text import as_col, strip
from faultline.operators import segmented as seg
from faultline.rules import formats


def time_window(df: DataFrame, anchor: Column | str, hours: float = 24, ts: str = "ts",
                keys=("log_id",), order: str = "line_no") -> DataFrame:
    """Lines within ``anchor`` ± hours (inclusive), per log, in line order.

    A line without a timestamp follows the last timestamped line and takes its
    ``ts``; leading ones are dropped.  Reading stops at the first line stamped after
    the window, so later lines inside it are lost, as in a one-pass reader.
    ``anchor`` may be a column, constant within a log.
    """
    keys = list(keys)
    anchor = as_col(anchor)
    span = int(hours * 3600 * 1_000_000)
    us = F.unix_micros(F.col(ts))
    lo, hi = F.unix_micros(anchor) - span, F.unix_micros(anchor) + span
    block = seg.row_block(order)
    rows = seg.placed(df, keys, block).withColumns({"_us": us, "_lo": lo, "_hi": hi})
    # One narrow pass gives, per block, the carried timestamp and the cut-off line.
    table = rows.groupBy(seg.KEYS, seg.BLOCK).agg(
        F.max_by("_us", F.when(F.col("_us").isNotNull(), F.col(order))).alias("_tail"),
        F.min(F.when(F.col("_us") > F.col("_hi"), F.col(order))).alias("_late"))
    everything = seg.Window.partitionBy(seg.KEYS)
    table = table.select(
        seg.KEYS, seg.BLOCK,
        F.last("_tail", ignorenulls=True).over(seg.before()).alias("_carry"),
        F.min("_late").over(everything).alias("_cut"))
    rows = rows.withColumn("_in", F.last("_us", ignorenulls=True).over(
        seg.inside([order]).rowsBetween(seg.Window.unboundedPreceding, 0)))
    rows = rows.join(table, [seg.KEYS, seg.BLOCK])
    known = F.coalesce("_in", "_carry")
    kept = rows.where((F.col("_cut").isNull() | (F.col(order) < F.col("_cut")))
                      & known.between(F.col("_lo"), F.col("_hi")))
    return kept.withColumn(ts, F.timestamp_micros(known)).drop(
        "_us", "_lo", "_hi", seg.KEYS, seg.BLOCK, "_in", "_carry", "_cut")


def keeps_level(line: Column | str, min_level: str = "WARNING") -> Column:
    """Lines of the level or above, and lines whose level is unknown."""
    name = formats.GATE_LEVEL_ALIASES.get(min_level.upper(), min_level.upper())
    rank = level_rank(log_level(line))
    return rank.isNull() | (rank >= formats.LEVEL_RANK[name])


def level_filter(df: DataFrame, min_level: str = "WARNING", line: str = "line") -> DataFrame:
    return df.where(keeps_level(line, min_level))


def hardware_errors(df: DataFrame, line: str = "line") -> DataFrame:
    """Lines that report broken hardware, stripped."""
    return df.where(is_hardware_error(line)).withColumn(line, strip(F.col(line)))


def level_statistics(df: DataFrame, keys=("log_id",), min_level: str = "WARNING",
                     line: str = "line") -> DataFrame:
    """Total, kept and discarded lines, and kept lines per level, per key."""
    keep, level = keeps_level(line, min_level), log_level(line)
    rows = df.select(*keys, keep.alias("_keep"), level.alias("_level"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_lines"),
        F.count_if("_keep").alias("lines_kept"),
        F.count_if(~F.col("_keep")).alias("lines_discarded"),
        (F.count_if(~F.col("_keep")) / F.count("*") * 100).alias("discard_percentage"),
        *[F.count_if(F.col("_keep") & (F.col("_level") == name)).alias(f"kept_{name.lower()}")
          for name in ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")])


MIN_KEPT_LINES = 10
MIN_TIMESTAMP_COVERAGE = 0.5


def quality_gate(df: DataFrame, min_level: str = "WARNING", keys=("log_id",), line: str = "line",
                 ts: str = "ts", file_id: str | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Pass or fail, score and reasons per key, over lines that survived ``time_window``.

    ``expected`` (one row per key) keeps keys that have no lines at all.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(ts).isNotNull().alias("_ts"), keeps_level(line, min_level).alias("_keep"),
                     *([F.col(file_id).alias("_file")] if file_id else []))
    files = F.count_distinct("_file") if file_id else F.lit(1).cast("bigint")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("total_lines"), F.count_if("_keep").alias("kept_lines"),
        F.count_if("_ts").alias("_stamped"), files.alias("log_file_count"))
    if expected is not None:
        out = expected.select(*keys).distinct().join(out, keys, "left").na.fill(0)
    total, kept = F.col("total_lines"), F.col("kept_lines")
    some = F.greatest(total, F.lit(1))
    coverage = F.col("_stamped") / some
    out = out.withColumn("timestamp_coverage", coverage)
    score = F.when(total > 0, kept / some * 0.4 + F.col("timestamp_coverage") * 0.4
                   + F.least(kept / 100, F.lit(1.0)) * 0.2).otherwise(0.0)

    def percent(x):
        return F.concat(F.round(x * 100, 1).cast("decimal(5,1)").cast("string"), F.lit("%"))

    few = kept < MIN_KEPT_LINES
    low = F.col("timestamp_coverage") < MIN_TIMESTAMP_COVERAGE
    none = F.col("log_file_count") == 0
    reasons = F.array_compact(F.array(
        F.when(few, F.concat(F.lit("Insufficient log signal after filtering: "), kept.cast("string"),
                             F.lit(f" lines (minimum: {MIN_KEPT_LINES})"))),
        F.when(low, F.concat(F.lit("Low timestamp coverage: "), percent(F.col("timestamp_coverage")),
                             F.lit(" (minimum: 50.0%)"))),
        F.when(none, F.lit("No log files provided"))))
    return out.select(*keys, (~few & ~low & ~none).alias("passed"), score.alias("score"),
                      reasons.alias("reasons"), "log_file_count", "total_lines", "kept_lines",
                      "timestamp_coverage", (1 - kept / some).alias("reduction_ratio"))


def browser_log_errors(console: DataFrame, network: DataFrame, keys=("run_id",)) -> DataFrame:
    """Console errors and warnings as text; requests and failed responses as they are."""
    none = F.lit(None)
    a = console.where(F.col("type").isin("error", "warning")).select(
        *keys, F.lit("console").alias("kind"),
        F.concat(F.lit("["), F.upper("type"), F.lit("] "), F.col("text")).alias("text"),
        none.cast("string").alias("url"), none.cast("string").alias("method"), none.cast("int").alias("status"))
    is_request = F.col("status").isNull()
    b = network.where(is_request | (F.col("status") >= 400)).select(
        *keys, F.when(is_request, "request").otherwise("response_error").alias("kind"),
        none.cast("string").alias("text"), F.col("url"),
        F.when(is_request, F.col("method")).alias("method"), F.col("status").cast("int").alias("status"))
    return a.unionByName(b)


def memory_filter(records: DataFrame, as_of: Column | str, bug_layer=None, error_category=None,
                  validation_method=None, exclude_regressions: bool = True,
                  min_confidence: float | None = None, max_age_days: int | None = None) -> DataFrame:
    """Optional equality, range and age predicates on stored records, all pushed to the scan.

    The regression filter applies only where the records carry that column.
    """
    out = records
    for column, value in (("bug_layer", bug_layer), ("error_category", error_category),
                          ("validation_method", validation_method)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if exclude_regressions and "regression_detected" in records.columns:
        out = out.where(~F.col("regression_detected"))
    if min_confidence is not None:
        out = out.where(F.col("confidence_score") >= min_confidence)
    if max_age_days is not None:
        cutoff = F.date_trunc("second", as_col(as_of)) - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
        out = out.where(F.col("created_at") >= cutoff)
    return out


