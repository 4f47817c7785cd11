"""Error rates, spikes and regressions after a change.  Rates are errors per hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import as_col
from faultline.operators import segmented as seg
from faultline.rules import vocab
from faultline.session import materialized

HOUR = 3_600_000_000
BASELINE_HOURS = 168
WATCH_HOURS = 72


def by_dimension(events: DataFrame, dimensions=("app", "layer", "chipset", "error_category"),
                 monitored: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per event and dimension, restricted to the monitored values."""
    monitored = vocab.MONITORED if monitored is None else monitored
    cells = F.array_compact(F.array(*[
        F.when(F.col(d).isin(monitored[d]), F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")))
        for d in dimensions if d in monitored]))
    return events.select("ts", "user_id", F.explode(cells).alias("d")).select("ts", "user_id", "d.*")


def _trailing(ts: Column, as_of: Column, hours: float) -> Column:
    at = F.unix_micros(as_of) - F.unix_micros(ts)
    return (at >= 0) & (at < int(hours * HOUR))


def error_rates(events: DataFrame, as_of: Column | str, keys=("dimension", "value"), window_hours: float = 1,
                baseline_hours: int = BASELINE_HOURS, approximate_users: bool = False) -> DataFrame:
    """Current rate, baseline rate and affected users per key, in one pass.

    The baseline is the mean of the hourly rates, empty hours included.
    """
    as_of = as_col(as_of)
    ts = F.col("ts")
    longest = max(window_hours, baseline_hours)
    # A plain range on the column reaches the file scan.
    rows = events.where((ts > as_of - F.expr(f"INTERVAL {int(longest * 3600)} SECONDS")) & (ts <= as_of))
    users = F.approx_count_distinct("user_id") if approximate_users else F.count_distinct("user_id")
    out = rows.groupBy(*keys).agg(
        (F.count_if(_trailing(ts, as_of, window_hours)) / window_hours).alias("current_rate"),
        (F.count_if(_trailing(ts, as_of, baseline_hours)) / baseline_hours).alias("baseline_rate"),
        users.alias("affected_users"))
    return out


def proactive_spikes(events: DataFrame, as_of: Column | str, spike_threshold: float = 2.0, min_users: int = 50,
                     min_errors: int = 100, monitored: dict[str, list[str]] | None = None) -> DataFrame:
    """Alerts for dimension values whose rate of the last hour stands out against seven days."""
    rates = error_rates(by_dimension(events, monitored=monitored), as_of).where("baseline_rate > 0")
    factor = F.try_divide("current_rate", "baseline_rate")
    out = rates.withColumns({"spike_factor": factor, "error_count": F.floor(F.col("current_rate") * 24).cast("bigint")})
    out = out.where((F.col("spike_factor") >= spike_threshold) & (F.col("affected_users") >= min_users)
                    & (F.col("error_count") >= min_errors))
    tenths = F.round("spike_factor", 1).cast("decimal(20,1)").cast("string")
    title = F.concat(F.lit("Proactive Detection: "), F.upper("dimension"), F.lit("="), F.col("value"),
                     F.lit(" error rate spike ("), tenths, F.lit("x)"))
    return out.withColumns({
        "priority": F.when(F.col("spike_factor") >= 3.0, "high").otherwise("medium"),
        "duration_minutes": F.lit(5), "title": title})


def regressions(changes: DataFrame, events: DataFrame, spike_threshold: float = 1.5, revert_threshold: float = 2.0,
                watch_hours: int = WATCH_HOURS, baseline_hours: int = BASELINE_HOURS) -> DataFrame:
    """First hour after each merge whose rate exceeds the week before it.

    ``changes`` is ``(change_id, ticket_id, merged_at, error_category, app, chipset)`` with
    nullable app and chipset; ``events`` carries the same dimensions.  Events and changes are
    never joined row by row, and no row is made per change and hour: see ``_first_spikes``.
    """
    dims = ["error_category", "app", "chipset"]
    any_value = F.lit(None).cast("string")
    # Every event counts for its category alone, with its app, with its chipset, and with both.
    grouped = events.groupBy(*dims, F.unix_micros("ts").alias("us")).agg(F.count("*").alias("c"))
    variants = F.array(*[F.struct(a.alias("app"), b.alias("chipset"))
                         for a in (any_value, F.col("app")) for b in (any_value, F.col("chipset"))])
    grouped = grouped.select("error_category", "us", "c", F.explode(F.array_distinct(variants)).alias("v"))
    star = F.lit("*")
    keys = ["error_category", "app", "chipset"]
    counts = changes.groupBy("change_id").agg(F.count("*").alias("_n")).where("_n > 1").select("change_id", F.lit(True).alias("_again"))
    marks = changes.where("error_category IS NOT NULL AND merged_at IS NOT NULL").join(counts, "change_id", "left").select(
        "change_id", "error_category", F.coalesce("app", star).alias("app"), F.coalesce("chipset", star).alias("chipset"),
        F.unix_micros("merged_at").alias("us"), F.col("_again").isNotNull().alias("again"))
    asked = marks.groupBy(*keys, "us").agg(F.bool_or("again").alias("whole"))
    points = grouped.select("error_category", F.coalesce("v.app", star).alias("app"),
                            F.coalesce("v.chipset", star).alias("chipset"), "us", "c")
    wanted = marks.select(*keys).distinct()
    points = points.join(wanted, keys, "left_semi").where("us IS NOT NULL").groupBy(*keys, "us").agg(F.sum("c").alias("c"))
    found = marks.join(_first_spikes(points, asked, keys, spike_threshold, watch_hours, baseline_hours), [*keys, "us"])
    once = found.where("NOT again AND hour IS NOT NULL").select(
        "change_id", "baseline_rate", F.col("hour").alias("hours_after_merge"), F.col("rate").alias("current_rate"))
    # Rows that share an id are one change: its counts are those of all of them, in order.
    per = found.where("again").select("change_id", "start", F.posexplode("seen").alias("h", "seen")).groupBy("change_id").agg(
        F.max("start").alias("start"), F.array_sort(F.collect_list(F.struct("h", "seen"))).alias("seen"))
    baseline = (F.get("seen", F.lit(0))["seen"] - F.col("start")) / baseline_hours
    per = per.withColumn("baseline_rate", baseline).where("baseline_rate > 0")
    rates = F.transform(F.sequence(F.lit(1), F.lit(watch_hours)), lambda h: F.struct(
        h.alias("hour"), (F.get("seen", h)["seen"] - F.get("seen", h - 1)["seen"]).cast("double").alias("rate")))
    first = F.get(F.filter(rates, lambda r: F.try_divide(r["rate"], F.col("baseline_rate")) >= spike_threshold), F.lit(0))
    again = per.withColumn("a", first).where("a IS NOT NULL").select(
        "change_id", "baseline_rate", F.col("a.hour").alias("hours_after_merge"), F.col("a.rate").alias("current_rate"))
    alerts = once.unionByName(again)
    alerts = changes.join(alerts, "change_id").withColumn(
        "spike_factor", F.try_divide("current_rate", "baseline_rate"))
    by_app = F.col("app").isNotNull()
    alerts = alerts.withColumns({
        "dimension": F.when(by_app, "app").otherwise("error_category"),
        "value": F.when(by_app, F.col("app")).otherwise(F.col("error_category")),
        "revert_recommended": F.col("spike_factor") >= revert_threshold})
    return _with_users(materialized(alerts, "alerts"), events)


PART_ROWS = 50_000


def _first_spikes(points: DataFrame, asked: DataFrame, keys, threshold: float, watch_hours: int, baseline_hours: int) -> DataFrame:
    """For each asked ``(keys, us)``, the baseline rate and the first hour behind it whose rate is ``threshold`` times as high.

    All hour boundaries of one moment lie at the same phase of the hour, so the hour is cut into parts, more where a key has more rows.  A
    task gets one part of one key: its points and moments, and per hour how many points of the key came before the part.  The count
    before any boundary follows from these; no row per boundary leaves the task.  Where ``whole`` is set the counts themselves are returned.
    """
    rows = points.select(*keys).unionByName(asked.select(*keys)).groupBy(*keys).agg(F.count("*").alias("rows"))
    parts = F.least(F.lit(3600), F.ceil(F.col("rows") / PART_ROWS)).cast("bigint")
    sizes = rows.select(*keys, parts.alias("parts"))

    def in_parts(df):
        phase = F.pmod("us", F.lit(HOUR))
        return df.join(sizes, keys).withColumns({"slot": F.col("us") - phase, "part": F.floor(phase * F.col("parts") / HOUR).cast("bigint")})

    points, asked = in_parts(points), in_parts(asked)
    counts = points.groupBy(*keys, "slot", "part").agg(F.sum("c").alias("c"))
    # Hours with points and those behind them, which tell that nothing follows.
    hours = points.select(*keys, "parts", "slot").distinct()
    hours = hours.select(*keys, "parts", F.explode(F.array(F.col("slot"), F.col("slot") + HOUR)).alias("slot")).distinct()
    cells = hours.select(*keys, "parts", "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    cells = cells.join(counts, [*keys, "slot", "part"], "left").withColumn("c", F.coalesce("c", F.lit(0).cast("bigint")))
    before = seg.running_sum(cells, keys, ["slot", "part"], F.col("c"), "seen", F.col("slot")).select(
        *keys, "part", F.lit(True).alias("sum"),
        (F.col("slot") + F.ceil(F.col("part") * HOUR / F.col("parts")).cast("bigint")).alias("us"), (F.col("seen") - F.col("c")).alias("c"))
    given = points.select(*keys, "part", F.lit(False).alias("sum"), "us", "c").unionByName(before)

    def spikes(given, asked):
        import numpy as np
        import pandas as pd

        sums, events = given[given["sum"]].sort_values("us"), given[~given["sum"]].sort_values("us")
        times, total = events["us"].to_numpy(), np.concatenate([[0], np.cumsum(events["c"].to_numpy())]).astype("int64")
        starts = sums["us"].to_numpy()
        base = np.concatenate([[0], sums["c"].to_numpy() - total[np.searchsorted(times, starts)]]).astype("int64")

        def seen(us):
            return base[np.searchsorted(starts, us, side="right")] + total[np.searchsorted(times, us)]

        asked = asked.sort_values("us", ignore_index=True)
        us = asked["us"].to_numpy()
        start, last = seen(us - baseline_hours * HOUR), seen(us)
        baseline = (last - start) / baseline_hours
        hour, rate = np.zeros(len(us), "int32"), np.zeros(len(us))
        still = np.flatnonzero(baseline > 0)
        last = last[still]
        for h in range(1, watch_hours + 1):
            now = seen(us[still] + h * HOUR)
            high = (now - last) / baseline[still] >= threshold
            hour[still[high]], rate[still[high]] = h, (now - last)[high]
            still, last = still[~high], now[~high]
        whole = pd.Series([seen(t + np.arange(watch_hours + 1) * HOUR) if w else None for t, w in zip(us, asked["whole"], strict=True)], dtype=object)
        out = asked[[*keys, "us"]].assign(start=start, baseline_rate=baseline, rate=rate, seen=whole)
        return out.assign(hour=pd.array(hour, "Int32")).assign(hour=lambda d: d["hour"].mask(hour == 0))

    types = ", ".join(f"{k} string" for k in keys)
    schema = f"{types}, us long, start long, baseline_rate double, rate double, seen array<long>, hour int"
    return given.groupBy(*keys, "part").cogroup(asked.select(*keys, "part", "us", "whole").groupBy(*keys, "part")).applyInPandas(spikes, schema)


def _with_users(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct users of the alert's dimension value within its hour, without listing them.

    An hour that starts at s holds a user once for the user's first event in it: the event at t counts where s lies after both t - 1 h and
    the user's event before, and not after t.  So every event adds one from there on and takes it back after t, and a running sum over these
    points, read where the alerts' hours start, counts the users.
    """
    start = F.unix_micros("merged_at") + (F.col("hours_after_merge") - 1) * HOUR
    asked = alerts.select("change_id", "dimension", "value", start.cast("bigint").alias("us"))
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("app", "error_category")])
    seen = events.select(F.unix_micros("ts").alias("us"), "user_id", F.explode(cells).alias("d")).select("us", "user_id", "d.*")
    seen = seen.where(F.col("user_id").isNotNull()).join(asked.select("dimension", "value").distinct(), ["dimension", "value"], "left_semi")
    # Deduplicated where the window needs the rows anyway.
    seen = seen.repartition("dimension", "value", "user_id").distinct()
    before = F.lag("us").over(Window.partitionBy("dimension", "value", "user_id").orderBy("us"))
    seen = seen.withColumn("_from", F.greatest(F.col("us") - HOUR, before))
    steps = seen.select("dimension", "value", F.explode(F.array(
        F.struct(F.col("_from").alias("us"), F.lit(1).cast("bigint").alias("c")), F.struct(F.col("us"), F.lit(-1).cast("bigint").alias("c")))).alias("e"))
    steps = steps.select("dimension", "value", "e.us", "e.c").groupBy("dimension", "value", "us").agg(F.sum("c").alias("c")).where("c <> 0")
    change = alerts.schema["change_id"].dataType
    points = steps.select("dimension", "value", "us", F.lit(1).alias("kind"), "c", F.lit(None).cast(change).alias("change_id"))
    marks = asked.select("dimension", "value", "us", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("c"), "change_id")
    run = seg.running_sum(marks.unionByName(points), ["dimension", "value"], ["us", "kind"], F.col("c"), "affected_users",
                          F.floor(F.col("us") / HOUR).cast("bigint")).where("kind = 0")
    return alerts.join(run.select("change_id", "affected_users"), "change_id", "left").withColumn(
        "affected_users", F.coalesce("affected_users", F.lit(0).cast("bigint")))


def regression_corrections(alerts: DataFrame, created_at: Column | str | None = None) -> DataFrame:
    """Alerts as correction records."""
    def two(column):
        return F.format_string("%.2f", F.col(column))

    text = F.concat(
        F.lit("Production regression detected "), two("spike_factor"), F.lit("x baseline. Error rate increased from "),
        two("baseline_rate"), F.lit(" to "), two("current_rate"), F.lit(" errors/hour. Affected "),
        F.col("affected_users").cast("string"), F.lit(" users."))
    at = F.col("merged_at") + F.make_interval(hours=F.col("hours_after_merge")) if created_at is None else as_col(created_at)
    return alerts.select(
        F.col("change_id").cast("string").alias("correction_id"), F.col("ticket_id").cast("string").alias("jira_ticket"),
        "error_category", F.lit("REGRESSION").alias("mistake_type"), text.alias("description"), text.alias("what_went_wrong"),
        F.lit("PRODUCTION_REGRESSION").alias("severity"), F.lit("TELEMETRY").alias("detected_by"),
        F.col("hours_after_merge").cast("double").alias("time_to_detect_hours"), at.alias("created_at"))
