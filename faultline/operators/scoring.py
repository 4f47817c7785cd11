"""Scores of fix candidates and the rates they rest on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import as_col
from faultline.functions.tickets import target_error_present
from faultline.rules import vocab
from faultline.session import materialized

# Signal weights, routing thresholds, path weights.
SIGNAL_WEIGHTS = {
    "llm_confidence": 0.20,
    "retrieval_similarity": 0.20,
    "validation_score": 0.35,
    "historical_success_rate": 0.15,
    "reproduction_bonus": 0.10,
}
ROUTING = {
    "ensemble": [(0.85, "AUTO_PR"), (0.65, "PR_WITH_REVIEW"), (0.45, "ANALYSIS_ONLY")],
    "generator": [(0.85, "AUTO_PR"), (0.60, "PR_WITH_REVIEW"), (0.40, "ANALYSIS_ONLY")],
}
PATH_WEIGHTS = {"alpha": 0.30, "beta": 0.30, "gamma": 0.40}


def route_confidence(p: Column | str, profile: str = "ensemble") -> Column:
    p = as_col(p)
    out = F.lit("ESCALATE_HUMAN")
    for threshold, name in reversed(ROUTING[profile]):
        out = F.when(p >= threshold, name).otherwise(out)
    return out


def ensemble_score(signals: DataFrame, platt_a: float = 1.0, platt_b: float = 0.0) -> DataFrame:
    """Add ``raw_score``, ``calibrated_score`` and ``routing``.

    The device boost counts only where the device run passed; with A=1 and B=0 the
    calibrated score is the logistic of the raw one, .50 to .82.
    """
    raw = sum((w * F.coalesce(name, F.lit(0.0)) for name, w in SIGNAL_WEIGHTS.items()), F.lit(0.0))
    boost = F.col("on_device_boost")
    raw = F.when(F.coalesce("on_device_passed", F.lit(False)) & (boost > 0), F.least(F.lit(1.5), raw + boost)).otherwise(raw)
    out = signals.withColumn("raw_score", raw)
    out = out.withColumn("calibrated_score", 1 / (1 + F.exp(-(platt_a * F.col("raw_score") + platt_b))))
    return out.withColumn("routing", route_confidence("calibrated_score"))


def rank_candidates(scored: DataFrame, keys=("ticket_id",), tie: str = "candidate_id") -> DataFrame:
    """Candidates per ticket, best calibrated score first; a ticket has a handful."""
    w = Window.partitionBy(*keys).orderBy(F.desc("calibrated_score"), tie)
    return scored.withColumn("rank", F.row_number().over(w))


def success_rates(history: DataFrame, category: str = "error_category", outcome: str = "outcome") -> DataFrame:
    """Attempts, successes and rate per category; outcomes that are not final are ignored."""
    good, bad = F.col(outcome).isin("SUCCESS", "MERGED"), F.col(outcome).isin("REVERTED", "REJECTED")
    out = history.where((good | bad) & F.col(category).isNotNull()).groupBy(category).agg(
        F.count("*").alias("total_attempts"), F.count_if(good).alias("successful_fixes"))
    return out.withColumn("success_rate", F.col("successful_fixes") / F.col("total_attempts"))


def success_rate(signals: DataFrame, rates: DataFrame, category: str = "error_category") -> DataFrame:
    """Attach the category's rate, .5 where there is no history."""
    known = rates.select(category, F.col("success_rate").alias("_rate"))
    return signals.join(known, category, "left").withColumn(
        "historical_success_rate", F.coalesce("_rate", F.lit(0.5))).drop("_rate")


def required_paths(layer: Column | str, category: Column | str, device: Column | bool = False) -> Column:
    """Validation paths a bug needs."""
    layer, category = as_col(layer), as_col(category)
    device = device if isinstance(device, Column) else F.lit(device)
    cross = layer == "CROSS_LAYER"
    return F.when(layer == "MEDIATEK", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        F.when((layer == "LOKI") | cross, "alpha"), F.when((layer == "HTML5") | cross, "beta"),
        F.when(F.coalesce(category.isin(vocab.DEVICE_CATEGORIES), F.lit(False)) | cross | device, "gamma"))))


def validation_score(results: DataFrame, candidates: DataFrame, id: str = "candidate_id") -> DataFrame:
    """Verdict, score, boost and duration per candidate.

    ``results`` has one row per path run: ``(candidate_id, path, passed, raised, duration_seconds,
    current_only, reproduced)``; ``candidates`` holds ``(candidate_id, required_paths)``.
    Absent paths count as passed, a path that raised fails the candidate and is not scored.
    """
    ran = ~F.coalesce("raised", F.lit(False))

    def path(name):
        return F.max(F.when((F.col("path") == name) & ran, F.struct(
            F.col("passed"), F.coalesce("current_only", F.lit(False)).alias("current_only"),
            F.coalesce("reproduced", F.lit(False)).alias("reproduced")))).alias(name)

    per = results.groupBy(id).agg(
        path("alpha"), path("beta"), path("gamma"), F.bool_or(~ran).alias("_raised"),
        F.sum(F.when(ran, F.col("duration_seconds"))).alias("_seconds"))
    out = candidates.join(per, id, "left")

    def present(name):
        return F.col(name).isNotNull()

    def passed(name):
        return F.coalesce(F.col(name)["passed"], F.lit(True))

    own = {
        "alpha": F.when(F.col("alpha")["current_only"], 0.65).when(F.col("alpha")["passed"], 1.0).otherwise(0.0),
        "beta": F.when(F.col("beta")["passed"], 1.0).otherwise(0.0),
        "gamma": F.least(F.lit(1.0), F.when(F.col("gamma")["passed"], 1.0).otherwise(0.0)
                         + F.when(F.col("gamma")["reproduced"], 0.10).otherwise(0.0)),
    }
    score, weight = F.lit(0.0), F.lit(0.0)
    for name, w in PATH_WEIGHTS.items():
        counted = present(name) & F.array_contains("required_paths", name)
        score = score + F.when(counted, own[name] * w).otherwise(0.0)
        weight = weight + F.when(counted, w).otherwise(0.0)
    device = F.array_contains("required_paths", "gamma") & present("gamma") & passed("gamma")
    boost = F.when(device, F.least(F.lit(0.30), 0.15 + F.when(F.col("gamma")["reproduced"], 0.10).otherwise(0.0)))
    return out.select(
        id, (~F.coalesce("_raised", F.lit(False)) & passed("alpha") & passed("beta") & passed("gamma")).alias("overall_passed"),
        F.when(weight > 0, score / F.greatest(weight, F.lit(0.1))).otherwise(0.0).alias("validation_score"),
        F.coalesce(boost, F.lit(0.0)).alias("confidence_boost"),
        F.coalesce(F.col("gamma")["passed"], F.lit(False)).alias("on_device_passed"),
        F.coalesce("_seconds", F.lit(0.0)).alias("total_duration_seconds"))


def attach_validation(candidates: DataFrame, results: DataFrame, scores: DataFrame,
                      id: str = "candidate_id") -> DataFrame:
    """Candidates with verdict and evidence: failure reasons in path order, or a fixed sentence.

    ``results`` carries ``failure_reasons array<string>`` per path; there are three paths.
    """
    reasons = results.groupBy(id).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("path", "failure_reasons"))), lambda s: s["failure_reasons"])).alias("_r"))
    out = candidates.join(scores.select(id, F.col("overall_passed").alias("validation_passed")), id, "left")
    out = out.join(reasons, id, "left")
    return out.withColumn("validation_evidence", F.when(F.size("_r") > 0, F.array_join("_r", "; "))
                          .otherwise("all paths passed")).drop("_r")


def build_signals(candidates: DataFrame, validation: DataFrame, reproduction: DataFrame | None = None,
                  rates: DataFrame | None = None, id: str = "candidate_id", ticket: str = "ticket_id",
                  shortcut: bool = False) -> DataFrame:
    """Signals per candidate; ``shortcut`` derives retrieval from ``retrieval_hits`` and fixes history at .7."""
    out = candidates.join(validation.select(
        id, "validation_score", "on_device_passed", F.col("confidence_boost").alias("on_device_boost")), id, "left")
    out = out.withColumns({
        "validation_score": F.coalesce("validation_score", F.lit(0.0)),
        "on_device_passed": F.coalesce("on_device_passed", F.lit(False)),
        "on_device_boost": F.coalesce("on_device_boost", F.lit(0.0))})
    if reproduction is not None:
        out = out.join(reproduction.select(ticket, F.col("reproducible").alias("_ok")), ticket, "left")
        out = out.withColumn("reproduction_bonus", F.when(F.coalesce("_ok", F.lit(False)), 0.10).otherwise(0.0)).drop("_ok")
    else:
        out = out.withColumn("reproduction_bonus", F.lit(0.0))
    if shortcut:
        return out.withColumns({
            "retrieval_similarity": F.least(0.1 + F.col("retrieval_hits") * 0.08, F.lit(0.9)),
            "historical_success_rate": F.lit(0.7)})
    return success_rate(out, rates) if rates is not None else out.withColumn("historical_success_rate", F.lit(0.5))


def fit_platt(history: DataFrame, raw: str = "raw_score", success: str = "success", steps: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """One row ``(platt_a, platt_b, sample_count)`` that minimises log loss on past outcomes.

    Newton steps over sums that Spark takes of the counted scores; a step that raises the loss is halved.  Where the two outcomes don't overlap
    (or one is missing) no finite curve fits best: the outcomes then count as ``(n1 + 1) / (n1 + 2)`` and ``1 / (n0 + 2)``.  Scores that
    are all equal give slope 0, and no history gives the identity (1, 0).  Rows without a finite score or an outcome are left out.
    """
    x, y = F.col(raw).cast("double"), F.col(success).cast("double")
    rows = history.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')")
    counts = materialized(rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("n")), "scores")
    on, off = F.col("y") > 0.5, F.col("y") <= 0.5
    total, ones, low1, high1, low0, high0 = counts.agg(
        F.sum("n"), F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0.0)), F.min(F.when(on, F.col("x"))), F.max(F.when(on, F.col("x"))),
        F.min(F.when(off, F.col("x"))), F.max(F.when(off, F.col("x")))).first()
    if not total:
        return counts.sparkSession.sql("SELECT 1.0D AS platt_a, 0.0D AS platt_b, 0L AS sample_count")
    zeros = total - ones
    overlap = ones > 0 and zeros > 0 and high0 > low1 and high1 > low0
    target1, target0 = (1.0, 0.0) if overlap else ((ones + 1) / (ones + 2), 1 / (zeros + 2))
    low, high = min(v for v in (low1, low0) if v is not None), max(v for v in (high1, high0) if v is not None)
    # Scores from 0 to 1 keep the steps well scaled.
    spread = high - low or 1.0
    unit, target = (F.col("x") - low) / spread, F.when(on, target1).otherwise(target0)
    mean = (ones * target1 + zeros * target0) / total

    def sums(a, b):
        z = a * unit + b
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        terms = (loss, (p - target) * unit, p - target, p * (1 - p) * unit * unit, p * (1 - p) * unit, p * (1 - p))
        return counts.agg(*[F.sum(F.col("n") * t) for t in terms]).first()

    a, b = 0.0, math.log(mean / (1 - mean))
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(steps if high > low else 0):
        if abs(ga) + abs(gb) <= tolerance * total:
            break
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = 1.0
        while (now := sums(a - size * da, b - size * db))[0] > loss + 1e-12 * total and size > 1e-6:
            size /= 2
        a, b = a - size * da, b - size * db
        loss, ga, gb, haa, hab, hbb = now
    return counts.agg(F.lit(a / spread).alias("platt_a"), F.lit(b - a * low / spread).alias("platt_b"), F.sum("n").cast("bigint").alias("sample_count"))


def chipset_penalty(results: DataFrame, id: str = "candidate_id") -> DataFrame:
    """Confidence change per run: -.15 on the current chipset where only the legacy one passed."""
    sides = results.groupBy(id).agg(
        F.bool_or(F.when(F.col("chipset") == "MTK_LEGACY", F.col("passed"))).alias("_legacy"),
        F.bool_or(F.when(F.col("chipset") == "MTK_CURRENT", F.col("passed"))).alias("_current"))
    out = results.join(sides, id)
    hit = (F.col("chipset") == "MTK_CURRENT") & F.col("_legacy") & ~F.col("_current")
    return out.withColumn("confidence_delta", F.when(hit, -0.15).otherwise(0.0)).drop("_legacy", "_current")


def usage_cost(calls: DataFrame, prices: dict[str, tuple[float, float]], keys=()) -> DataFrame:
    """Token totals and cost; ``prices`` maps a model name to its price per 1000 tokens in and out."""
    price_in = price_out = F.lit(None).cast("double")
    for name, (into, out) in prices.items():
        price_in = F.when(F.col("model") == name, into).otherwise(price_in)
        price_out = F.when(F.col("model") == name, out).otherwise(price_out)
    cost = F.col("input_tokens") / 1000 * price_in + F.col("output_tokens") / 1000 * price_out
    return calls.groupBy(*keys).agg(
        F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"),
        F.sum(cost).alias("total_cost"))


def _error_lines(df: DataFrame, keys, line: str) -> DataFrame:
    text = F.col(line)
    return df.where(text.contains("ERROR") | text.contains("FATAL") | text.contains("CRASH")).select(*keys, line)


def new_errors(before: DataFrame, after: DataFrame, keys=("id",), line: str = "line") -> DataFrame:
    """Distinct error lines after a change that did not occur before it."""
    keys = list(keys)
    return _error_lines(after, keys, line).distinct().join(
        _error_lines(before, keys, line).distinct(), [*keys, line], "left_anti")


def before_after_verdict(before: DataFrame, after: DataFrame, keys=("id",), line: str = "line",
                         category: str = "error_category") -> DataFrame:
    """Pass or fail per id: no new error lines and the target error gone."""
    keys = list(keys)
    fresh = new_errors(before, after, keys, line).groupBy(*keys).agg(F.count("*").alias("new_error_count"))
    out = after.groupBy(*keys).agg(F.bool_or(target_error_present(line, category)).alias("target_present"))
    out = out.join(fresh, keys, "left").withColumn("new_error_count", F.coalesce("new_error_count", F.lit(0).cast("bigint")))
    some = F.col("new_error_count") > 0
    reasons = F.array_compact(F.array(
        F.when(some, F.concat(F.lit("New errors introduced: "), F.col("new_error_count").cast("string"))),
        F.when(F.col("target_present"), F.lit("Target error still present after fix"))))
    return out.withColumns({"passed": ~some & ~F.col("target_present"), "reasons": reasons})
