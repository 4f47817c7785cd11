"""Validation, signals, ensemble scores and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, table
from checks.logview import LINES_SQL, event_lines
from checks.temporal import rounded
from faultline.operators import scoring

# One path run per order and path, taken from the order's lines.
_RUNS = """SELECT candidate_id, path, max(q) < 46 AS passed, min(q) > 44 AS raised, sum(q) AS duration_seconds,
    max(d) > 0.08 AS current_only, min(d) < 0.02 AS reproduced
  FROM (SELECT l_orderkey AS candidate_id, CASE l_linenumber % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS path,
    l_quantity AS q, l_discount AS d FROM {l}) x GROUP BY candidate_id, path"""
# One candidate per order.
_CANDIDATES = """SELECT o_orderkey AS candidate_id, o_custkey AS ticket_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'LOKI' WHEN 1 THEN 'HTML5' WHEN 2 THEN 'CROSS_LAYER' WHEN 3 THEN 'MEDIATEK' ELSE 'UNKNOWN' END AS bug_layer,
  CASE o_orderkey % 3 WHEN 0 THEN 'KEYDOWN_NOT_FIRED' WHEN 1 THEN o_orderpriority END AS error_category,
  (o_orderkey % 97) / 96.0e0 AS llm_confidence, (o_orderkey % 89) / 88.0e0 AS retrieval_similarity, o_orderkey % 12 AS retrieval_hits,
  o_custkey % 4 = 0 AS device FROM {o}"""
RUNS_SQL = "runs AS (" + _RUNS.format(l="lineitem") + ")"
CAND_SQL = "cands AS (" + _CANDIDATES.format(o="orders") + ")"


def runs(spark, sf):
    return spark.sql(_RUNS.format(l="{l}"), l=table(spark, sf, "lineitem"))


def candidates(spark, sf):
    out = spark.sql(_CANDIDATES.format(o="{o}"), o=table(spark, sf, "orders"))
    return out.withColumn("required_paths", scoring.required_paths("bug_layer", "error_category", F.col("device")))


REQ_SQL = """req AS (SELECT *, bug_layer IN ('LOKI', 'CROSS_LAYER') AS ra, bug_layer IN ('HTML5', 'CROSS_LAYER') AS rb,
  bug_layer <> 'MEDIATEK' AND (coalesce(error_category = 'KEYDOWN_NOT_FIRED', false) OR bug_layer = 'CROSS_LAYER' OR device) AS rg FROM cands)"""


@check("e17_required_paths", f"""WITH {CAND_SQL}, {REQ_SQL} SELECT candidate_id, concat_ws(',', CASE WHEN ra THEN 'alpha' END,
  CASE WHEN rb THEN 'beta' END, CASE WHEN rg THEN 'gamma' END) AS paths FROM req""")
def e17(spark, sf):
    return candidates(spark, sf).select("candidate_id", F.array_join("required_paths", ",").alias("paths"))


VALID_SQL = """pv AS (SELECT candidate_id, max(CASE WHEN path = 'alpha' AND NOT raised THEN passed::int END) AS ap,
    bool_or(path = 'alpha' AND NOT raised AND current_only) AS ac, max(CASE WHEN path = 'beta' AND NOT raised THEN passed::int END) AS bp,
    max(CASE WHEN path = 'gamma' AND NOT raised THEN passed::int END) AS gp, bool_or(path = 'gamma' AND NOT raised AND reproduced) AS gr,
    bool_or(raised) AS raised, sum(CASE WHEN NOT raised THEN duration_seconds END) AS secs FROM runs GROUP BY candidate_id),
vx AS (SELECT r.*, p.* EXCLUDE (candidate_id), (ra AND ap IS NOT NULL)::int * 0.3 + (rb AND bp IS NOT NULL)::int * 0.3 + (rg AND gp IS NOT NULL)::int * 0.4 AS w,
    CASE WHEN ra AND ap IS NOT NULL THEN 0.3 * CASE WHEN ac THEN 0.65 ELSE ap END ELSE 0 END
    + CASE WHEN rb AND bp IS NOT NULL THEN 0.3 * bp ELSE 0 END
    + CASE WHEN rg AND gp IS NOT NULL THEN 0.4 * least(1, gp + CASE WHEN gr THEN 0.1 ELSE 0 END) ELSE 0 END AS s
  FROM req r LEFT JOIN pv p USING (candidate_id)),
valid AS (SELECT *, NOT coalesce(raised, false) AND coalesce(ap, 1) + coalesce(bp, 1) + coalesce(gp, 1) = 3 AS overall_passed,
    CASE WHEN w > 0 THEN s::double / w::double ELSE 0 END AS validation_score,
    CASE WHEN rg AND gp = 1 THEN least(0.3, 0.15 + CASE WHEN gr THEN 0.1 ELSE 0 END) ELSE 0 END::double AS confidence_boost,
    coalesce(gp = 1, false) AS on_device_passed, coalesce(secs, 0) AS total_duration_seconds FROM vx)"""


def validated(spark, sf):
    return scoring.validation_score(runs(spark, sf), candidates(spark, sf))


@check("e16_validation_score", f"""WITH {RUNS_SQL}, {CAND_SQL}, {REQ_SQL}, {VALID_SQL} SELECT candidate_id, overall_passed,
  round(validation_score, 6) AS validation_score, round(confidence_boost, 6) AS confidence_boost, on_device_passed,
  round(total_duration_seconds, 6) AS total_duration_seconds FROM valid""")
def e16(spark, sf):
    return rounded(validated(spark, sf), "validation_score", "confidence_boost", "total_duration_seconds")


@check("d13_attach_validation", f"""WITH {RUNS_SQL}, {CAND_SQL}, {REQ_SQL}, {VALID_SQL},
  fr AS (SELECT candidate_id, string_agg(path || ' failed', '; ' ORDER BY path) AS f FROM runs WHERE NOT passed GROUP BY candidate_id)
  SELECT candidate_id, overall_passed AS validation_passed, coalesce(f, 'all paths passed') AS validation_evidence FROM valid LEFT JOIN fr USING (candidate_id)""")
def d13(spark, sf):
    failed = F.when(~F.col("passed"), F.array(F.concat("path", F.lit(" failed")))).otherwise(F.array().cast("array<string>"))
    results = runs(spark, sf).withColumn("failure_reasons", failed)
    cands = candidates(spark, sf)
    out = scoring.attach_validation(cands, results, scoring.validation_score(results, cands))
    return out.select("candidate_id", "validation_passed", "validation_evidence")


# Past outcomes: one per order.
_HISTORY = """SELECT o_orderpriority AS error_category, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'REVERTED' ELSE 'PENDING' END AS outcome FROM {o}"""
RATES_SQL = "rates AS (SELECT error_category, count(*) AS total_attempts, count(*) FILTER (WHERE outcome = 'SUCCESS') AS successful_fixes, " \
    "count(*) FILTER (WHERE outcome = 'SUCCESS') / count(*) AS success_rate FROM (" + _HISTORY.format(o="orders") + ") WHERE outcome <> 'PENDING' GROUP BY ALL)"


def rates(spark, sf):
    return scoring.success_rates(spark.sql(_HISTORY.format(o="{o}"), o=table(spark, sf, "orders")))


@check("e15_success_rates", f"WITH {RATES_SQL} SELECT error_category, total_attempts, successful_fixes, round(success_rate, 6) AS success_rate FROM rates")
def e15(spark, sf):
    return rounded(rates(spark, sf), "success_rate")


@check("d12_success_rate", f"""WITH {CAND_SQL}, {RATES_SQL} SELECT candidate_id, round(coalesce(success_rate, 0.5), 6) AS historical_success_rate
  FROM cands LEFT JOIN rates USING (error_category)""")
def d12(spark, sf):
    out = scoring.success_rate(candidates(spark, sf), rates(spark, sf))
    return rounded(out.select("candidate_id", "historical_success_rate"), "historical_success_rate")


SIGNAL_SQL = f"""{RUNS_SQL}, {CAND_SQL}, {REQ_SQL}, {VALID_SQL}, {RATES_SQL},
repro AS (SELECT c_custkey AS ticket_id, c_acctbal > 5000 AS reproducible FROM customer),
sig AS (SELECT v.*, coalesce(success_rate, 0.5) AS hist, CASE WHEN reproducible THEN 0.1 ELSE 0 END::double AS bonus
  FROM valid v LEFT JOIN rates USING (error_category) LEFT JOIN repro USING (ticket_id)),
raw AS (SELECT *, 0.20 * llm_confidence + 0.20 * retrieval_similarity + 0.35 * validation_score + 0.15 * hist + 0.10 * bonus AS r0 FROM sig),
sc AS (SELECT *, CASE WHEN on_device_passed AND confidence_boost > 0 THEN least(1.5, r0 + confidence_boost) ELSE r0 END AS raw_score FROM raw),
scored AS (SELECT *, 1 / (1 + exp(-(6 * raw_score - 3))) AS calibrated_score FROM sc),
ranked AS (SELECT *, CASE WHEN calibrated_score >= 0.85 THEN 'AUTO_PR' WHEN calibrated_score >= 0.65 THEN 'PR_WITH_REVIEW'
    WHEN calibrated_score >= 0.45 THEN 'ANALYSIS_ONLY' ELSE 'ESCALATE_HUMAN' END AS routing,
  row_number() OVER (PARTITION BY ticket_id ORDER BY calibrated_score DESC, candidate_id) AS rank FROM scored)"""


def signals(spark, sf):
    repro = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticket_id"), (F.col("c_acctbal") > 5000).alias("reproducible"))
    return scoring.build_signals(candidates(spark, sf), validated(spark, sf), repro, rates(spark, sf))


@check("j3_build_signals", f"""WITH {SIGNAL_SQL} SELECT candidate_id, round(llm_confidence, 6) AS llm_confidence, round(retrieval_similarity, 6) AS retrieval_similarity,
  round(validation_score, 6) AS validation_score, round(hist, 6) AS historical_success_rate, bonus AS reproduction_bonus, on_device_passed,
  round(confidence_boost, 6) AS on_device_boost FROM sig""")
def j3(spark, sf):
    out = signals(spark, sf).select("candidate_id", *scoring.SIGNAL_WEIGHTS, "on_device_passed", "on_device_boost")
    return rounded(out, *scoring.SIGNAL_WEIGHTS, "on_device_boost")


@check("j3_shortcut_signals", f"""WITH {CAND_SQL} SELECT candidate_id, round(least(0.1 + retrieval_hits * 0.08, 0.9), 6)::double AS retrieval_similarity,
  0.7::double AS historical_success_rate FROM cands""")
def j3_shortcut(spark, sf):
    out = scoring.build_signals(candidates(spark, sf), validated(spark, sf), shortcut=True)
    return rounded(out.select("candidate_id", "retrieval_similarity", "historical_success_rate"), "retrieval_similarity")


def scored(spark, sf):
    return scoring.ensemble_score(signals(spark, sf), platt_a=6.0, platt_b=-3.0)


@check("j1_ensemble_score", f"WITH {SIGNAL_SQL} SELECT candidate_id, round(raw_score, 6) AS raw_score, round(calibrated_score, 6) AS calibrated_score, routing FROM ranked")
def j1(spark, sf):
    return rounded(scored(spark, sf).select("candidate_id", "raw_score", "calibrated_score", "routing"), "raw_score", "calibrated_score")


@check("j2_route_confidence", f"""WITH {CAND_SQL} SELECT candidate_id, CASE WHEN llm_confidence >= 0.85 THEN 'AUTO_PR' WHEN llm_confidence >= 0.65 THEN 'PR_WITH_REVIEW'
    WHEN llm_confidence >= 0.45 THEN 'ANALYSIS_ONLY' ELSE 'ESCALATE_HUMAN' END AS ensemble,
  CASE WHEN llm_confidence >= 0.85 THEN 'AUTO_PR' WHEN llm_confidence >= 0.60 THEN 'PR_WITH_REVIEW' WHEN llm_confidence >= 0.40 THEN 'ANALYSIS_ONLY'
    ELSE 'ESCALATE_HUMAN' END AS generator FROM cands""")
def j2(spark, sf):
    return candidates(spark, sf).select("candidate_id", scoring.route_confidence("llm_confidence").alias("ensemble"),
                                        scoring.route_confidence("llm_confidence", "generator").alias("generator"))


@check("j4_rank_candidates", f"WITH {SIGNAL_SQL} SELECT ticket_id, candidate_id, rank FROM ranked")
def j4(spark, sf):
    return scoring.rank_candidates(scored(spark, sf)).select("ticket_id", "candidate_id", F.col("rank").cast("bigint").alias("rank"))


@check("j5_fit_platt", f"""WITH RECURSIVE {SIGNAL_SQL}, h AS (SELECT raw_score AS x, (o_orderstatus = 'F')::int AS y FROM scored JOIN orders ON o_orderkey = candidate_id),
  nw AS (SELECT 0 AS i, 0.0::double AS a, ln(m / (1 - m)) AS b FROM (SELECT avg(y) AS m FROM h)
    UNION ALL SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
    FROM (SELECT i, a, b, sum((p - y) * x) AS ga, sum(p - y) AS gb, sum(p * (1 - p) * x * x) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb
      FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a * x + b))) AS p FROM nw, h WHERE i < 12) GROUP BY i, a, b))
  SELECT round(a, 4) AS platt_a, round(b, 4) AS platt_b, (SELECT count(*) FROM h) AS sample_count FROM nw WHERE i = 12""")
def j5(spark, sf):
    history = scored(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id"), "o_orderstatus"), "candidate_id")
    return rounded(scoring.fit_platt(history.withColumn("success", F.col("o_orderstatus") == "F")), "platt_a", "platt_b", digits=4)


@check("j6_chipset_penalty", """WITH r AS (SELECT l_orderkey AS candidate_id, CASE l_returnflag WHEN 'A' THEN 'MTK_LEGACY' ELSE 'MTK_CURRENT' END AS chipset,
    max(l_quantity) < 40 AS passed FROM lineitem GROUP BY ALL),
  s AS (SELECT candidate_id, bool_or(CASE WHEN chipset = 'MTK_LEGACY' THEN passed END) AS l, bool_or(CASE WHEN chipset = 'MTK_CURRENT' THEN passed END) AS c FROM r GROUP BY ALL)
  SELECT candidate_id, chipset, passed, CASE WHEN chipset = 'MTK_CURRENT' AND l AND NOT c THEN -0.15 ELSE 0 END::double AS confidence_delta FROM r JOIN s USING (candidate_id)""")
def j6(spark, sf):
    results = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("candidate_id"),
        F.when(F.col("l_returnflag") == "A", "MTK_LEGACY").otherwise("MTK_CURRENT").alias("chipset")
    ).agg((F.max("l_quantity") < 40).alias("passed"))
    return scoring.chipset_penalty(results)


_CALLS = """SELECT conv_id, CASE conv_id % 2 WHEN 0 THEN 'small' ELSE 'large' END AS model,
  cast(CASE WHEN role = 'assistant' THEN 0 ELSE floor(length(text) / 4) END AS bigint) AS input_tokens,
  cast(CASE WHEN role = 'assistant' THEN floor(length(text) / 4) ELSE 0 END AS bigint) AS output_tokens FROM {c}"""


@check("e18_usage_cost", f"""SELECT model, sum(input_tokens)::bigint AS total_input_tokens, sum(output_tokens)::bigint AS total_output_tokens,
  round(sum(input_tokens / 1000 * CASE model WHEN 'small' THEN 0.00025 ELSE 0.015 END + output_tokens / 1000 * CASE model WHEN 'small' THEN 0.00125 ELSE 0.075 END), 6)::double AS total_cost
  FROM ({_CALLS.format(c='conversations')}) GROUP BY model""")
def e18(spark, sf):
    calls = spark.sql(_CALLS.format(c="{c}"), c=table(spark, sf, "conversations"))
    return rounded(scoring.usage_cost(calls, {"small": (0.00025, 0.00125), "large": (0.015, 0.075)}, ["model"]), "total_cost")


_SPLIT = "2024-01-16"
BA_SQL = f"""la AS (SELECT log_id AS id, regexp_replace(line, '[0-9]+', '0', 'g') AS line, us >= epoch_us(TIMESTAMP '{_SPLIT}') AS late, log_id FROM lines),
er AS (SELECT DISTINCT id, line, late FROM la WHERE contains(line, 'ERROR') OR contains(line, 'FATAL') OR contains(line, 'CRASH')),
fresh AS (SELECT id, line FROM er WHERE late EXCEPT SELECT id, line FROM er WHERE NOT late)"""


def _before_after(spark, sf):
    lines = event_lines(spark, sf).withColumn("line", F.regexp_replace("line", "[0-9]+", "0"))
    lines = lines.select(F.col("log_id").alias("id"), "line", "us", F.lit("KEYDOWN_NOT_FIRED").alias("error_category"))
    late = F.col("us") >= F.unix_micros(F.lit(_SPLIT + " 00:00:00 UTC").cast("timestamp"))
    return lines.where(~late), lines.where(late)


@check("d11_new_errors", f"WITH {LINES_SQL}, {BA_SQL} SELECT id, line FROM fresh")
def d11(spark, sf):
    return scoring.new_errors(*_before_after(spark, sf))


@check("e23_before_after_verdict", f"""WITH {LINES_SQL}, {BA_SQL}, n AS (SELECT id, count(*) AS n FROM fresh GROUP BY id),
  t AS (SELECT id, bool_or(contains(lower(line), 'keydown') OR contains(lower(line), 'not dispatched')) AS target FROM la WHERE late GROUP BY id)
  SELECT id, coalesce(n, 0) AS new_error_count, target AS target_present, coalesce(n, 0) = 0 AND NOT target AS passed,
    concat_ws('; ', CASE WHEN n > 0 THEN 'New errors introduced: ' || n END, CASE WHEN target THEN 'Target error still present after fix' END) AS reasons
  FROM t LEFT JOIN n USING (id)""")
def e23(spark, sf):
    out = scoring.before_after_verdict(*_before_after(spark, sf))
    return out.withColumn("reasons", F.array_join("reasons", "; "))


@check("m3_score_candidates", f"""WITH {SIGNAL_SQL} SELECT ticket_id, candidate_id, overall_passed, round(raw_score, 6) AS raw_score,
  round(calibrated_score, 6) AS calibrated_score, routing, rank FROM ranked""")
def m3(spark, sf):
    from faultline.plans.score import score_candidates

    repro = table(spark, sf, "customer").select(F.col("c_custkey").alias("ticket_id"), (F.col("c_acctbal") > 5000).alias("reproducible"))
    out = score_candidates(candidates(spark, sf), runs(spark, sf), repro, rates(spark, sf), platt_a=6.0, platt_b=-3.0)
    return rounded(out.select("ticket_id", "candidate_id", "overall_passed", "raw_score", "calibrated_score", "routing",
                              F.col("rank").cast("bigint").alias("rank")), "raw_score", "calibrated_score")
