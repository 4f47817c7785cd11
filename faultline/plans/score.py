"""Score and rank the fix candidates of all tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from faultline.operators import scoring


def score_candidates(candidates: DataFrame, runs: DataFrame, reproduction: DataFrame, rates: DataFrame,
                     platt_a: float = 1.0, platt_b: float = 0.0) -> DataFrame:
    """Validation results, signals, ensemble score, routing and rank per candidate."""
    validation = scoring.validation_score(runs, candidates)
    signals = scoring.build_signals(candidates, validation, reproduction, rates)
    signals = signals.join(validation.select("candidate_id", "overall_passed"), "candidate_id")
    return scoring.rank_candidates(scoring.ensemble_score(signals, platt_a, platt_b))
