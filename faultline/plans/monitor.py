"""Watch production: spikes now, regressions after changes, and the records they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import telemetry
from faultline.session import materialized
from faultline.sources.records import upsert_records


def monitor(events: DataFrame, changes: DataFrame, as_of: Column | str, stored: DataFrame | None = None, **thresholds) -> tuple[DataFrame, DataFrame]:
    """Alerts of both kinds, and the correction records: those ``stored`` with the ones of the regressions put in by id."""
    spikes = telemetry.proactive_spikes(events, as_of, **thresholds)
    found = materialized(telemetry.regressions(changes, events), "regressions")
    columns = ["dimension", "value", "change_id", "spike_factor", "current_rate", "baseline_rate", "affected_users"]
    spikes = spikes.withColumn("change_id", F.lit(None).cast(changes.schema["change_id"].dataType))
    alerts = spikes.select(F.lit("spike").alias("kind"), *columns).unionByName(
        found.select(F.lit("regression").alias("kind"), *columns))
    corrections = telemetry.regression_corrections(found)
    return alerts, corrections if stored is None else upsert_records(stored, corrections, "correction_id", "created_at")
