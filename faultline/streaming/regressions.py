"""Regressions after changes, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.telemetry import BASELINE_HOURS, WATCH_HOURS, regressions


def _numbered(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """What earlier batches have written to a folder; none if it isn't there yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(folder).where(F.col("batch") < batch_id)


def regression_sink(changes: Callable[[], DataFrame], events_path: str, alerts_path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that reports each change's first regression once.

    A batch is stored under its number, so a repeated batch overwrites itself.  Then the batch operator runs over the open changes up to the
    last full hour seen.  A change is open until it has an alert or its whole watch had passed when an earlier batch was evaluated; so a
    replay, a backlog or a long pause loses nothing.  ``changes`` re-reads the change table; both paths are shared storage.  Next to the
    alerts a small table keeps the newest event time of every batch.
    """
    times_path = f"{alerts_path}-times"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = f"{events_path}/batch={batch_id}"
        batch.select("ts", "user_id", "app", "chipset", "error_category").withColumn("day", F.to_date("ts")).write.mode(
            "overwrite").partitionBy("day").parquet(stored)
        times = _numbered(spark, times_path, batch_id)
        before = times.agg(F.max("newest")).first()[0] if times is not None else None
        latest = batch.agg(F.max("ts")).first()[0]
        now = max((t for t in (before, latest) if t is not None), default=None)
        if now is None:
            return
        open_changes = changes().where(F.col("merged_at") <= F.lit(now))
        if before is not None:
            # Evaluated with its whole watch seen: it can't get an alert any more.
            open_changes = open_changes.where(F.col("merged_at") + F.make_interval(hours=F.lit(WATCH_HOURS)) > F.lit(before))
        done = _numbered(spark, alerts_path, batch_id)
        if done is not None:
            open_changes = open_changes.join(done.select("change_id").distinct(), "change_id", "left_anti")
        oldest = open_changes.agg(F.min("merged_at")).first()[0]
        if oldest is not None:
            # Partition pruning keeps the scan to the days that the oldest open change needs.
            needed = spark.read.parquet(events_path).where(F.col("day") >= F.to_date(F.lit(oldest) - F.expr(f"INTERVAL {BASELINE_HOURS} HOURS")))
            alerts = regressions(open_changes, needed)
            complete = F.col("merged_at") + F.make_interval(hours=F.col("hours_after_merge")) <= F.lit(now)
            alerts.where(complete).write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
        spark.createDataFrame([(now,)], "newest timestamp").write.mode("overwrite").parquet(f"{times_path}/batch={batch_id}")

    return process
