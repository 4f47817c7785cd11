"""Streams over files in several batches; parity with batch results is checked in test_oracle."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline import streaming
from faultline.operators import telemetry
from faultline.streaming.regressions import regression_sink

SCHEMA = "ts timestamp, user_id long, app string, chipset string, error_category string"


def test_regressions_over_batches_report_each_change_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h, minutes=m), h % 9, "netflix", "c", "X") for h in range(200) for m in ((5, 20, 40) if h < 172 else (1, 5, 9, 20, 30, 40, 50))]
    rows += [(start + timedelta(hours=h, minutes=1), 1, "netflix", "c", "X") for h in range(200, 260)]
    days = spark.createDataFrame(rows, SCHEMA)
    changes = spark.createDataFrame([(1, "T", start + timedelta(hours=168), "X", "netflix", None), (2, "T", start + timedelta(hours=168), "Y", None, None)],
                                    "change_id long, ticket_id string, merged_at timestamp, error_category string, app string, chipset string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sink = regression_sink(lambda: changes, f"{out}/events", f"{out}/alerts")
    bounds = [0, 170, 190, 260]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = days.where((F.col("ts") >= F.lit(start + timedelta(hours=lo))) & (F.col("ts") < F.lit(start + timedelta(hours=hi))))
        part.coalesce(1).write.mode("append").parquet(source)
        query = (spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(sink)
                 .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
        query.awaitTermination()
    got = spark.read.parquet(f"{out}/alerts").collect()
    want = telemetry.regressions(changes, days).collect()
    assert [(r.change_id, r.hours_after_merge) for r in got] == [(r.change_id, r.hours_after_merge) for r in want] == [(1, 5)]


def test_regressions_of_a_replay_and_after_a_long_pause(spark, tmp_path):
    """One batch of a whole month, then ten days without any, then a batch that completes watches of before."""
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h, minutes=m), (h * 7 + m) % 11, "netflix", "c", "X") for h in range(700) for m in ((5, 20, 40) if h % 170 < 150 else (1, 5, 9, 20, 30, 40, 50))]
    rows += [(start + timedelta(hours=h, minutes=m), m, "netflix", "c", "X") for h in range(960, 1100) for m in range(0, 60, 5)]
    days = spark.createDataFrame(rows, SCHEMA)
    merges = [(i, "T", start + timedelta(hours=h), "X", "netflix" if i % 2 else None, None) for i, h in enumerate([100, 170, 320, 420, 640, 660, 690, 699, 900])]
    changes = spark.createDataFrame(merges, "change_id long, ticket_id string, merged_at timestamp, error_category string, app string, chipset string")
    out = str(tmp_path / "out")
    sink = regression_sink(lambda: changes, f"{out}/events", f"{out}/alerts")
    for number, (lo, hi) in enumerate([(0, 700), (960, 1000), (1000, 1100)]):
        sink(days.where((F.col("ts") >= F.lit(start + timedelta(hours=lo))) & (F.col("ts") < F.lit(start + timedelta(hours=hi)))), number)
    got = {r.change_id: (r.hours_after_merge, r.affected_users) for r in spark.read.parquet(f"{out}/alerts").collect()}
    newest = max(r[0] for r in rows)
    want = {r.change_id: (r.hours_after_merge, r.affected_users) for r in telemetry.regressions(changes, days).collect() if r.merged_at + timedelta(hours=r.hours_after_merge) <= newest}
    assert got == want and len(want) >= 5


def test_novel_templates_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (["open 1234", "open 5678", "close"], ["open 9999", "shut"]):
        spark.createDataFrame([("a", x) for x in batch], "log_id string, line string").coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema("log_id string, line string").parquet(source)
        (streaming.novel_templates(lines).writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/s")
         .trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.template for r in spark.read.parquet(f"{out}/t").collect()) == ["close", "open <NUM>", "shut"]
