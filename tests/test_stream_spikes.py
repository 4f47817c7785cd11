"""Spikes of a stream: state holds combined slices, and rates and users are those of a count by hand."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline import streaming

SCHEMA = "ts timestamp, user_id long, app string"
START = datetime(2024, 1, 1)


def _run(spark, tmp_path, batches):
    """Rows of the sink and the rows that state was given."""
    baseline = spark.createDataFrame([("app", "netflix", 1.0)], "dimension string, value string, baseline_rate double")
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), 0
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        found = streaming.spikes(events, baseline, 0.0, 0, 0, monitored={"app": ["netflix"]})
        query = (found.writeStream.format("parquet").option("path", f"{out}/t").option("checkpointLocation", f"{out}/s").trigger(availableNow=True).start())
        query.awaitTermination()
        state += sum(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators)
    rows = spark.read.parquet(f"{out}/t").withColumn("e", F.unix_seconds("as_of")).collect()
    return {(r.e): (r.current_rate, r.affected_users) for r in rows}, state


def _by_hand(rows):
    rows, newest = [(int((t - START).total_seconds()), u, a) for t, u, a in rows], max(t for t, _, _ in rows)
    base, out = 1704067200, {}
    for e in range(0, int((newest - START).total_seconds()) - 600 + 1, 300):
        own = [u for t, u, a in rows if a == "netflix" and e - 3600 <= t < e]
        if own:
            out[base + e] = (len(own), len({u for u in own if u is not None}))
    return out


def test_spikes_over_batches_count_each_user_once_an_hour(spark, tmp_path):
    rows = [(START + timedelta(seconds=97 * i), [None, 1, 2, 3, 1, 2][i * i % 6], "netflix" if i % 3 else "other") for i in range(200)]
    rows += [rows[20], rows[20]]
    batches = [sorted(rows)[:90], sorted(rows)[90:]]
    got, _ = _run(spark, tmp_path, batches)
    assert got == _by_hand(rows) and len(got) > 50


def test_no_state_row_per_user_and_window(spark, tmp_path):
    """1,000 users of one slice: they were 12,000 state rows."""
    rows = [(START + timedelta(milliseconds=250 * i), i, "netflix") for i in range(1000)] + [(START + timedelta(hours=3), 1, "netflix")]
    got, state = _run(spark, tmp_path, [rows])
    assert got == _by_hand(rows)
    assert state < 1000
