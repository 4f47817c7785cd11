"""Ordered scans in blocks equal plain scans, also where one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import segmented as seg


def _rows(spark, n=400):
    rng = random.Random(1)
    data = []
    for i in range(n):
        key = "hot" if i % 3 else None if i % 5 == 0 else f"k{i % 7}"
        data.append((key, i, rng.choice([None, rng.randint(0, 99)])))
    return spark.createDataFrame(data, "k string, i long, v long")


def test_blocked_scans_equal_plain_windows(spark):
    df = _rows(spark)
    block = seg.row_block("i", 17)
    w = Window.partitionBy("k").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    got = seg.carry_last(df, ["k"], "i", {"last": F.col("v")}, block)
    got = seg.running_sum(got, ["k"], "i", F.coalesce("v", F.lit(0)), "total", block)
    got = seg.running_max(got, ["k"], "i", F.col("v"), "top", block)
    got = seg.number_rows(got, ["k"], "i", "n", block)
    got = seg.previous(got, ["k"], "i", {"before": F.col("v")}, block).drop("has_previous")
    want = df.withColumns({
        "last": F.last("v", ignorenulls=True).over(upto), "total": F.sum(F.coalesce("v", F.lit(0))).over(upto),
        "top": F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), "n": F.row_number().over(w).cast("long"),
        "before": F.lag("v").over(w)})
    columns = sorted(want.columns)
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))


def test_keyed_join_is_a_null_safe_join(spark):
    df = _rows(spark)
    small = df.groupBy("k").agg(F.max("i").alias("m"))
    got = seg.keyed_join(df, small, ["k"]).select("k", "i", "v", "m")
    want = df.join(small.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k"))).select("k", "i", "v", "m")
    assert got.count() == df.count()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
