"""Ordered scans over keys that may hold a third of all rows.

A window ordered over one hot key would run in one task.  These helpers cut each
key into blocks of its order column, run the window inside ``(key, block)``, and
bring in what earlier blocks contribute from a table with one row per block.
That table is built by a map-side-combined aggregate and is smaller than the
input by the block size, so the window over it stays small.

Keys may be null: rows of a null key are one key.  A block must be a non-decreasing function of the order; rows without one come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
KEYS = "_keys"
BLOCK_ROWS = 100_000


def row_block(order: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a row-count-like order column."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(rows)).cast("bigint")


def _keyed(df: DataFrame, keys) -> DataFrame:
    """Add the keys as one column that is never null: equal in joins where the keys are equal or both null."""
    return df.withColumn(KEYS, F.struct(F.lit(0).alias("_"), *keys))


def placed(df: DataFrame, keys, block: Column) -> DataFrame:
    return _keyed(df, keys).withColumn(BLOCK, F.coalesce(block.cast("bigint"), F.lit(-(1 << 62))))


def inside(order):
    return Window.partitionBy(KEYS, BLOCK).orderBy(*order)


def before():
    """Earlier blocks of the same key, over the block table."""
    return Window.partitionBy(KEYS).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _as_list(order):
    return [order] if isinstance(order, (str, Column)) else list(order)


def carry_last(df: DataFrame, keys, order, values: dict[str, Column], block: Column) -> DataFrame:
    """Add, per output name, the last non-null value at or before each row of its key."""
    order = _as_list(order)
    rows = placed(df, keys, block).withColumns({f"_v_{n}": v for n, v in values.items()})
    sort_key = F.struct(*order)
    tails = rows.groupBy(KEYS, BLOCK).agg(*[
        F.max_by(F.struct(F.col(f"_v_{n}").alias("v")),
                 F.when(F.col(f"_v_{n}").isNotNull(), sort_key))["v"].alias(f"_t_{n}")
        for n in values])
    tails = tails.select(KEYS, BLOCK, *[
        F.last(f"_t_{n}", ignorenulls=True).over(before()).alias(f"_c_{n}") for n in values])
    out = rows.withColumns({
        f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(
            inside(order).rowsBetween(Window.unboundedPreceding, 0)) for n in values})
    out = out.join(tails, [KEYS, BLOCK])
    out = out.withColumns({n: F.coalesce(f"_i_{n}", f"_c_{n}") for n in values})
    scratch = [f"_{p}_{n}" for n in values for p in "vic"]
    return out.drop(KEYS, BLOCK, *scratch)


def running_sums(df: DataFrame, keys, order, values: dict[str, Column], block: Column) -> DataFrame:
    """Add, per output name, the inclusive running sum of a value per key; null values count as nothing."""
    order = _as_list(order)
    rows = placed(df, keys, block).withColumns({f"_v_{n}": v for n, v in values.items()})
    sums = rows.groupBy(KEYS, BLOCK).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    sums = sums.select(KEYS, BLOCK, *[F.coalesce(F.sum(f"_s_{n}").over(before()), F.lit(0)).alias(f"_c_{n}") for n in values])
    upto = inside(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(upto), F.lit(0)) for n in values})
    rows = rows.join(sums, [KEYS, BLOCK]).withColumns({n: F.col(f"_i_{n}") + F.col(f"_c_{n}") for n in values})
    return rows.drop(KEYS, BLOCK, *[f"_{p}_{n}" for n in values for p in "vic"])


def running_sum(df: DataFrame, keys, order, value: Column, out: str, block: Column) -> DataFrame:
    """Add the inclusive running sum of a value per key."""
    return running_sums(df, keys, order, {out: value}, block)


def running_max(df: DataFrame, keys, order, value: Column, out: str, block: Column) -> DataFrame:
    """Add the largest value of the rows before each row of its key (null on the first)."""
    order = _as_list(order)
    rows = placed(df, keys, block).withColumn("_seg_v", value)
    tops = rows.groupBy(KEYS, BLOCK).agg(F.max("_seg_v").alias("_seg_m"))
    tops = tops.select(KEYS, BLOCK, F.max("_seg_m").over(before()).alias("_seg_c"))
    rows = rows.withColumn("_seg_i", F.max("_seg_v").over(inside(order).rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(tops, [KEYS, BLOCK]).withColumn(out, F.greatest("_seg_i", "_seg_c")).drop(KEYS, BLOCK, "_seg_v", "_seg_i", "_seg_c")


def number_rows(df: DataFrame, keys, order, out: str, block: Column) -> DataFrame:
    """Add consecutive row numbers from 1 per key."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, block)


def previous(df: DataFrame, keys, order, values: dict[str, Column], block: Column) -> DataFrame:
    """Add, per output name, the value of the preceding row of the key (null on the first).

    ``has_previous`` tells a missing row from a null value.
    """
    order = _as_list(order)
    rows = placed(df, keys, block).withColumn("_seg_p", F.struct(*[v.alias(n) for n, v in values.items()]))
    tails = rows.groupBy(KEYS, BLOCK).agg(F.max_by("_seg_p", F.struct(*order)).alias("_seg_t"))
    step = Window.partitionBy(KEYS).orderBy(BLOCK)
    tails = tails.select(KEYS, BLOCK, F.lag("_seg_t").over(step).alias("_seg_c"))
    rows = rows.withColumn("_seg_l", F.lag("_seg_p").over(inside(order)))
    rows = rows.join(tails, [KEYS, BLOCK]).withColumn("_seg_l", F.coalesce("_seg_l", "_seg_c"))
    rows = rows.withColumns({
        "has_previous": F.col("_seg_l").isNotNull(), **{n: F.col("_seg_l")[n] for n in values}})
    return rows.drop(KEYS, BLOCK, "_seg_p", "_seg_l", "_seg_c")


def keyed_join(big: DataFrame, small: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join rows to a one-row-per-key table; null keys meet each other.

    Both sides are exchanged by the key column, so adaptive execution sees their true sizes: it broadcasts a small table and splits a hot key.
    """
    right = _keyed(small, keys).drop(*keys)
    return _keyed(big, keys).join(right, KEYS, how).drop(KEYS)


def top_n(df: DataFrame, keys, order, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank; Spark prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_as_list(order))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
