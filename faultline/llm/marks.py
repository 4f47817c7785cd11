"""Bitmaps of fixed size that mark which keys a later step has to look at.

A bitmap of ``BITS`` bits has a proven size (8 MB), so it can be sent to every task.  A key whose bit is clear is surely absent; one whose bit
is set may be present.  With more keys than bits all bits fill up and the exact step behind merely sees more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bitmap_of(keys: DataFrame, key: Column) -> DataFrame:
    """At most BITS / 32768 rows ``(_bucket, _bits)`` with a bit for every key (a 64-bit integer)."""
    slot = F.pmod(key, F.lit(BITS)) + 1
    return keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))


def marked(df: DataFrame, bitmap: DataFrame, key: Column, out: str) -> DataFrame:
    """Add the boolean ``out``: whether the bit of the row's key is set."""
    slot = F.pmod(key, F.lit(BITS)) + 1
    place = F.bitmap_bit_position(slot)
    byte = F.ascii(F.decode(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    set_ = F.expr("_byte >> cast(_place % 8 as int)").bitwiseAND(1) == 1
    rows = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmap), "_bucket", "left")
    rows = rows.withColumns({"_byte": F.when(F.col("_bits").isNotNull(), byte).otherwise(0), "_place": place})
    return rows.withColumn(out, set_).drop("_bucket", "_bits", "_byte", "_place")


def row_key(id_col: str, text_col: str) -> Column:
    """What a decision about a document is kept by: its id, null or not, and 128 bits of hash of the text that the decision was made on."""
    return _key_of(F.col(id_col), F.col(text_col))


def _key_of(id_: Column, text: Column) -> Column:
    text = text.cast("string")
    return F.struct(id_.alias("id"), text.isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def surplus(rows: DataFrame, group: str, largest: bool) -> tuple[DataFrame, DataFrame]:
    """What has to go so that one row of each group stays: keys whose rows all go, and keys of which one of several rows stays.

    ``rows`` is ``(group, _row)`` with the :func:`row_key` of each document.  The row of the largest (or smallest) id stays, a null id loses,
    and among rows of one id the hash of the text decides.  Repeated rows are counted before they are exchanged.
    """
    keys = rows.groupBy(group, "_row").agg(F.count("*").alias("_rows"))
    best = F.max("_row") if largest else F.min_by("_row", F.struct(F.col("_row.id").isNull().alias("none"), F.col("_row").alias("row")))
    stays = keys.groupBy(group).agg(best.alias("_best"))
    # Joined by a second expression of the group too: both sides are exchanged, and adaptive execution can split a large group.
    again = F.xxhash64(F.col(group))
    both = keys.withColumn("_again", again).join(stays.withColumn("_again", again), [group, "_again"])
    both = both.select("_row", "_rows", F.col("_row").eqNullSafe(F.col("_best")).alias("_stays"))
    return both.where("NOT _stays").select("_row"), both.where("_stays AND _rows > 1").select("_row")


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose :func:`row_key` is the only column of ``gone``, and with one row only of each key in ``once``.

    Only rows that may have to go are shuffled.  Rows that share an id, or have none, go by their own text each.  The row travels as one
    struct, so columns may have any names.
    """
    columns = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("doc")).withColumn("key", _key_of(F.col("doc").getField(id_col), F.col("doc").getField(text_col)))
    listed = gone.toDF("key").withColumn("gone", F.lit(True))
    if once is not None:
        listed = listed.unionByName(once.toDF("key").withColumn("gone", F.lit(False)))
    rows = marked(rows, bitmap_of(listed, F.xxhash64("key")), F.xxhash64("key"), "maybe")
    stay = rows.where("NOT maybe").select("doc")
    maybe = rows.where("maybe").join(listed.withColumnRenamed("key", "listed"), F.col("key").eqNullSafe(F.col("listed")), "left")
    stay = stay.unionByName(maybe.where("gone IS NULL").select("doc"))
    if once is not None:
        # Of rows with one id and text the one with the least hash of all columns: equal rows, as far as the result can tell.
        single = maybe.where("NOT gone").groupBy("key").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
        stay = stay.unionByName(single.select("doc"))
    return stay.select("doc.*")
