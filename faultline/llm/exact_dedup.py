"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the full text.

Each step reads the documents anew, and hashes only rows whose group of the step before has more than one row.  Which rows those are is
told by a bitmap of fixed size, so no text is ever shuffled; a row that is marked without need is hashed in vain and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import lower_ascii, written
from faultline.llm.marks import bitmap_of, marked, row_key, surplus, without

PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence = ()) -> DataFrame:
    """One row per document: ``id_col``, the ``carry`` columns, ``keep_id``, ``group_size``, ``kept``, ``copies`` (names its group; null: alone).

    Texts are equal when identical after A-Z became a-z; a null text counts as empty.  Of equal texts the row with the largest id is kept.
    A row of a null id loses against every other; if all ids of a group are null, ``keep_id`` is null and its rows are kept.  Rows that
    repeat an id and its text are one document: each counts in ``group_size``, and they are kept or dropped together.  ``carry`` holds
    column names or expressions over the documents; other columns are ignored, so their names don't matter.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_n"), F.struct(F.lit(0).alias("_none"), *carry).alias("_carry"))
    by_length, by_prefix = F.xxhash64("_n"), F.xxhash64("_n", "_prefix")

    lengths = base.groupBy("_n").agg(F.count("*").alias("_rows")).where("_rows > 1")
    first = marked(base, bitmap_of(lengths, by_length), by_length, "_m1")
    first = first.withColumn("_prefix", F.when(F.col("_m1"), F.xxhash64(lower_ascii(F.substring("_text", 1, PREFIX_CHARS)))))

    prefixes = first.where("_m1").groupBy("_n", "_prefix").agg(F.count("*").alias("_rows")).where("_rows > 1")
    second = marked(first, bitmap_of(prefixes, by_prefix), by_prefix, "_m2")
    full = F.when(F.col("_m1") & F.col("_m2"), F.unhex(F.sha2(lower_ascii(F.col("_text")), 256)))
    rows = written(second.select("_id", "_carry", full.alias("_full")), "exact-dedup")

    same = rows.where("_full IS NOT NULL")
    groups = same.groupBy("_full").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Joined by a second expression of the key too: both sides are exchanged, and adaptive execution can split a large group.
    left, right = same.withColumn("_key", F.xxhash64("_full")), groups.withColumn("_key", F.xxhash64("_full"))
    found = left.join(right, ["_key", "_full"]).select("_id", "_carry", "keep_id", "group_size", F.col("_full").alias("copies"))
    alone = rows.where("_full IS NULL").select("_id", "_carry", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(None).cast("binary").alias("copies"))
    out = found.unionByName(alone)
    kept = F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select(F.col("_id").alias(id_col), "_carry.*", "keep_id", "group_size", kept, "copies").drop("_none")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts, with all its columns: the one of the largest id.

    A null id loses against every other; where rows share the id, or none has one, the hash of the text decides, and of rows that repeat
    both id and text one stays.
    """
    groups = exact_groups(docs, id_col, text_col, carry=[row_key(id_col, text_col).alias("_row")])
    gone, once = surplus(groups.where("copies IS NOT NULL").select("copies", "_row"), "copies", largest=True)
    return without(docs, written(gone, "exact-copies"), id_col, text_col, written(once, "exact-repeats"))
