"""Shorten long texts without losing protected lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import strip
from faultline.rules import formats

LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
ACTIVATION_TOKENS = 150_000
CODE_LINES = 50
REPEATED = "  [... repeated ...]"
TRUNCATED = "  // ... [truncated] ..."


def _tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("bigint")


def compress_text(df: DataFrame, id: str = "doc_id", text: str = "text", ratio: float = 0.5,
                  activation: int = ACTIVATION_TOKENS) -> DataFrame:
    """Texts of at least ``activation`` tokens, shortened to about ``ratio`` of their lines.

    Blank lines go, repeats collapse, fenced code is cut after 50 lines; then protected
    lines come first, followed by as many other lines as the budget allows.  All scans run
    inside one text, so one shuffle by text serves them all.
    """
    small = _tokens(F.col(text)) < activation
    same = df.where(small).select(
        id, F.col(text).alias("text"), _tokens(F.col(text)).alias("original_tokens"),
        _tokens(F.col(text)).alias("compressed_tokens"), F.lit(1.0).alias("ratio"), F.lit("none").alias("method"))

    lines = df.where(~small).select(id, _tokens(F.col(text)).alias("original_tokens"),
                                    F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("pos", "line"))
    sizes = df.where(~small).select(id, _tokens(F.col(text)).alias("original_tokens"))
    lines = lines.withColumn("bare", strip(F.col("line"))).where("bare <> ''")
    seq = Window.partitionBy(id).orderBy("pos")
    before = seq.rowsBetween(Window.unboundedPreceding, 0)
    is_protected = F.col("line").rlike(formats.PROTECTED)
    # Equal to the line before: the first such line becomes a marker, the rest go.
    lines = lines.withColumn("repeat", F.coalesce(
        (F.col("line") == F.lag("line").over(seq)) & ~is_protected, F.lit(False)))
    lines = lines.withColumn("again", F.col("repeat") & F.lag("repeat", 1, False).over(seq))
    lines = lines.where("NOT again").withColumn(
        "line", F.when(F.col("repeat"), F.lit(REPEATED)).otherwise(F.col("line")))
    fence = ~F.col("repeat") & F.col("bare").startswith("```")
    lines = lines.withColumns({"fence": fence, "block": F.sum(fence.cast("int")).over(before)})
    inside = Window.partitionBy(id, "block").orderBy("pos")
    depth = F.row_number().over(inside) - 1
    lines = lines.withColumn("depth", F.when(~F.col("fence") & (F.col("block") % 2 == 1), depth))
    lines = lines.where(F.col("depth").isNull() | (F.col("depth") <= CODE_LINES + 1)).withColumn(
        "line", F.when(F.col("depth") == CODE_LINES + 1, F.lit(TRUNCATED)).otherwise(F.col("line")))
    lines = lines.withColumn("kind", F.when(F.col("line").rlike(formats.PROTECTED), 0)
                             .when(F.col("line").rlike(formats.LOW_SIGNAL), 2).otherwise(1))
    whole = Window.partitionBy(id)
    per_kind = Window.partitionBy(id, "kind").orderBy("pos")
    lines = lines.withColumns({
        "n": F.count("*").over(whole), "n_protected": F.count_if(F.col("kind") == 0).over(whole),
        "place": F.row_number().over(per_kind)})
    target = F.floor(F.col("n") * ratio)
    kept = (F.col("kind") == 0) | ((F.col("kind") == 1) & (F.col("place") <= target - F.col("n_protected")))
    lines = lines.where((F.col("n") <= target) | kept)
    joined = lines.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "line"))).alias("l"))
    out = sizes.join(joined, id, "left").select(
        id, "original_tokens", F.coalesce(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("")).alias("text"))
    out = out.select(id, "text", "original_tokens", _tokens(F.col("text")).alias("compressed_tokens"),
                     (_tokens(F.col("text")) / F.greatest("original_tokens", F.lit(1))).alias("ratio"),
                     F.lit("heuristic").alias("method"))
    return same.unionByName(out)
