"""Subtree totals of a forest by parallel tree contraction.

Every round rakes and compresses.  Rake: all leaves go, their values are added to their parents.  Compress: a node with one child left goes when
its turn comes before that of its parent and its child; the child then hangs on the node's parent.  The turn of a node is its depth with the
bits read backwards: along a chain of consecutive depths every second node goes in a round, and two neighbours never go together.  A chain of
n nodes takes log2(n) rounds, a bush one for each level.  The link to the child then holds what the compressed nodes had gathered, and hands it
on with the child's values.  Afterwards the compressed nodes return, the last ones first: the total of a node is what it had gathered when it
went, what its link to its one child held, and the total of that child.

Each round is written as a table in the shared folder.  Nodes are joined by their own key only, which is unique, so no join has a hot key; a node
with very many children meets them as partial sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import written


def _turn(depth: Column) -> Column:
    """Odd depths before even ones, of the even ones those whose half is odd, and so on; different for all nodes of a path."""
    return F.reverse(F.lpad(F.bin(depth), 63, "0"))


def subtree_totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """``node`` and, per name of ``values``, the sum over the node and all below it.

    ``tree`` is ``(node, parent, depth, *values)`` with one row per node: ``parent`` is null for a root and else the ``node`` of a row whose
    ``depth`` is less.  Values are integers; a null one counts as 0.  An empty tree has no totals.
    """
    values = list(values)
    kids = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("_kids"))
    above = F.when(F.col("parent").isNotNull(), F.col("depth") - 1)
    none = [F.lit(0).cast("bigint").alias(f"link_{v}") for v in values]
    state = tree.select("node", "parent", "depth", above.alias("above"), *[F.coalesce(v, F.lit(0)).cast("bigint").alias(v) for v in values], *none)
    state = state.join(kids.withColumnRenamed("parent", "node"), "node", "left").withColumn("kids", F.coalesce("_kids", F.lit(0).cast("bigint"))).drop("_kids")
    state, rounds = written(state, "tree"), []
    while True:
        step = written(_round(state, values), "tree")
        left, gone = step.agg(F.count("*"), F.count_if("gone")).first()
        rounds.append((state.where("kids = 0").select("node", *values), step.where("gone").select("node", "child", *[(F.col(v) + F.col(f"below_{v}")).alias(v) for v in values]), gone))
        if not left:
            break
        state = step.where("NOT gone").drop("child", "gone", *[f"below_{v}" for v in values])

    known: list[DataFrame] = []
    for raked, spliced, gone in reversed(rounds):
        if gone:
            of_child = reduce(DataFrame.unionByName, known).select(F.col("node").alias("child"), *[F.col(v).alias(f"_{v}") for v in values])
            back = spliced.join(of_child, "child").select("node", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
            known.append(written(back, "tree"))
        known.append(raked)
    return reduce(DataFrame.unionByName, known)


def _round(state: DataFrame, values: list[str]) -> DataFrame:
    """The nodes that are no leaves, with the values of their leaves added; ``gone`` marks those compressed, ``child`` is the one child left.

    ``link_*`` is what the link to the parent holds, ``below_*`` what the link to ``child`` holds.
    """
    stays, links = F.col("kids") > 0, [f"link_{v}" for v in values]
    below = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count_if(stays).alias("_kids"), F.max(F.when(stays, F.struct("depth", "node", *links))).alias("_child"),
        *[F.sum(F.when(~stays, F.col(v) + F.col(f"link_{v}"))).alias(f"_{v}") for v in values])
    rows = state.where(stays).join(below, "node").select(
        "node", "parent", "depth", "above", F.col("_kids").alias("kids"), *links, *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values],
        F.when(F.col("_kids") == 1, F.col("_child")).alias("_child"))
    first = (_turn(F.col("depth")) > _turn(F.col("above"))) & (_turn(F.col("depth")) > _turn(F.col("_child.depth")))
    rows = rows.withColumns({"gone": F.coalesce(F.col("parent").isNotNull() & first, F.lit(False)), "child": F.col("_child.node"),
                             **{f"below_{v}": F.col(f"_child.link_{v}") for v in values}}).drop("_child")
    moved = rows.where("gone").select(F.col("child").alias("node"), F.struct("parent", "above", *[(F.col(v) + F.col(f"link_{v}")).alias(v) for v in values]).alias("_up"))
    rows = rows.join(moved, "node", "left").withColumns({
        "parent": F.coalesce("_up.parent", "parent"), "above": F.coalesce("_up.above", "above"),
        **{f"link_{v}": F.col(f"link_{v}") + F.coalesce(f"_up.{v}", F.lit(0)) for v in values}})
    return rows.drop("_up")
