"""The prefix trie of conversations: every distinct sequence of first turns is a node.

A turn is known by 128 bits of hash of its place, role and text, a prefix by the exclusive or of its turns, which is a running value over
the turns and needs no text; long conversations are read in blocks of places.  Sums over subtrees come from :mod:`tree_contraction`.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.tree_contraction import subtree_totals
from faultline.operators import segmented as seg

#: Places of a conversation that one task reads in order.
BLOCK_TURNS = 4096
#: Consecutive conversation ids whose text is one row on the way to a digest: 2 to this power.
ID_BITS = 10
SPACE = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, place, t1, t2, words``: the turns of each conversation, numbered from 1, without their texts.

    Turns are ordered by ``turn_col``, null first; equal ones by role, then by the MD5 of the text, and rows that repeat are turns of their own.
    A null role or text is empty.  Rows without a conversation id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), role, text).alias("t2"), F.regexp_count(text, F.lit(SPACE)).cast("bigint").alias("words"))
    rows = seg.number_rows(rows, ["conv"], [F.asc_nulls_first("turn"), "role", "digest"], "place", seg.row_block("turn", BLOCK_TURNS))
    return rows.select("conv", "place", "t1", "t2", "words")


def prefixes(turns: DataFrame) -> DataFrame:
    """Of every turn: ``conv, depth``, the key ``k1, k2`` of the prefix that it ends, the key ``p1, p2`` of the prefix before it, ``words``."""
    rows = turns.select("conv", "place", "words", F.xxhash64("place", "t1", "t2").alias("x1"), F.xxhash64(F.lit(2), "place", "t2", "t1").alias("x2"))
    rows = rows.withColumn("block", F.shiftright(F.col("place") - 1, 12))
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    blocks = blocks.select("conv", "block", F.bit_xor("b1").over(before).alias("b1"), F.bit_xor("b2").over(before).alias("b2")).where("block > 0")
    rows = rows.withColumns({"k1": F.bit_xor("x1").over(inside), "k2": F.bit_xor("x2").over(inside)}).join(blocks, ["conv", "block"], "left")
    none = F.lit(0).cast("bigint")
    rows = rows.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(b, none)) for k, b in (("k1", "b1"), ("k2", "b2"))})
    return rows.select("conv", F.col("place").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words")


def conversation_trie(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the node that each conversation ends at.

    ``turns`` is as :func:`ordered_turns` gives them (places from 1 without gaps), ``members`` has a row ``conv`` for each conversation, also
    those without turns, which end at the root.  Nodes: ``depth`` (0: the root), ``conv_id`` (the smallest member; with the depth it names the
    node), ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in the subtree) and
    ``saved_tokens`` (over the subtree, the words of a node's last turn times its members but one).  Ends: ``depth, conv_id, member``.
    Without members there is no node.
    """
    path = written(prefixes(turns), "prefixes")
    none = F.lit(0).cast("bigint")
    nodes = path.groupBy("depth", "k1", "k2").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(none.alias("depth"), none.alias("k1"), none.alias("k2"), "n_convs", "conv_id", none.alias("words"), none.alias("p1"), none.alias("p2")))
    nodes = written(nodes, "trie")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(parents, ["depth", "p1", "p2"], "left").select("depth", "conv_id", "parent_conv_id", "n_convs", "words")
    linked = written(linked, "trie")

    node = F.struct("depth", "conv_id")
    parent = F.struct((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id"))
    parent = F.when(F.col("parent_conv_id").isNotNull(), parent)
    kids = linked.where(parent.isNotNull()).groupBy(parent.alias("node")).agg(F.count("*").alias("n_children"))
    full = linked.withColumns({"node": node, "parent": parent}).join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", none))
    full = written(full, "trie")
    tree = full.select("node", "parent", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    out = full.join(subtree_totals(tree, ["n_leaves", "saved_tokens"]), "node")

    last = path.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("_last"))
    ends = members.select("conv").join(last, "conv", "left")
    ends = ends.select(F.col("conv").alias("member"), *[F.coalesce(f"_last.{c}", none).alias(c) for c in ("depth", "k1", "k2")])
    ends = ends.join(nodes.select("depth", "k1", "k2", "conv_id"), ["depth", "k1", "k2"]).select("depth", "conv_id", "member")
    return out.select("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def _digests(batches):
    """Of each node its ids' digest; rows come ordered by node and id block, so only one digest is open."""
    key, state = None, None
    for batch in batches:
        done = []
        for depth, conv, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if key != (depth, conv):
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (depth, conv), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["depth", "conv_id", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["depth", "conv_id", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """``depth, conv_id, ends_sha256``: SHA-256 of the decimal ids that end at a node, ascending, with commas between them.

    Ids are put together by blocks of 1024 consecutive ones, so no row grows with a node's members; a digest is made by reading these rows
    in order, the one step that the function itself doesn't allow to be split.
    """
    rows = ends.groupBy("depth", "conv_id", F.shiftright("member", ID_BITS).alias("block")).agg(F.sort_array(F.collect_list("member")).alias("ids"))
    rows = rows.select("depth", "conv_id", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))
    rows = rows.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "block")
    return map_batches(rows, _digests, "depth bigint, conv_id bigint, ends_sha256 string")


def with_shared_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, as ``(turns, members)``.

    Each conversation c takes the first h turns of conversation ``c - c % every`` (all if it has fewer, none if there is no such one), then its
    own turns after its first h; h is the CRC-32 of the decimal c modulo ``heads``.
    """
    def share(c):
        return F.crc32(F.col(c).cast("string").cast("binary")) % heads

    first = turns.where((F.col("conv") % every == 0) & (F.col("place") < heads))
    first = first.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("head"))
    members = turns.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", F.col("conv") - F.col("conv") % every)
    members = members.join(first.withColumnRenamed("conv", "base"), "base", "left")
    empty = F.array().cast("array<struct<place:bigint,t1:bigint,t2:bigint,words:bigint>>")
    members = written(members.select("conv", F.filter(F.coalesce("head", empty), lambda x: x["place"] <= share("conv")).alias("head")), "members")
    copied = members.select("conv", F.explode("head").alias("x")).select("conv", "x.*")
    own = turns.where(F.col("place") > share("conv")).join(members.select("conv", F.size("head").alias("m")), "conv")
    own = own.select("conv", (F.col("place") - share("conv") + F.col("m")).alias("place"), "t1", "t2", "words")
    return copied.unionByName(own), members.select("conv")
