"""Similarity join on word shingles with adaptive multi-match prefixes.

Shingles are put in one global order, rare ones first.  Two sets of Jaccard similarity t share l shingles or more among the first
``n - ceil(t n) + l`` of each, for every l.  A document whose prefix holds frequent shingles lengthens it, l chosen by the estimated cost of its
candidates, and then has to share l of them; a pair is verified on its whole sets only after that.

* Documents of equal sets are one class; classes are joined, not documents.
* Rarity comes from a table of counters of fixed size over hashes.  Any order gives right results; a shingle whose counter is one is surely
  unique, so it keeps its place in the prefix but is never shuffled.
* What is asked for is connectivity.  Every posting list is first compared with one leader; then only pairs of classes that are still in
  different components are, and only if sizes and positions allow the similarity.  Pairs within a component are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.components import component_labels
from faultline.llm.marks import bitmap_of, marked, row_key, surplus, without
from faultline.llm.words import Block, blocks, mix, shingles

WORDS, PERCENT = 5, 80
#: Counters of rarity: 2 ** COUNTER_BITS of them, two bits each when they are sent to the tasks (32 MB).
COUNTER_BITS, CHUNK_BITS = 27, 20
MAX_MATCHES = 4


def _sets(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's rows, ascending in each row, and their row."""
    found, rows = shingles(block.hashes(), block.words, k)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return found[new], rows[new]


def _set_ids(found: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit name of every row's set."""
    first = np.searchsorted(rows, np.arange(n + 1))
    counts = np.diff(first)
    a = np.concatenate([[np.uint64(0)], np.cumsum(mix(found + np.uint64(0x1234567)), dtype=np.uint64)])
    b = np.concatenate([[np.uint64(0)], np.cumsum(mix(found ^ np.uint64(0xABCDEF0123)), dtype=np.uint64)])
    a, b = a[first[1:]] - a[first[:-1]], b[first[1:]] - b[first[:-1]]
    return counts, mix(a ^ mix(b + counts.astype(np.uint64))).view(np.int64)


def rarity_table(texts: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Two bits per counter: 0 surely unique, then ever more frequent.  A counter is how often documents hold shingles of its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pack = zstandard.ZstdCompressor(level=1)

        def flush():
            slots, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            edges = np.searchsorted(slots, np.arange((1 << COUNTER_BITS - CHUNK_BITS) + 1) << CHUNK_BITS)
            chunks, data = [], []
            for chunk in np.flatnonzero(np.diff(edges)):
                part = slice(edges[chunk], edges[chunk + 1])
                low = np.diff(slots[part] & ((1 << CHUNK_BITS) - 1), prepend=0).astype("<u4")
                chunks.append(chunk)
                data.append(pack.compress(np.array([len(low)], "<u4").tobytes() + low.tobytes() + counts[part].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], ["chunk", "data"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                found, _ = _sets(block, k)
                held.append((found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
                if sum(map(len, held)) >= 1_000_000:
                    yield flush()
        if held:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(unpack.decompress(data), "<u4")
                n = int(raw[0])
                sums.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.uint32))[np.cumsum(raw[1 : n + 1], dtype=np.int64)] += raw[n + 1 :]
        for chunk, counts in sums.items():
            mean = counts.mean()
            level = (counts > 1).astype(np.uint8) + (counts > 8 + 2 * mean) + (counts > 64 + 4 * mean)
            packed = level.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([packed.sum(1).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "data"])

    chunks = 1 << COUNTER_BITS - CHUNK_BITS
    parts = map_batches(texts.select(F.col(text_col).cast("string")), count, "chunk int, data binary")
    levels = written(parts.repartition(chunks, "chunk").mapInArrow(total, "chunk int, data binary"), "rarity")
    table = np.zeros(1 << COUNTER_BITS - 2, np.uint8)
    size = 1 << CHUNK_BITS - 2
    for row in levels.coalesce(4).toLocalIterator():  # 2 ** (COUNTER_BITS - 2) bytes, whatever the size of the corpus
        table[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["data"], np.uint8)
    return table


def _levels(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = (found >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
    return (table[slot >> 2] >> ((slot & 3) << 1).astype(np.uint8)) & 3


#: What a posting of a level costs, by the length of lists that it stands for.
_COST = np.array([0.0, 3.0, 32.0, 256.0])


def _prefixes(found: np.ndarray, rows: np.ndarray, counts: np.ndarray, level: np.ndarray, percent: int):
    """Per row: its matches l, the number of unique shingles at its head, and the shared ones of its prefix, all in the global order.

    Candidates cost what their postings hold, and the verification of a share of 1 / l of them; l is where the sum is least.
    """
    n = len(counts)
    order = np.lexsort((found, level, rows))
    found, rows, level = found[order], rows[order], level[order]
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(found)) - first[rows]
    least = (counts * percent + 99) // 100
    cost = np.concatenate([[0.0], np.cumsum(_COST[level])])
    best, matches = np.full(n, np.inf), np.ones(n, np.int64)
    for m in range(1, MAX_MATCHES + 1):
        end = np.minimum(counts, counts - least + m)
        postings = cost[first[:-1] + end] - cost[first[:-1]]
        total = postings + 8 * postings / m
        better = (total < best - 1e-9) & (least >= m)
        best, matches = np.where(better, total, best), np.where(better, m, matches)
    end = np.minimum(counts, counts - least + matches)
    unique = np.bincount(rows[level == 0], minlength=n)
    inside = (place < end[rows]) & (level > 0)
    return matches, unique, found[inside], np.searchsorted(rows[inside], np.arange(n + 1))


def prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, carry: Sequence = ()) -> DataFrame:
    """A written table with, per document: ``_id``, ``n`` shingles, ``cid`` (the name of its set, null if empty), ``l``, ``head``, ``prefix`` (its shared shingles), ``_carry``."""
    table = docs.sparkSession.sparkContext.broadcast(rarity_table(docs, text_col, k))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found, rows = _sets(block, k)
                counts, names = _set_ids(found, rows, block.rows)
                matches, head, shared, edges = _prefixes(found, rows, counts, _levels(table.value, found), percent)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(shared.view(np.int64)))
                columns = [batch.column(0).slice(block.first, block.rows), pa.array(counts), pa.array(names, mask=counts == 0), pa.array(matches.astype(np.int32)), pa.array(head.astype(np.int32)), lists, batch.column(2).slice(block.first, block.rows)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n", "cid", "l", "head", "prefix", "_carry"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"), F.struct(F.lit(0).alias("_none"), *carry).alias("_carry"))
    carried = rows.schema["_carry"].dataType.simpleString()
    found = map_batches(rows, scan, f"_id {id_type}, n bigint, cid bigint, l int, head int, prefix array<bigint>, _carry {carried}")
    found = written(found, "shingle-prefixes")
    table.destroy()
    return found


def shingle_sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """``cid`` and ``shingles`` of documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                found, rows = _sets(block, k)
                counts, names = _set_ids(found, rows, block.rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names), lists], ["cid", "shingles"])

    return map_batches(docs.select(F.col(text_col).cast("string")), scan, "cid bigint, shingles array<bigint>")


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of similar classes: first enough shared prefix shingles, then the whole sets."""
    small = classes.select("cid", "n", "l", "prefix")
    left = small.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("l").alias("l_a"), F.col("prefix").alias("p_a"))
    right = small.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("l").alias("l_b"), F.col("prefix").alias("p_b"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(F.size(F.array_intersect("p_a", "p_b")) >= F.least("l_a", "l_b")).select("a", "b", "n_a", "n_b")
    whole = both.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("s_b")), "b").join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s_a")), "a")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return whole.where(shared * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def _possible(n_a: str, at_a: str, n_b: str, at_b: str, percent: int):
    """Whether two sets can be similar whose first common shingle stands at these places of the global order."""
    a, b, i, j = F.col(n_a), F.col(n_b), F.col(at_a), F.col(at_b)
    return (F.least(a - i, b - j) * (100 + percent) >= (a + b) * percent) & (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, carry: Sequence = ()) -> DataFrame:
    """Per document: ``id_col``, ``n_shingles``, ``cid`` (name of its class, null if its set is empty), ``component_id``, ``component`` (names the
    component; null: alone), the ``carry`` columns.

    Words are runs of other than ASCII white space, after lower-casing A-Z; a set holds a text's distinct ``k``-word shingles, or its whole
    sequence if it has fewer words.  Sets are linked when ``100 * shared >= percent * all``.  ``component_id`` is the smallest id that links
    lead to; a text without words is alone.  Ids may repeat: equal texts of one id are one document in effect.  Null ids take part and
    count as no id, so a component of only such rows has a null id.  Other columns are ignored.
    """
    members = prefixes(docs, id_col, text_col, k, percent, carry)
    some = members.where("cid IS NOT NULL")
    classes = written(some.groupBy("cid").agg(F.min("_id").alias("least"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("head").alias("head"), F.first("prefix").alias("prefix")), "shingle-classes")

    posts = classes.select("cid", "n", "head", F.posexplode("prefix").alias("_k", "token")).select("token", "cid", "n", (F.col("head") + F.col("_k")).alias("at"))
    # The leader of a list has the fewest rarer shingles: of a group of near copies, most likely what they were copied from.
    lists = posts.groupBy("token").agg(F.count("*").alias("_rows"), F.min_by(F.struct("cid", "n", "at"), F.struct("at", "cid")).alias("lead")).where("_rows > 1")
    lists = lists.withColumn("_again", F.xxhash64("token"))
    shared = written(posts.withColumn("_again", F.xxhash64("token")).join(lists, ["token", "_again"]).select("token", "cid", "n", "at", F.col("lead.cid").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.at").alias("lead_at")), "shingle-postings")

    wanted = classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("cid", "least")
    marks = bitmap_of(wanted, F.xxhash64("least"))
    sets = shingle_sets(marked(docs.select(id_col, text_col), marks, F.xxhash64(id_col), "_m").where("_m"), text_col, k)
    sets = written(sets.join(wanted.select("cid"), "cid", "left_semi").groupBy("cid").agg(F.first("shingles").alias("shingles")), "shingle-sets")

    ordered = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    first = shared.where("cid <> lead").where(_possible("n", "at", "lead_n", "lead_at", percent))
    first = first.select(F.col("cid").alias("x"), F.col("lead").alias("y")).select(*ordered).distinct()
    links = written(_linked(first, classes, sets, percent), "shingle-links")
    labels = component_labels(links)

    # Lists that still hold several components: every class outside the largest part of its list meets the classes of other components.
    placed = shared.drop("lead", "lead_n", "lead_at").join(labels, F.col("cid") == F.col("node"), "left")
    placed = written(placed.select("token", "cid", "n", "at", F.coalesce("label", "cid").alias("part")), "shingle-parts")
    parts = placed.groupBy("token", "part").agg(F.count("*").alias("_rows")).groupBy("token").agg(F.max_by("part", F.struct("_rows", "part")).alias("main"), F.count("*").alias("_parts"))
    parts = parts.where("_parts > 1").withColumn("_again", F.xxhash64("token"))
    mixed = placed.withColumn("_again", F.xxhash64("token")).join(parts, ["token", "_again"])
    others = mixed.where("part <> main").select("token", F.col("cid").alias("x"), F.col("n").alias("x_n"), F.col("at").alias("x_at"), F.col("part").alias("x_part"))
    all_ = mixed.select("token", F.col("cid").alias("y"), F.col("n").alias("y_n"), F.col("at").alias("y_at"), F.col("part").alias("y_part"))
    second = others.join(all_, "token").where("x_part <> y_part").where(_possible("x_n", "x_at", "y_n", "y_at", percent))
    second = second.select(*ordered).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = _linked(second, classes, sets, percent)
    # The links found now join components of the first ones, so only those are looked at again.
    known = labels.select("node", "label")
    more = more.join(known.toDF("a", "of_a"), "a", "left").join(known.toDF("b", "of_b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = component_labels(more).toDF("part", "whole")

    of_class = classes.select("cid", "least").join(labels, F.col("cid") == F.col("node"), "left").select("cid", "least", F.coalesce("label", "cid").alias("part"))
    of_class = of_class.join(joined, "part", "left").select("cid", "least", F.coalesce("whole", "part").alias("label"))
    ids = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = written(of_class.join(ids, "label").select("cid", "component_id", F.col("label").alias("component")), "shingle-components")
    found = some.select("_id", "n", "cid", "_carry").join(of_class, "cid").select("_id", "n", "cid", "component_id", "component", "_carry")
    alone = members.where("cid IS NULL").select("_id", "n", "cid", F.col("_id").alias("component_id"), F.lit(None).cast("bigint").alias("component"), "_carry")
    return found.unionByName(alone).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "cid", "component_id", "component", "_carry.*").drop("_none")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of every component, with all columns: the one of the smallest id.

    A null id loses against every other; where rows share the id, or none has one, the hash of the text decides, and of rows that repeat
    both id and text one stays.  Texts without words are linked with nothing and all stay.
    """
    found = near_components(docs, id_col, text_col, k, percent, carry=[row_key(id_col, text_col).alias("_row")])
    gone, once = surplus(found.where("component IS NOT NULL").select("component", "_row"), "component", largest=False)
    return without(docs, written(gone, "near-copies"), id_col, text_col, written(once, "near-repeats"))
