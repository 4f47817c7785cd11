"""Benchmark decontamination by winnowing.

The least k-gram hash of every sliding window is a fingerprint; every shared run of ``span`` words has one in common, on both sides at the same
word.  Fingerprints of documents and benchmark items are joined, and every hit is extended word by word on both sides.  As a hit carries the
hashes of the words around it, extending needs no text: a run of ``span`` words holds its fingerprint within reach, and a longer run is the
union of what its fingerprints reach.  Items shorter than ``span`` are one window each; they are looked up by the hash of their whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from faultline.llm.common import map_batches, written
from faultline.llm.marks import BITS, bitmap_of, row_key, without
from faultline.llm.words import LETTERS, Block, blocks, mix, runs

SPAN, GRAM = 10, 5
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _windows(block: Block, hashes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the fingerprints among the block's words, and their hashes."""
    grams = runs(hashes, k)
    counts = block.counts()
    left = np.repeat(block.words[1:], counts) - np.arange(len(hashes))  # words from here to the end of the row
    start = np.flatnonzero(left >= span)
    best, place = grams[start] if len(start) else np.zeros(0, np.uint64), start.copy()
    for j in range(1, span - k + 1):
        other = grams[start + j]
        less = other <= best
        best = np.where(less, other, best)
        place[less] = start[less] + j
    place = np.unique(place)
    return place, grams[place] if len(place) else np.zeros(0, np.uint64)


def _around(block: Block, hashes: np.ndarray, place: np.ndarray, span: int, k: int, outside: int) -> np.ndarray:
    """Hashes of the words that a run of ``span`` words with this gram can reach; ``outside`` where the row has none."""
    row = np.searchsorted(block.words, place, "right") - 1
    at = place[:, None] + np.arange(k - span, span)[None, :]
    found = hashes[np.clip(at, 0, max(0, len(hashes) - 1))]
    found[(at < block.words[row][:, None]) | (at >= block.words[row + 1][:, None])] = np.uint64(outside)
    return found


def _fingerprints(block: Block, hashes: np.ndarray, span: int, k: int, lengths: list[int], bits: np.ndarray | None, outside: int):
    """(place, length, hash, around) of fingerprints; length 0 is a winnowed gram, else a whole sequence of that many words.

    Items (no ``bits``) give whole sequences only for rows of that length, documents at every word whose bit is set.
    """
    counts = block.counts()
    found = []
    place, value = _windows(block, hashes, span, k)
    if bits is not None:
        hit = _bit(bits, value)
        place, value = place[hit], value[hit]
    found.append((place, np.zeros(len(place), np.int32), value, _around(block, hashes, place, span, k, outside)))
    left = np.repeat(block.words[1:], counts) - np.arange(len(hashes))
    for m in lengths:
        grams = runs(hashes, m)
        if bits is None:
            place = block.words[:-1][counts == m]
        else:
            place = np.flatnonzero(left >= m)
            place = place[_bit(bits, grams[place])]
        found.append((place, np.full(len(place), m, np.int32), grams[place], np.zeros((len(place), 2 * span - k), np.uint64)))
    return [np.concatenate(x) for x in zip(*found)]


def _bit(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    slot = (value & np.uint64(BITS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _hit_lists(rows: np.ndarray, n: int, parts: list[np.ndarray], words: np.ndarray) -> pa.Array:
    """Fingerprints as one list per row."""
    place, length, value, around = parts
    order = np.lexsort((place, rows))
    place, length, value, around, rows = place[order], length[order], value[order], around[order], rows[order]
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32) * around.shape[1]), pa.array(around.reshape(-1).view(np.int64)))
    struct = pa.StructArray.from_arrays([pa.array(place - words[rows]), pa.array(length), pa.array(value.view(np.int64)), inner], ["at", "m", "fp", "around"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), struct)


HITS = "array<struct<at: bigint, m: int, fp: bigint, around: array<bigint>>>"


def fingerprints(texts: DataFrame, id_col: str, text_col: str, span: int, k: int, lengths: list[int], bits=None, outside: int = 0) -> DataFrame:
    """Per row of ``texts``: ``_id``, ``_n`` words, ``_key`` (hash of the words), ``_hits`` (its fingerprints; only those in ``bits`` if given)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else bits.value
        for batch in batches:
            for block in blocks(batch.column(1), LETTERS):
                hashes = block.hashes()
                parts = _fingerprints(block, hashes, span, k, lengths, table, outside)
                rows = np.searchsorted(block.words, parts[0], "right") - 1
                counts = block.counts()
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(block.words[:-1], counts).astype(np.uint64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ mix(place)), dtype=np.uint64)])
                key = (sums[block.words[1:]] - sums[block.words[:-1]]).view(np.int64)
                ids = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.array(key), _hit_lists(rows, block.rows, parts, block.words)], ["_id", "_n", "_key", "_hits"])

    id_type = texts.schema[id_col].dataType.simpleString()
    return map_batches(texts.select(F.col(id_col), F.col(text_col).cast("string")), scan, f"_id {id_type}, _n bigint, _key bigint, _hits {HITS}")


def _extended(span: int, k: int) -> tuple[Column, Column]:
    """First word and end of the run of equal words around a joined gram, as far as a window reaches."""
    reach = span - k
    same = [F.col("around")[i] == F.col("item_around")[i] for i in range(2 * span - k)]
    left, right, l, r = F.lit(0), F.lit(0), F.lit(True), F.lit(True)
    for j in range(1, reach + 1):
        l, r = l & same[reach - j], r & same[reach + k - 1 + j]
        left, right = left + l.cast("int"), right + r.cast("int")
    whole = F.col("m") > 0
    return F.when(whole, F.col("at")).otherwise(F.col("at") - left), F.when(whole, F.col("at") + F.col("m")).otherwise(F.col("at") + k + right)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): per document ``_id, _key, _n``; per shared run ``_id, _key, item, start, end`` in words of the document.

    Words are runs of digits, a-z after lower-casing A-Z, and non-ASCII characters.  Runs overlap; their union is what the documents share.
    The benchmark's fingerprints reach the scan of the documents as a bitmap of fixed size; only fingerprints found there are joined.
    """
    spark = docs.sparkSession
    # An item shorter than the span: which lengths there are, at most span - 1 numbers.
    raw = written(fingerprints(items, item_id, item_text, span, k, list(range(1, span)), None, 1), "benchmark-fingerprints")
    known = raw.select(F.col("_id").alias("item"), F.explode("_hits").alias("_h")).select("item", F.col("_h.m").alias("m"), F.col("_h.fp").alias("fp"), F.col("_h.around").alias("item_around")).distinct()
    lengths = sorted(r["m"] for r in known.where("m > 0").select("m").distinct().collect())
    bits = np.zeros(BITS // 8, np.uint8)
    for row in bitmap_of(known, F.col("fp")).toLocalIterator():  # at most BITS / 8 bytes, whatever the size of the benchmark
        at = (row["_bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["_bits"], np.uint8)
    scanned = written(fingerprints(docs, id_col, text_col, span, k, lengths, spark.sparkContext.broadcast(bits), 0), "document-fingerprints")
    hits = scanned.select("_id", "_key", F.explode("_hits").alias("_h")).select("_id", "_key", "_h.*")
    start, end = _extended(span, k)
    joined = hits.join(known, ["m", "fp"]).select("_id", "_key", "item", start.alias("start"), end.alias("end"), "m")
    spans = joined.where((F.col("m") > 0) | (F.col("end") - F.col("start") >= span)).drop("m").distinct()
    return scanned.select("_id", "_key", "_n"), spans


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Per document: ``id_col``, ``n_words``, ``n_hit`` (words inside a shared window), ``n_items``, ``items_sha256``, ``contaminated``.

    A window is ``span`` consecutive words of an item, or all words of a shorter one; an item without words has none.  A null text has no
    words.  Item ids are listed as strings; a null id is not listed, though its words are hit.  Repeated documents and items give equal rows
    and no further hits; other columns are ignored.
    """
    documents, spans = overlaps(docs, items, id_col, text_col, item_id, item_text, span, k)
    found = spans.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("_items"))
    # The union of the runs of one document: what each adds to the runs that start before it.
    w = Window.partitionBy("_id", "_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs_ = spans.select("_id", "_key", "start", "end").distinct().withColumn("_seen", F.coalesce(F.max("end").over(w), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_seen"))
    hit = runs_.groupBy("_id", "_key").agg(F.sum(new).alias("_hit"))
    per = found.join(hit, found["_id"].eqNullSafe(hit["_id"]) & (found["_key"] == hit["_key"])).select(found["_id"].alias("_i"), found["_key"].alias("_k"), "_items", "_hit")
    out = documents.join(per, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    n_hit = F.coalesce("_hit", F.lit(0)).cast("bigint")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), n_hit.alias("n_hit"), F.coalesce(F.size("_items"), F.lit(0)).cast("bigint").alias("n_items"),
                      F.coalesce(F.sha2(F.concat_ws(",", "_items"), 256), F.lit(EMPTY_SHA256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any shared window, with all their columns."""
    rows = docs.select(row_key(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    found = contamination(rows, items, "_row", "_text", **options).where("contaminated")
    return without(docs, written(found.select("_row"), "contaminated"), id_col, text_col)
