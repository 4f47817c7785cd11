"""Hard negatives by rotated one-bit codes with stored alignments.

A vector of integers is rotated by signs and Hadamard transforms; its code is the signs of the outcome, its alignment the cosine between the rotated
vector and the code.  The inner product of an anchor with a code is estimated by counting bits: the anchor's rotated components are rounded
to eight bits, and each of the eight planes of bits meets the code with one popcount.  What the code leaves out of its vector is orthogonal
to it, so by Cauchy and Schwarz it adds at most its own length times what the anchor has beside the code: an interval that surely holds
the score.  Rows whose interval can't reach the wanted scores are dropped; the others are scored on the integers, so results are exact.

Anchors and rows are dealt into blocks that meet in tasks of their own.  Each task keeps the best rows of each anchor, whose scores also raise
the bar for the intervals of the rows behind them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.vectors import PseudoRotation, by_width, matrix, meet, one_row_per_id, usable
from faultline.operators import segmented as seg

PLANES = 8
#: Components of anchors that a task holds, and rows that pass it.
BLOCK_COMPONENTS, BLOCK_ROWS = 1 << 20, 1 << 15
#: Squares of a row's integers sum to less than this, so a long holds every score.
MOST_SQUARED = float(1 << 62)
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
SLACK = 1e-9
INDEX = "id bigint, label bigint, vector array<bigint>, width int, code binary, norm double, aligned double"


def integers(vector: Column, scale: int = 256) -> Column:
    """Each component times ``scale``, rounded down; null where the squares are too many for scores to be longs."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < MOST_SQUARED ** 0.5)
    squared = F.aggregate(vector, F.lit(0.0), lambda total, x: total + F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0)))
    return F.when(small & (squared < MOST_SQUARED), scaled)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def _coded(batches):
    """Each row with its code, its length and its alignment."""
    for batch in batches:
        for width, part in by_width(batch, "vector"):
            rows = matrix(part.column("vector"))
            turned, norm = PseudoRotation(width, 0)(rows), np.sqrt((rows * rows).sum(axis=1))
            aligned = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
            aligned = np.divide(aligned, norm, out=np.zeros_like(norm), where=norm > 0)
            codes = [x.tobytes() for x in _words(turned > 0)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("vector"), pa.array(np.full(len(rows), width, np.int32)),
                                              pa.array(codes, pa.binary()), pa.array(norm), pa.array(aligned)], ["id", "label", "vector", "width", "code", "norm", "aligned"])


class Rows:
    """A batch of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.id, self.label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        self.integer = matrix(batch.column("vector"), np.int64)
        self.real = self.integer.astype(np.float64)
        self.norm, self.aligned = batch.column("norm").to_numpy(), np.minimum(batch.column("aligned").to_numpy(), 1.0)
        self.code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(len(self.id), -1)
        self.ones = np.bitwise_count(self.code).sum(axis=1, dtype=np.int64)
        self.beside = np.sqrt(1.0 - self.aligned ** 2)
        self.longest = self.norm.max()


class Anchor:
    """An anchor as bit planes, for estimates, and as integers."""

    def __init__(self, integer: np.ndarray):
        self.integer, self.real = integer, integer.astype(np.float64)
        self.norm = float(np.sqrt((self.real ** 2).sum()))
        turned = PseudoRotation(len(integer), 0)(self.real[None])[0]
        self.size, self.low = len(turned), float(turned.min())
        self.step = (float(turned.max()) - self.low) / ((1 << PLANES) - 1) or 1.0
        levels = np.rint((turned - self.low) / self.step).astype(np.int64)
        self.planes = [_words((levels >> p & 1).astype(bool)[None])[0] for p in range(PLANES)]
        self.total = int(levels.sum())
        self.missed = float(np.sqrt(((turned - self.low - self.step * levels) ** 2).sum()))

    def interval(self, rows: Rows, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the rows ``at``."""
        code, ones = rows.code[at], rows.ones[at]
        inside = np.zeros(len(at), np.int64)
        for p, plane in enumerate(self.planes):
            inside += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << p
        along = (self.low * (2 * ones - self.size) + self.step * (2 * inside - self.total)) / np.sqrt(self.size)
        least = np.maximum(np.abs(along) - self.missed, 0.0)
        norm, aligned = rows.norm[at], rows.aligned[at]
        far = norm * (aligned * self.missed + rows.beside[at] * np.sqrt(np.maximum(self.norm ** 2 - least ** 2, 0.0)))
        far += SLACK * (norm * self.norm + 1.0)
        return norm * aligned * along - far, norm * aligned * along + far

    def scores(self, rows: Rows, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the rows ``at``."""
        if self.norm * rows.longest >= EXACT:
            return rows.integer[at] @ self.integer
        if 2 * len(at) > len(rows.id):
            return (rows.real @ self.real)[at].astype(np.int64)
        return (rows.real[at] @ self.real).astype(np.int64)


class Best:
    """The first ``n`` rows met, by larger score and then smaller id."""

    def __init__(self, n: int):
        self.n, self.score, self.id = n, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self) -> float:
        """Rows of less can't come in."""
        return float(self.score[-1]) if len(self.score) == self.n else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[:self.n]
        self.score, self.id = score[order], ids[order]


def _positives(k: int):
    def run(held, batches):
        asked, labels = held.column("anchor_id").to_numpy(), held.column("anchor_label").to_numpy()
        anchors, best = [Anchor(v) for v in matrix(held.column("anchor"), np.int64)], [Best(k) for _ in asked]
        for rows in map(Rows, batches):
            for own, label, anchor, top in zip(asked, labels, anchors, best, strict=True):
                at = np.flatnonzero((rows.label == label) & (rows.id != own))
                if not len(at):
                    continue
                low, high = anchor.interval(rows, at)
                bar = max(top.bar, np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf)
                at = at[high >= bar]
                top.add(anchor.scores(rows, at), rows.id[at])
        counts = [len(b.id) for b in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, counts)), pa.array(np.concatenate([b.id for b in best])), pa.array(np.concatenate([b.score for b in best]))],
                                         ["anchor_id", "positive_id", "positive_score"])
    return run


def _negatives(n: int, low_share: int, high_share: int, whole: int):
    def run(held, batches):
        asked, labels = held.column("anchor_id").to_numpy(), held.column("anchor_label").to_numpy()
        anchors = [Anchor(v) for v in matrix(held.column("anchor"), np.int64)]
        positives = held.column("positives").to_pylist()
        best = [[Best(n) for _ in p] for p in positives]
        for rows in map(Rows, batches):
            for label, anchor, pairs, tops in zip(labels, anchors, positives, best, strict=True):
                at = np.flatnonzero(rows.label != label)
                if not len(at):
                    continue
                low, high = anchor.interval(rows, at)
                bounds = [(low_share * p["positive_score"], high_share * p["positive_score"]) for p in pairs]
                may = np.zeros(len(at), bool)
                for (least, most), top in zip(bounds, tops, strict=True):
                    may |= (high >= max(least / whole - 1, top.bar)) & (low <= most / whole + 1)
                at = at[may]
                score = anchor.scores(rows, at)
                # Products with a share might leave the range of longs: bounds of the score itself, rounded inwards.
                for (least, most), top in zip(bounds, tops, strict=True):
                    fits = (score >= -(-least // whole)) & (score <= most // whole)
                    top.add(score[fits], rows.id[at[fits]])
        flat = [(a, p["positive_id"], p["positive_score"], t) for a, pairs, tops in zip(asked, positives, best, strict=True) for p, t in zip(pairs, tops, strict=True)]
        counts = [len(t.id) for *_, t in flat]
        if sum(counts):
            columns = [np.repeat(np.array([f[i] for f in flat], np.int64), counts) for i in range(3)]
            columns += [np.concatenate([t.id for *_, t in flat]), np.concatenate([t.score for *_, t in flat])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])
    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, whole: int = 100, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows ``(id, label, vector)``.

    Components become integers (times ``scale``, rounded down); scores are inner products of them.  An anchor is a row for which ``is_anchor``
    (over ``id``) holds; its positives are the first ``positives`` other rows of its label, by larger score and then smaller id.  For each of
    them, the negatives are the first ``negatives`` rows of other labels whose score times ``whole`` lies between ``low`` and ``high`` times the
    positive's score.  Fewer are returned where there are fewer; an anchor without positives has no rows.

    Rows with a null id, label or vector, an empty vector or a component that is null or not finite take no part; nor do vectors of other lengths
    than the anchor's, and vectors whose integers are too large for a score to be a long.  Of several rows of one id the one of the least label
    and vector counts.  Other columns are ignored.
    """
    base = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    base = one_row_per_id(base.withColumn("vector", integers(F.col("vector"), scale)).where("vector IS NOT NULL"), "id", "label", "vector")
    index = written(map_batches(base, _coded, INDEX), "negatives-index")
    anchors = written(index.where(is_anchor).select(F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("vector").alias("anchor"), "width"), "negatives-anchors")

    n_rows, n_components = index.count(), anchors.agg(F.sum(F.col("width").cast("bigint"))).first()[0] or 0
    row_blocks, anchor_blocks = -(-n_rows // BLOCK_ROWS), -(-n_components // BLOCK_COMPONENTS)
    # Small tables are dealt over all cores too.
    row_blocks = max(row_blocks, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // 1024)), 1)

    def dealt(df, key, own, own_blocks, other, other_blocks):
        df = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))

    place = ["width", "row_block", "anchor_block"]
    right = dealt(index, "id", "row_block", row_blocks, "anchor_block", max(anchor_blocks, 1))

    def search(asked, function, schema):
        return meet(dealt(asked, "anchor_id", "anchor_block", max(anchor_blocks, 1), "row_block", row_blocks), right, place, function, schema)

    near = search(anchors, _positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = seg.top_n(near, ["anchor_id"], [F.desc("positive_score"), "positive_id"], positives)
    near = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    asked = written(anchors.join(near, "anchor_id"), "negatives-asked")
    far = search(asked, _negatives(negatives, low, high, whole), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    out = seg.top_n(far, ["anchor_id", "positive_id"], [F.desc("negative_score"), "negative_id"], negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
