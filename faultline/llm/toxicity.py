"""Toxicity as an ordinal grade: cumulative-link regression on sparse text features.

Grades are ordered; P(grade > j) = s(w . x - theta_j), with one weight vector for all thresholds theta_1 < theta_2 < ...  Features are the
distinct words of a text and the beginnings of longer words, so that inflected and compounded words count.  The model is fitted on a bounded
sample of labelled documents; the fit is sparse, and only features with a weight are looked for when texts are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.words import LETTERS, Block, blocks, mix, span_hashes

#: Labelled documents of each class that the model is fitted on, at most; they are those of the least hashes of the id.
SAMPLE_ROWS = 4_000
BEGINNINGS = (4, 5)


@dataclass
class OrdinalModel:
    """Weights of feature hashes (ascending), thresholds of the grades, and the expected grade from which a text is toxic."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of P(grade > j)."""
        return sum((_sigmoid(score - t) for t in self.thresholds), np.zeros(len(score)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def block_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and of the first 4 and 5 bytes of words that are longer by two at least."""
    row, words = block.row_of_word(), block.hashes()
    rows, found = [row], [words]
    for n in BEGINNINGS:
        long_ = block.ends - block.starts >= n + 2
        rows.append(row[long_])
        found.append(mix(span_hashes(block.data, block.starts[long_], block.starts[long_] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(found)


def sample_features(texts: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Per text its label, its distinct features, and a number of its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0), LETTERS):
                rows, found = block_features(block)
                pairs = np.unique(np.rec.fromarrays([rows, found]))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs.f0, np.arange(block.rows + 1)).astype(np.int32)), pa.array(np.ascontiguousarray(pairs.f1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.first, block.rows), lists], ["label", "features"])

    found = map_batches(texts.select(F.col(text_col).cast("string"), F.col(label_col).cast("int")), scan, "label int, features array<bigint>")
    return found.withColumn("row", F.monotonically_increasing_id())


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Texts and labels of at most ``rows`` labelled documents of each class.  A document labelled twice counts as the higher label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    chosen = [known.where(F.col("_label") == label).orderBy(F.xxhash64(id_col), id_col).limit(rows) for label in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).withColumnRenamed(id_col, "_labelled")
    joined = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_labelled"))
    return joined.dropDuplicates(["_doc"]).select("_text", "_label")


def severity_grades(labels: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Grade 0 for clean texts; 1 to 3 for toxic ones, by thirds of the number of distinct markers (features that toxic texts alone hold)."""
    toxic = labels > 0
    grades = np.zeros(len(labels), np.int64)
    if toxic.any():
        low, high = np.quantile(markers[toxic], [1 / 3, 2 / 3])
        grades[toxic] = 1 + (markers[toxic] > low) + (markers[toxic] > high)
    return grades


def candidate_features(sample: DataFrame) -> DataFrame:
    """``feature``, ``held1``, ``held0`` and ``strength`` of the features that toxic texts hold more often than by chance.

    ``strength`` is the likelihood ratio against independence over what chance reaches among so many features; candidates have more than 1.
    """
    totals = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n1"), F.count("*").alias("n")).first()
    n1, n = float(totals["n1"]), float(totals["n"])
    if n1 in (0, n):
        return sample.select(F.lit(0).cast("bigint").alias("feature"), *[F.lit(0.0).alias(c) for c in ("held1", "held0", "strength")]).where("false")
    counts = written(sample.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").cast("double").alias("held1"), F.count("*").cast("double").alias("both")), "toxic-features")
    chance = 2 * math.log(max(2, counts.count()))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    held1, both, expected = F.col("held1"), F.col("both"), F.col("both") * n1 / n
    ratio = 2 * (part(held1, expected) + part(both - held1, both - expected) + part(n1 - held1, n1 - expected) + part(n - n1 - both + held1, n - n1 - both + expected))
    found = counts.withColumn("strength", ratio / chance).where((held1 > expected) & (F.col("strength") > 1))
    return found.select("feature", "held1", (both - held1).alias("held0"), "strength")


def fit_ordinal(rows: list, labels: np.ndarray, features: np.ndarray, held: np.ndarray, strength: np.ndarray, clean: np.ndarray, l1: float = 2e-3, steps: int = 600) -> OrdinalModel:
    """Fit weights and thresholds by accelerated proximal gradient steps.

    ``rows`` are the candidate ``features`` (ascending hashes) of each text; ``held`` is how many texts hold each, ``clean`` how many of them are
    clean.  ``l1`` over a feature's ``strength`` keeps the weights few, yet hardly shrinks strong evidence.  Weights are not negative: more text
    never makes a toxic text clean.  With no text of one class there is nothing to learn: no text is toxic then.
    """
    labels = np.asarray(labels)
    if not len(labels) or labels.min() == labels.max() or not len(features):
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0]), 0.5)
    counts = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), counts)
    col = np.searchsorted(features, np.concatenate([np.asarray(r, np.int64) for r in rows]).view(np.uint64))
    toxic = labels > 0
    n, m = len(rows), len(features)
    grades = severity_grades(labels, np.bincount(row, weights=(clean == 0)[col], minlength=n))
    levels = np.unique(grades)[1:]
    targets = np.stack([grades >= g for g in levels], 1).astype(float)
    theta = np.log((1 - targets.mean(0)) / targets.mean(0))
    w, momentum, gap = np.zeros(m), np.zeros(m), 1.0
    pace = n / (2 * len(levels) * max(1, counts.max())) / np.maximum(1, np.sqrt(held))
    for _ in range(steps):
        score = np.bincount(row, weights=momentum[col], minlength=n)
        wrong = _sigmoid(score[:, None] - theta[None, :]) - targets
        grad = np.bincount(col, weights=wrong.sum(1)[row], minlength=m) / n
        new = np.maximum(momentum - pace * (grad + l1 / strength), 0)
        theta = np.sort(theta + 4.0 * wrong.mean(0))
        following = (1 + np.sqrt(1 + 4 * gap * gap)) / 2
        momentum, w, gap = new + (gap - 1) / following * (new - w), new, following
    kept = w != 0
    model = OrdinalModel(features[kept], w[kept], theta, 0.5)
    model.cut = _best_cut(model.expected(np.bincount(row, weights=w[col], minlength=n)), toxic)
    return model


def _best_cut(expected: np.ndarray, toxic: np.ndarray) -> float:
    """The expected grade that parts the classes with the fewest errors, in the middle of its gap; a text without features is clean."""
    order = np.argsort(expected, kind="stable")
    value, label = expected[order], toxic[order]
    missed = np.concatenate([[0], np.cumsum(label)])
    accused = np.concatenate([np.cumsum((~label)[::-1])[::-1], [0]])
    gaps = np.flatnonzero(value[1:] > value[:-1] + 1e-9) + 1
    if not len(gaps):
        return float(value[-1] + 1)
    i = int(gaps[np.argmin((missed + accused)[gaps])])
    return float((value[i - 1] + value[i]) / 2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """Fit the model on a sample of at most ``2 * rows`` labelled documents; the driver gets their candidate features only."""
    sample = written(sample_features(labelled_sample(docs, labels, id_col, text_col, label_col, rows), "_text", "_label"), "toxic-sample")
    candidates = written(candidate_features(sample), "toxic-candidates")
    found = sorted(((r["feature"] % (1 << 64), r["held1"], r["held0"], r["strength"]) for r in candidates.collect()))
    # A text without candidates is the row of its label without features.
    held = sample.select("label", "row", F.explode("features").alias("feature")).join(F.broadcast(candidates.select("feature")), "feature").groupBy("label", "row").agg(F.collect_list("feature").alias("held"))
    texts = sample.select("label", "row").join(held.select("row", "held"), "row", "left").select("label", F.coalesce("held", F.array().cast("array<bigint>")).alias("held")).collect()
    texts = sorted((r["label"], sorted(r["held"])) for r in texts)
    values = [np.array(x, np.float64) for x in zip(*[f[1:] for f in found])] or [np.zeros(0)] * 3
    return fit_ordinal([t[1] for t in texts], np.array([t[0] for t in texts], np.int64), np.array([f[0] for f in found], np.uint64), values[0] + values[1], values[2], values[1])


def _toxic_rows(model: OrdinalModel):
    """A function that yields (block, severity, toxic) for a column of texts."""
    low = np.zeros(1 << 16, bool)
    low[(model.features & np.uint64(0xFFFF)).astype(np.int64)] = True
    n = max(1, len(model.features))

    def judge(texts: pa.Array) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
        for block in blocks(texts, LETTERS):
            score = np.zeros(block.rows)
            if len(model.features):
                rows, found = block_features(block)
                maybe = low[(found & np.uint64(0xFFFF)).astype(np.int64)]
                rows, found = rows[maybe], found[maybe]
                at = np.minimum(np.searchsorted(model.features, found), n - 1)
                hit = model.features[at] == found
                pairs = np.unique(rows[hit] * np.int64(n) + at[hit])
                score = np.bincount(pairs // n, weights=model.weights[pairs % n], minlength=block.rows)
            severity = model.expected(score)
            yield block, severity, severity >= model.cut

    return judge


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, ``severity`` (expected grade), ``grade`` (the nearest), ``toxic``.

    A null or empty text has no features and the severity of that.  Rows may repeat, ids may be null; other columns are ignored.
    """
    judge = _toxic_rows(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, severity, toxic in judge(batch.column(1)):
                columns = [batch.column(0).slice(block.first, block.rows), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(toxic)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "severity", "grade", "toxic"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), scan, f"_id {id_type}, severity double, grade int, toxic boolean")
    return out.withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not toxic, with all columns, decided row by row."""
    at = docs.columns.index(text_col)
    toxic = _toxic_rows(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~np.concatenate([np.zeros(0, bool), *(t for _, _, t in toxic(batch.column(at)))])))

    return map_batches(docs, scan, docs.schema)
