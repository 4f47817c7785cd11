"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by fast Hadamard pseudo-rotations and takes the nearest signed axis, twice; the two axes are the bucket.  A
query looks into the buckets of every table in the order of how near their axes are to it (multiprobe).  Rows of a bucket meet its queries
in the task that holds them; those found are ranked by their exact cosine there, and only the best of each task go on.

A bucket of any size is dealt out over blocks, so no row is left out of it.  Of equal vectors only the ``k + 1`` of the least ids can be
among the ``k`` nearest of any query; the others are not indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, written
from faultline.llm.vectors import PseudoRotation, by_width, matrix, meet, one_row_per_id, padded, usable
from faultline.operators import segmented as seg

#: Tables; a bucket is a pair of axes, one of each of the table's two rotations.
TABLES = 8
#: Buckets that a query probes in a table: this share of all of them, times the rows to the power below.
PROBE_SHARE, PROBE_POWER = 0.9, -0.35
#: Rows of one side that meet as a block, and the least and largest number of places that the buckets of a table are put together in.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096
PLACES = 16, 16_384
SLACK = 1e-9
#: Sums of axes that are computed at once.
TILE = 4_000_000


def _axes(rotated: np.ndarray) -> np.ndarray:
    axis = np.abs(rotated).argmax(axis=1)
    return 2 * axis + (rotated[np.arange(len(rotated)), axis] < 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def probe_count(rows: int, buckets: int) -> int:
    """Buckets of a table that a query probes, in an index of so many rows."""
    return int(min(buckets, max(16, np.ceil(buckets * PROBE_SHARE * max(rows, 1) ** PROBE_POWER))))


def place_size(rows: int, buckets: int) -> int:
    """Neighbouring buckets that make a place, where rows and queries meet: about a block of rows each; powers of two."""
    places = min(max(PLACES[0], padded(-(-rows // BLOCK_ROWS))), PLACES[1], buckets)
    return buckets // places


def _file_under(tables: int, rows: int):
    """Each row under the place and the bucket that it has in every table."""
    def run(batches):
        for batch in batches:
            for width, part in by_width(batch, "vector"):
                unit = _unit(matrix(part.column("vector")))
                n_axes = 2 * padded(width)
                size = place_size(rows, n_axes * n_axes)
                for table in range(tables):
                    first, second = (_axes(PseudoRotation(width, 2 * table + i)(unit)) for i in (0, 1))
                    bucket = first * n_axes + second
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), part.column("vector"), pa.array(np.full(len(unit), width, np.int32)), pa.array(np.full(len(unit), table, np.int32)),
                         pa.array((bucket // size).astype(np.int32)), pa.array((bucket % size).astype(np.int32))], ["id", "vector", "width", "table", "place", "bucket"])
    return run


def _nearest_buckets(first: np.ndarray, second: np.ndarray, count: int, size: int):
    """The ``count`` pairs of axes with the largest sums for each query: query, place, and the list of its buckets there."""
    n_axes = first.shape[1]
    order = [np.argsort(-x, axis=1, kind="stable") for x in (first, second)]
    ranked = [np.take_along_axis(x, o, axis=1) for x, o in zip((first, second), order, strict=True)]
    # A pair of ranks (i, j) has (i + 1) * (j + 1) - 1 pairs that are at least as near.
    sizes = [min(n_axes, count // (i + 1)) for i in range(min(n_axes, count))]
    i, j = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])
    keys = []
    for start in range(0, len(first), step := max(1, TILE // len(i))):
        part = slice(start, start + step)
        best = np.argpartition(-(ranked[0][part][:, i] + ranked[1][part][:, j]), min(count, len(i)) - 1, axis=1)[:, :count]
        key = np.take_along_axis(order[0][part], i[best], 1) * n_axes + np.take_along_axis(order[1][part], j[best], 1)
        keys.append(np.sort(key + np.arange(start, start + len(key))[:, None] * n_axes * n_axes, axis=1))
    keys = np.concatenate(keys).ravel()
    group, at = np.unique(keys // size, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)).astype(np.int32)), pa.array((keys % size).astype(np.int32)))
    places = n_axes * n_axes // size
    return group // places, group % places, lists


def _probes(tables: int, rows: int):
    """Each query once for every place that one of its probes has, with the buckets of those probes."""
    def run(batches):
        for batch in batches:
            for width, part in by_width(batch, "vector"):
                unit = _unit(matrix(part.column("vector")))
                for table in range(tables):
                    near = []
                    for i in (0, 1):
                        rotated = PseudoRotation(width, 2 * table + i)(unit)
                        near.append(np.stack([rotated, -rotated], axis=2).reshape(len(unit), -1))
                    buckets = near[0].shape[1] ** 2
                    q, place, probed = _nearest_buckets(*near, probe_count(rows, buckets), place_size(rows, buckets))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(pa.array(q)), part.column("vector").take(pa.array(q)), pa.array(np.full(len(q), width, np.int32)),
                         pa.array(np.full(len(q), table, np.int32)), pa.array(place.astype(np.int32)), probed], ["query_id", "query", "width", "table", "place", "probed"])
    return run


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which is exact, so that no square leaves the range of doubles."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=-1, keepdims=True))[1])


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of a vector with each row, in double precision; the sums are taken in the same order for every row, so equal rows score equally."""
    query, rows = _scaled(query), _scaled(rows)
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def _best(k: int, index_rows: int):
    """The best ``k`` of a block's rows for each of its queries."""
    def found_in(queries: pa.RecordBatch, rows: pa.RecordBatch):
        ids, asked = rows.column("id").to_numpy(), queries.column("query_id").to_numpy()
        vectors, wanted = matrix(rows.column("vector")), matrix(queries.column("query"))
        units, unit_queries, bucket = _unit(vectors), _unit(wanted), rows.column("bucket").to_numpy()
        probed = queries.column("probed")
        mask = np.zeros(place_size(index_rows, (2 * padded(vectors.shape[1])) ** 2), bool)
        found: tuple[list, list, list] = ([], [], [])
        for q in range(len(asked)):
            buckets = probed[q].values.to_numpy()
            mask[buckets] = True
            near = np.flatnonzero(mask[bucket] & (ids != asked[q]))
            mask[buckets] = False
            if len(near) > k:
                rough = units[near] @ unit_queries[q]
                near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - SLACK]
            if not len(near):
                continue
            score = cosines(wanted[q], vectors[near])
            order = np.lexsort((ids[near], -score))[:k]
            found[0].append(np.full(len(order), asked[q]))
            found[1].append(ids[near][order])
            found[2].append(score[order])
        if not found[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["query_id", "id", "score"])

    def run(queries: pa.RecordBatch, batches):
        for rows in batches:
            out = found_in(queries, rows)
            if out is not None:
                yield out
    return run


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """In how many blocks of about ``size`` rows each place is dealt."""
    return rows.groupBy("width", "table", "place").agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def nearest_neighbours(queries: DataFrame, rows: DataFrame, k: int = 5, tables: int = TABLES) -> DataFrame:
    """The ``k`` nearest rows by cosine that the tables find for each query: ``query_id, rank, id, score``.

    ``queries`` is ``(query_id, vector)``, ``rows`` is ``(id, vector)``; other columns are ignored.  A query is never found by itself (by equal
    ids).  Equal scores are ranked by the smaller id.  Rows without an id and vectors that are null, empty, zero or hold a component that is null
    or not finite take no part; vectors meet those of their own length only.  Of several rows of one id the one with the least vector counts.
    """
    def valid(df, key):
        df = df.select(F.col(key).cast("bigint").alias(key), F.col("vector").cast("array<double>").alias("vector"))
        df = df.where(F.col(key).isNotNull() & usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
        return one_row_per_id(df, key, "vector")

    queries, rows = written(valid(queries, "query_id"), "ann-queries"), valid(rows, "id")
    indexed = written(seg.top_n(rows, ["vector"], ["id"], k + 1).drop("rank"), "ann-rows")
    n = indexed.count()
    filed = map_batches(indexed, _file_under(tables, n), "id bigint, vector array<double>, width int, table int, place int, bucket int")
    filed = written(filed, "ann-index")
    asked = map_batches(queries, _probes(tables, n), "query_id bigint, query array<double>, width int, table int, place int, probed array<int>")
    asked = written(asked, "ann-probes")

    # One row per place, at most PLACES[1] times the tables, of each vector length.
    place = ["width", "table", "place"]
    counts = written(_blocks(filed, BLOCK_ROWS, "row_blocks").join(_blocks(asked, BLOCK_QUERIES, "query_blocks"), place), "ann-blocks")

    def dealt(df, key, own, other):
        """Each row in one of the blocks of its side, once for every block of the other side."""
        df = df.join(F.broadcast(counts), place).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("row_blocks", "query_blocks")

    left, right = dealt(asked, "query_id", "query_block", "row_block"), dealt(filed, "id", "row_block", "query_block")
    found = meet(left, right, [*place, "query_block", "row_block"], _best(k, n), "query_id bigint, id bigint, score double")
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return seg.top_n(best, ["query_id"], [F.desc("score"), "id"], k).select("query_id", "rank", "id", "score")
