"""Vectors for the operators on embeddings: valid rows, pseudo-rotations, and blocks of two tables that meet in sorted streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches

#: Bytes of the streaming side that meet the held rows at once.
STREAM_BYTES = 8 << 20


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def one_row_per_id(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of rows that share a key, the one of the least ``columns``; summed up before the exchange, so a repeated row is no hot key."""
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row")).select(key, "_row.*")


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths without nulls as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0).astype(dtype, copy=False)


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row (a power of two wide), scaled to keep lengths."""
    n, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(n, width // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return rows / np.sqrt(width)


def padded(width: int) -> int:
    """The next power of two."""
    return 1 << max(0, width - 1).bit_length()


class PseudoRotation:
    """Three times random signs and a Hadamard transform, by the number of the table and the width alone."""

    def __init__(self, width: int, seed: int):
        self.size = padded(width)
        self.signs = np.random.default_rng([width, seed]).choice([-1.0, 1.0], (3, self.size))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.size))
        out[:, :rows.shape[1]] = rows
        for signs in self.signs:
            out = hadamard(out * signs)
        return out


def by_width(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(lengths):
        part = batch if (lengths == width).all() else batch.filter(pa.array(lengths == width))
        yield int(width), part


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str], function: Callable, schema: str) -> DataFrame:
    """Every row of ``left`` meets every row of ``right`` with equal keys, in sorted streams.

    ``function(held, batches)`` gets the rows of one key of ``left`` and an iterator over those of ``right``, and yields record batches.  The rows
    of a key of ``left`` are held in memory, so the caller deals them into blocks; those of ``right`` stream past.
    """
    keys, names = list(keys), (left.columns, right.columns)
    extra = [[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in one.columns] for one, other in ((left, right), (right, left))]
    both = left.select("*", *extra[0], F.lit(0).alias("_side")).unionByName(right.select("*", *extra[1], F.lit(1).alias("_side")))
    both = both.repartition(*keys).sortWithinPartitions(*keys, "_side")

    def runs(batches):
        """(key, side, rows) of each stretch of equal ones."""
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "_side")]
            change = np.zeros(batch.num_rows, bool)
            for column in columns:
                change[1:] |= column[1:] != column[:-1]
            bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else [0]
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                side = int(columns[-1][start])
                yield tuple(c[start] for c in columns[:-1]), side, batch.slice(start, stop - start).select(names[side])

    def one(parts):
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def large(parts):
        waiting, size = [], 0
        for part in parts:
            waiting.append(part)
            size += part.nbytes
            if size >= STREAM_BYTES:
                yield one(waiting)
                waiting, size = [], 0
        if waiting:
            yield one(waiting)

    def run(batches):
        for _, group in groupby(runs(batches), key=itemgetter(0)):
            held, first = [], []
            for _, side, part in group:
                if side:
                    first = [part]
                    break
                held.append(part)
            if held and first:
                yield from function(one(held), large(chain(first, (part for _, _, part in group))))

    return map_batches(both, run, schema)
