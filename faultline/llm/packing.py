"""Documents packed into sequences of fixed length: best-fit decreasing, certified by lower bounds, with exchange between partitions.

Partitions pack on their own.  Dual feasible functions of the lengths bound the sequences that a partition needs.  One that meets its bound
passes on only its emptiest sequence; one with a gap passes on several for every sequence beyond the bound.  What is passed on is dealt out to
new partitions, sequence by sequence, and packed again; a round keeps its old sequences wherever packing anew would take more.  The rounds end
when one partition holds what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import map_batches, row_slices, written
from faultline.llm.pieces import LOOKUP_BYTES, pieces_of, word_units
from faultline.llm.words import text_bytes

CAPACITY, END_ID = 4096, 1
PARTITION_ROWS = 4_000
STEPS = 12


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as token ids and an end id, cut into pieces of at most ``capacity``: ``id_col, piece, start, length, ids_crc32`` (and ``ids``)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, ids=True)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, stop in row_slices(sizes, LOOKUP_BYTES):
                data, offsets = text_bytes(batch.column(1), first, stop)
                starts, ends = word_units(data, offsets)
                entry = pieces.look_up(data, starts, ends)
                counts = pieces.counts[entry]
                sums = np.concatenate([[0], np.cumsum(counts)])
                of_row = sums[np.searchsorted(starts, offsets)]
                # The entries' ids one after the other: each from its first place on.
                flat = pieces.ids[np.repeat(pieces.first[entry] - sums[:-1], counts) + np.arange(sums[-1])].astype("<u4")
                rows, out = [], []
                for row in range(stop - first):
                    ids = np.append(flat[of_row[row] : of_row[row + 1]], np.array([end_id], "<u4"))
                    for piece, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append(row)
                        out.append((piece, at, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
                piece, at, length, crc, parts = zip(*out)
                columns = [batch.column(0).slice(first, stop - first).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), scan, schema).withColumnRenamed("_id", id_col)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that these lengths need at least: the best of two families of dual feasible functions."""
    if not len(lengths):
        return 0
    held = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    mass = held * np.arange(capacity + 1)
    # Lengths over capacity - e count as a whole sequence, those under e as nothing, the rest as they are.
    e = np.arange(0, capacity // 2 + 1)
    above = held[::-1].cumsum()[::-1]  # lengths of x and more
    upto = mass.cumsum()
    large = np.where(e > 0, above[np.minimum(capacity - e + 1, capacity)], 0)
    middle = upto[np.where(e > 0, capacity - e, capacity)] - np.where(e > 0, upto[np.maximum(e - 1, 0)], 0)
    best = int(np.max(large + -(-middle // capacity)))
    # (k + 1) x rounded down to k-ths, unless it is a whole number.
    x = np.arange(capacity + 1)
    for k in range(1, 41):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        value = np.where(exact, x * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((held * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each length; lengths must descend.  The fullest sequence with room takes the next one."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: some sequence has room r
    used = 0
    out = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = free >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            bin_ = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, bin_ = capacity, used
            used += 1
        out[i] = bin_
        r -= length
        if r:
            if not room[r]:
                free |= 1 << r
            room[r].append(bin_)
    return out


def _pack(rows: pd.DataFrame, capacity: int, step: int, last: bool) -> pd.DataFrame:
    """Pack one partition; ``_open`` tells the rows that go to the next round."""
    rows = rows.sort_values(["length", "_order", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = rows["length"].to_numpy()
    found = best_fit_decreasing(lengths, capacity)
    n = int(found.max()) + 1
    old = rows["sequence_id"].to_numpy()
    if step and len(np.unique(old)) < n:  # the old sequences are whole here: what is exchanged are sequences
        found = np.unique(old, return_inverse=True)[1]
        n = int(found.max()) + 1
    fill = np.bincount(found, weights=lengths, minlength=n).astype(np.int64)
    gap = n - lower_bound(lengths, capacity)
    open_ = np.zeros(n, bool)
    if not last:
        # Of a partition that meets its bound only the emptiest sequence goes on; a gap sends four more for each sequence too many.
        open_[np.argsort(fill, kind="stable")[: 1 + 4 * gap]] = True
        open_[fill == capacity] = False
    rows["sequence_id"] = (np.int64(step) << np.int64(56)) + (rows["_part"].to_numpy(np.int64) << np.int64(28)) + found
    rows["_open"] = open_[found]
    order = np.argsort(found, kind="stable")
    before = np.concatenate([[0], np.cumsum(lengths[order])[:-1]])
    starts = np.concatenate([[0], np.cumsum(fill)[:-1]])
    offset = np.empty(len(rows), np.int64)
    offset[order] = before - starts[found[order]]
    rows["offset"] = offset
    return rows


def _packer(capacity: int, step: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _pack(group, capacity, step, last)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0) to rows with ``id_col, piece, length, ids_crc32``; lengths are 1 to ``capacity``.

    Rows may repeat and ids may be null: each row is placed by itself.  An empty table gives none.
    """
    pool = written(pieces.withColumns({"_order": F.xxhash64(id_col), "sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint"), "_open": F.lit(True)}), "pieces")
    schema = T.StructType([*pool.schema.fields, T.StructField("_part", T.LongType())])
    done = []
    for step in range(STEPS):
        rows = pool.count()
        if not rows:
            break
        parts = -(-rows // partition_rows)
        last = parts == 1 or step == STEPS - 1
        # The first round deals out single rows by their place in the written table, later ones whole sequences.
        key = F.monotonically_increasing_id() if step == 0 else F.xxhash64("sequence_id")

        dealt = pool.withColumn("_part", F.pmod(key, F.lit(parts)).cast("bigint")).groupBy("_part")
        packed = written(dealt.applyInPandas(_packer(capacity, step, last), schema).drop("_part"), f"packed-{step}")
        done.append(packed.where("NOT _open"))
        if last:
            break
        pool = packed.where("_open")
    out = done[0] if done else pool
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("_order", "_open")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Per piece of a document: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).

    A document is its token ids and ``end_id``; a null or empty text is the end id alone.  Only documents longer than ``capacity`` are cut.
    """
    return pack(tokenized_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), capacity, id_col, partition_rows)
