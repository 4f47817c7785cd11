"""Token counts of documents without their ids.

Every block of documents is cut into pre-tokens; the pieces of each distinct one are counted once, joined to the pre-tokens of each document
and summed.  The join stays in the task that reads the block: shuffling a row per document and pre-token would move more than the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import map_batches, row_slices
from faultline.llm.pieces import LOOKUP_BYTES, pieces_of, spaced_units
from faultline.llm.words import text_bytes


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` as the byte-level tokenizer at ``path`` gives them, ``over_limit``.

    Null texts are empty and have no tokens.  Special strings inside a text count as the tokenizer's library does by default.  Rows may
    repeat, ids may be null; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path, ids=False)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for start, stop in row_slices(sizes, LOOKUP_BYTES):
                data, offsets = text_bytes(batch.column(1), start, stop)
                sums = np.zeros(1, np.int64)
                first = np.zeros(len(offsets), np.int64)
                if len(data):
                    starts, ends = spaced_units(data, offsets)
                    entry = pieces.look_up(data, starts, ends)
                    sums = np.concatenate([[0], np.cumsum(pieces.counts[entry])])
                    first = np.searchsorted(starts, offsets)
                n = sums[first[1:]] - sums[first[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), count, f"_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("_id", id_col)
