"""Helpers shared by the operators: tables in the shared folder, normal forms, folder names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts the lineage, survives lost executors, has known sizes."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of texts that reach a Python worker at once, at most: long texts then don't pile up in its memory.
BATCH_ROWS = 1_000


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_ROWS rows (a setting of the session, lowered where it is higher)."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH_ROWS:
        df.sparkSession.conf.set(setting, BATCH_ROWS)
    return df.mapInArrow(function, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all else as it is.  Texts without other letters take the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_slices(sizes, limit: int):
    """(start, stop) ranges of rows that hold about ``limit`` bytes each; one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; the package with the files is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
