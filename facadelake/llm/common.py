"""Shared helpers of the subpackage: tables, written intermediates, Arrow batches cut by size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from facadelake.session import work_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# A batch is handed to numpy in pieces of about this many bytes of text, one text at least.
PIECE_BYTES = (1 << 20) - 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    # The step's shuffle files, as large as its input, go with it; else the next step's would come on top of them.
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def as_binary(texts: pa.Array) -> pa.Array:
    """Bytes of a string or binary column with nulls as empty, offsets 64 bit."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    return pc.fill_null(texts.cast(pa.large_binary()), b"")


def flat(texts: pa.Array) -> tuple:
    """Bytes of all texts after each other, and the offsets of the texts in them."""
    import numpy as np

    texts = as_binary(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in the same order, in pieces of at most ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)
