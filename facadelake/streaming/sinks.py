"""Running a stream to its end and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facadelake.operators.hotkeys import latest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state on local disk with checkpointed changes, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def append_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-mode results as Parquet; the sink's log makes each batch count once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def update_files(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Update-mode results, one folder per batch; a repeated batch rewrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Last state of every key."""
    rows = spark.read.parquet(path)
    return latest(rows, keys, ["batch"]).drop("batch")


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fn)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark: SparkSession, root: str, file: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file or folder of files as a stream; the schema is the file's own."""
    schema = spark.read.parquet(f"{root}/{file}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file if file.endswith(".parquet") else "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root if file.endswith(".parquet") else f"{root}/{file}")


def event_time(stream: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))
