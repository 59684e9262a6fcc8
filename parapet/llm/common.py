"""What several operators share: tables in the shared folder, and Arrow helpers for tasks."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from parapet.sources.session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; Hadoop removes it when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read back: later steps survive lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discarded(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column, nulls as empty values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a column of texts holds about ``most`` bytes at once (one row at least).

    What Arrow has freed goes back to the system after each batch: workers live on, and the executor has no other use of it.
    """
    for batch in batches:
        sizes = np.asarray([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()], np.int64) \
            if batch.num_rows < 64 else _sizes(batch.column(column))
        start = 0
        ends = np.cumsum(sizes)
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def _sizes(column: pa.Array) -> np.ndarray:
    return np.diff(buffers(column)[0])


def nested(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays as a list column."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now, not when the driver next happens to collect garbage.

    Python lets go of its handles first; Spark's cleaner then works on what the JVM found unused, in its own thread.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1.0)


def one_text(rows: DataFrame) -> DataFrame:
    """One row per ``doc_id``: of several texts the one with the least hash. Bounds a sample of ids in rows as well.

    All columns but ``doc_id`` and ``text`` must agree within an id. Combined before the shuffle, so an id with very many
    rows costs one a task.
    """
    return rows.groupBy(*[c for c in rows.columns if c != "text"]).agg(
        F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).withColumn("text", F.col("least.text")).drop("least")


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so (in any case)."""
    lower, found = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in lower:
            name += "_"
        found.append(name)
    return found
