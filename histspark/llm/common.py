"""Shared helpers of the training-data operators: shared tables, row keys, batching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from histspark.session import shared_dir, with_package

#: Rows and bytes of one Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 500, 64 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Set the session options the operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return with_package(spark)


#: Spark removes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[list[str]]:
    """The paths ``stored`` writes inside, in order; ``drop`` removes those that nothing reads any more. What is left in
    the list joins that of an outer one."""
    outer, mine = _tables.get(), []
    token = _tables.set(mine)
    try:
        yield mine
    finally:
        _tables.reset(token)
        if outer is not None:
            outer += mine


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove stored tables."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends, since its table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _tables.get()) is not None:
        mine.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another Arrow batch size for what is executed inside, e.g. where most rows are a few numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_of(col: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_key() -> tuple[Column, Column]:
    """Two 64-bit words that are equal only for rows of equal doc_id and text (repeated rows share them)."""
    return (
        F.xxhash64(F.col("doc_id"), text_of()).alias("_k1"),
        F.xxhash64(text_of(), F.col("doc_id"), F.lit(1)).alias("_k2"),
    )


def total_bytes(df: DataFrame, col: str = "text") -> int:
    """Sum of the UTF-8 bytes of a column."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def byte_chunks(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``limit``; a longer row stands alone."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    size = int(at[-1])
    flat = np.frombuffer(data, dtype=np.uint8, count=size) if data is not None and size else np.zeros(0, np.uint8)
    return flat[int(at[0]) : size], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
