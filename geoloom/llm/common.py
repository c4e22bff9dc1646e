"""Shared plumbing: the shared folder, written intermediate tables, file access
from executors, and text cutting that several operators rely on."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.storage import discard, materialise, new_folder, open_fs  # noqa: F401


def compressed(df: DataFrame, label: str, level: int = 3, page_bytes: int = 1 << 20) -> DataFrame:
    """``materialise`` with Zstandard pages, for large tables."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps.

    It does so when the driver's JVM collects their plans, which an idle heap may
    put off until executors' disks are full.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on from stage to stage, and what it has freed counts as its own."""
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def crc_of_id(column: str) -> Column:
    """Unsigned crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_groups(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` characters in all."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
