"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Scratch, saved, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only; every other code point stays."""
    return F.translate(c, UPPER, LOWER)


#: Bytes of an Arrow batch, which the JVM and its Python worker each hold once or more.
BATCH_BYTES = 4 << 20


def bounded(docs: DataFrame) -> DataFrame:
    """The documents, for work in Arrow batches: unless the session says otherwise, a batch is bounded by bytes too, as
    10,000 rows can be any amount of text."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if docs.sparkSession.conf.get(key, None) is None:
        docs.sparkSession.conf.set(key, str(BATCH_BYTES))
    return docs


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in runs of a few rows, so that a task holds the Python objects of these only; at the partition's end
    the worker, which lives on, gives free memory back."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Give memory that is free but kept by allocators back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Keys that are broadcast to pick rows: 16 MB of them. Beyond it the rows are picked by a join.
MOST_IDS = 2_000_000


def rows_of(rows: DataFrame, keys: DataFrame, on: list[str], most: int = MOST_IDS, how: str = "left_semi") -> DataFrame:
    """The rows whose columns `on` are in keys (or are not: how "left_anti"), by a broadcast if keys are few."""
    keys = keys.select(*on)
    return rows.join(F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys, on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x
