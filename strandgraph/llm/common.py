"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side joins by broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows of an Arrow batch: texts may be long, and a batch is held several times over on its way.
BATCH_ROWS = 1_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to ``BATCH_ROWS`` rows if they may be larger."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return what a task has freed to the system: workers are used again, and what one stage leaves adds to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of ``rows`` rows for what is run inside, and the session's own again after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored, narrow ``right``: by broadcast if its counted rows allow it, else by shuffle.

    The rows of ``right`` are counted from the footers of its files. Keys that
    may be null must be made comparable by the caller. Beyond ``limit`` the join
    shuffles both sides and adaptive execution splits its hot keys.
    """
    small = right.count() <= limit
    return left.join(F.broadcast(right) if small else right, list(keys), how)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
