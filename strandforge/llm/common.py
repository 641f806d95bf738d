"""Shared pieces: written intermediate tables, bounded Arrow batches, driver-side settings."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from strandforge.sources.shared import fresh_path, shared_dir

if TYPE_CHECKING:
    from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a Python task holds at a time; a single longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes of an Arrow batch that Spark sends to a Python task; one longer row is a batch of its own.
ARROW_BYTES = 8 << 20
#: A key is frequent that holds more than one part in so many of all rows.
HOT_SHARE = 2048


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a stashed table that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if _plain(folder).startswith(_plain(shared_dir(spark))):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _plain(path: str) -> str:
    """A path without its scheme and doubled slashes."""
    return "/" + path.partition(":")[2].lstrip("/") if ":" in path else path


def looked_up(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the other columns of ``groups``, which has one row for each key, nulls where there is none.

    ``weight`` counts the rows of a key. Keys that hold more than one part in HOT_SHARE of all of them are HOT_SHARE at
    most, and are broadcast; the others, none of which is frequent, are joined by a shuffle. Both tables are read twice.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > total
    new = [c for c in groups.columns if c not in keys]
    frequent = groups.where(hot).select(*keys, F.lit(True).alias("__hot"), *new)
    met = rows.join(F.broadcast(frequent), keys, "left")  # HOT_SHARE rows
    rare = met.where("__hot is null").drop("__hot", *new).join(groups.where(~hot), keys, "left")
    return met.where("__hot").drop("__hot").unionByName(rare)


def bound_batches(spark: SparkSession) -> None:
    """Let Spark end an Arrow batch at ARROW_BYTES, if the session allows more: what a task holds is a batch on each side."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """Give freed memory back at a task's end: Spark keeps the worker process, and others beside it, for later tasks."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)
