"""Helpers shared by the corpus operators: Arrow chunks, byte views, hashes,
and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import checkpoint_dir

#: Bytes of text that a task turns into arrays at a time.
CHUNK_BYTES = 4 << 20


def lower_ascii(c):
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, so
    a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batches: Iterable[pa.RecordBatch], column: str,
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in ``column`` each, or
    a single row if that row alone is longer."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = _lengths(batch.column(column)).cumsum()
        lo = 0
        while lo < n:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        release()


@functools.cache
def _allocator():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # no glibc
        return lambda spare: 0


def release() -> None:
    """Give memory that a worker holds but doesn't use back to the system: a
    worker outlives its task and would keep the most that any operator took."""
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array and the n + 1 offsets of
    its rows; a null row is empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (shift, xor, multiply), so that close inputs give unrelated values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes up to which a counted table is sent to every task.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit``; without one
    otherwise, so that the join shuffles. Give a written or cheap table."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
