"""What several of the operators need: tables, Arrow batches and types."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tessera.functions.storage import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trim() -> None:
    """Give freed memory back to the system, so that a worker that is used again starts small; where the C library can't, nothing happens."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back after every few batches and at the end of the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(run(batches)):
            yield batch
            if i % 8 == 7:
                _trim()
        _trim()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes at most; a longer row is a batch of its own."""
    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


#: Rows of one number each that may be broadcast (some 30 MB as a hash table).
BROADCAST = 1 << 19


def bounded(rows: DataFrame, most: int = BROADCAST) -> DataFrame:
    """``rows``, a written table (of one number in each row, unless ``most`` is given), with a broadcast hint if it has few enough; else the join shuffles."""
    return F.broadcast(rows) if rows.count() <= most else rows


def kind(ddl: str) -> DataType:
    """The type that ``ddl`` names."""
    return StructType.fromDDL(f"x {ddl}")["x"].dataType
