"""Arrow helpers shared by the operators: bounded slices, byte views, scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.session import scratch_path

#: Text bytes that one step of numpy work takes at once; one longer text makes its own step.
#: A step holds some fifty bytes for each, so this bounds what a worker needs.
SLICE_BYTES = 1 << 20
#: Text bytes after which a worker gives freed memory back to the machine.
TIDY_BYTES = 8 << 20


def texts_of(array: pa.Array) -> pa.LargeStringArray:
    """Nulls become empty texts; offsets are 64 bit."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_string()).fill_null("")


def byte_view(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an array, and their ``len + 1`` offsets into these."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in slices of at most ``limit`` bytes of a column."""
    done = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            done += int(ends[to] - ends[at])
            at = to
            if done > TIDY_BYTES:
                tidy()
                done = 0


def tidy() -> None:
    """Give freed memory back: a worker serves many tasks, beside others of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0] .. starts[0] + counts[0] - 1, starts[1] ..`` as one index array."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts.astype(np.int64) - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(total, dtype=np.int64)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator works on: others, whatever their names, cannot clash."""
    return docs.select(*[F.col(f"`{c}`").alias(c) for c in columns])


def parallelism(spark: SparkSession) -> int:
    """Tasks of a shuffle, as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read back: they survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
