"""Run the batch loads on every micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from keelstone.plans.load import LoadOptions, load


def for_each_batch(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame], object]
) -> DataStreamWriter:
    """A writer that hands each micro-batch to ``step``; start it with the trigger you need.

    A batch may be delivered again after a failure: ``step`` should be idempotent, as the
    merges and dimension loads of this package are.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _batch_id: step(batch)
    )


def load_stream(
    stream: DataFrame, path: str, schema: T.StructType | str, options: LoadOptions, checkpoint: str
) -> DataStreamWriter:
    """Load a stream of source rows into a committed table, one commit per micro-batch."""
    return for_each_batch(stream, checkpoint, lambda batch: load(batch, path, schema, options))
