"""Contiguous shards of near equal bytes, by prefix sums over partitions.

Rows are dealt to key ranges and the dealing is frozen by a checkpoint of the key, the
size and the checksum, never of the texts. Each range's total gives the bytes and rows
before it; a running sum inside the range gives them before each row. A row belongs to the
shard that the middle of its bytes falls into, so cuts are at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstone.llm.batches import keyed, parallelism
from keelstone.session import cut_lineage


def with_offsets(rows: DataFrame, size: str, order: list[str], ranges: int) -> DataFrame:
    """Adds ``row_at`` and ``byte_at``, rows and bytes before each row in the global order, and
    ``all_bytes``.

    Equal rows are interchangeable; rows with the same leading key stay in one range. The
    ranges' totals, one row each, are all that meets in one place.
    """
    dealt = cut_lineage(
        rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    )
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_byte1", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn("_row1", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
        .join(F.broadcast(starts), "_range")
        .withColumn("byte_at", F.col("_byte0") + F.col("_byte1"))
        .withColumn("row_at", F.col("_row0") + F.col("_row1"))
        .drop("_range", "_byte0", "_byte1", "_row0", "_row1")
    )


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", ranges: int | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus 1. Shards are contiguous in the order of the key
    (nulls first); no shard differs from the equal target by more than the largest row.
    ``slot`` counts a shard's rows from 0. A null text has size 1 and the checksum of no
    bytes; repeated rows take consecutive slots; an empty table gives no rows. Other columns
    are ignored. The law is ``bytes``: ``grown_shard`` is null.
    """
    spark = docs.sparkSession
    plain = keyed(docs, key, text)
    rows = plain.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(text, "utf-8"), F.lit(b""))).alias("text_crc32"),
    )
    placed = with_offsets(rows, "size", [key, "text_crc32", "size"], ranges or parallelism(spark))
    middle = (2 * F.col("byte_at") + F.col("size")) * shards
    cut = placed.withColumn(
        "shard", F.least(F.floor(middle / (2 * F.col("all_bytes"))), F.lit(shards - 1)).cast("int")
    )
    firsts = cut.groupBy("shard").agg(F.min("row_at").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
