"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.llm.common import before, shuffle_parts, text_crc32
from sievelight.session import written


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put ``doc_id, text`` into shards that are ranges of doc_id with nearly equal sizes.

    A document's size is its UTF-8 bytes plus 1. The texts are read once, where they lie; only ids,
    sizes and checksums move, into doc_id ranges. Totals per range (one row each) are summed up to
    global offsets. A document goes to the shard in which the middle of its bytes falls, so a shard
    misses its target by at most the two documents at its ends.

    Null texts have size 1. Rows with equal or null doc_ids (first in order) stay apart; those with
    equal text too are interchangeable. An empty table gives no rows.

    Columns: ``doc_id, size, text_crc32, shard, slot`` with slots gapless from 0.
    """
    narrow = written(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
            text_crc32(F.col("text").cast("string")).alias("text_crc32"),
        ),
        "sizes",
    )
    order = ["doc_id", "text_crc32", "size"]
    ranges = narrow.repartitionByRange(shuffle_parts(docs.sparkSession), *order)
    rows = written(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("part").agg(F.sum("size").alias("_size"), F.count("*").alias("_rows"))
    offsets = before(before(totals, "part", "_size", "_bytes_before"), "part", "_rows", "_rows_before")
    offsets = offsets.withColumn("_all", F.sum("_size").over(W.partitionBy(F.lit(0))))
    own = W.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("_n", F.row_number().over(own))
        .withColumn("_to", F.sum("size").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .join(F.broadcast(offsets.drop("_size", "_rows")), "part")
    )
    middle = 2 * (F.col("_bytes_before") + F.col("_to")) - F.col("size")  # twice, to stay whole
    placed = placed.withColumn("_middle", middle).select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("_rows_before") + F.col("_n") - 1).alias("_row"),
        F.expr(f"cast(_middle * {shards} div (2 * _all) as int)").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    # One row per shard.
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )
