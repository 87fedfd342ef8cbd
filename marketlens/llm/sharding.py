"""Contiguous shards of equal bytes, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.tables import durable, no_null


def shard_by_bytes(documents: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous ranges of nearly equal bytes.

    Rows are ordered by (key, crc32 of the text, size). Each range partition of that order gives
    one total; the totals' running sum is every partition's offset, and a running sum inside the
    partition gives each row its place in the whole. The cuts lie at equal byte targets and a row
    belongs to the shard that holds its middle byte, so a shard misses its target by half a row
    at each end at most.

    Returns ``key, size, text_crc32, law, shard, slot, grown_shard``: size is the UTF-8 length
    plus 1; a null text has no bytes, size 1 and crc 0; ``slot`` counts from 0 in each shard;
    ``grown_shard`` is null, for this law moves rows when the number of shards changes. Rows that
    are equal in key and text keep one slot each. A null key sorts first. Other columns are not
    read, so their names don't matter. An empty table gives no rows. Rows share a shard with their
    copies only where they are neighbours in the order.
    """
    spark = documents.sparkSession
    body = no_null(text)
    narrow = documents.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        narrow.repartitionByRange(parts, "key", "crc", "size").withColumn("part", F.spark_partition_id())
    )
    # one row per range partition, so the unpartitioned window and the broadcast are bounded
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("key", "crc", "size")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("rank", F.row_number().over(inside))
        .withColumn("through", F.sum("size").over(so_far))
        .join(F.broadcast(offsets), "part")
        .select(
            "key", "size", "crc",
            (F.col("rows_before") + F.col("rank")).alias("rank"),
            F.expr(
                f"cast(least({shards - 1}, (2 * (bytes_before + through) - size) * {shards} "
                "div (2 * all_bytes)) as int)"
            ).alias("shard"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
