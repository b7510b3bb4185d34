"""Contiguous shards of near equal bytes, in DataFrame operations only.

Rows are put in order of their id over range partitions. Each partition's total of bytes and rows gives, by one prefix sum over
the partitions, where the partition starts in the whole; within a partition a running sum gives where each row starts. The whole is cut
at equal targets: a row goes to the shard in which its first byte lies, so a shard's size is off by less than two rows.

Defined results: a row's size is the bytes of its text plus 1; a null text has no bytes (CRC-32 of nothing: 0); ids that repeat, and
null ids (which come first), are ordered by CRC-32 and size, and rows equal in all three are alike, whichever comes first; an empty table
gives an empty table. The result has none of the input's other columns, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def shard_by_bytes(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for each row."""
    spark = df.sparkSession
    slim = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the part numbers below must not change between the two reads.
    ranged = materialize(slim.repartitionByRange(parts, "key", "crc", "size").withColumn("part", F.spark_partition_id()), "shards")

    # One row for each of `parts` partitions, whatever the number of rows: a window over them and a broadcast of them are bounded.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    own = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "crc", "size")
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select(
        "*",
        (F.sum("size").over(running) - F.col("size")).alias("byte"),
        (F.row_number().over(own) - 1).cast("long").alias("row"),
    ).join(F.broadcast(starts), "part")
    placed = placed.select(
        "key", "size", "crc",
        F.expr(f"cast(((byte0 + byte) * {int(shards)}) div total as int)").alias("shard"),
        (F.col("row0") + F.col("row")).alias("at"),
    )
    # One row a shard.
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
