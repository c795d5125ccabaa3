"""Contiguous shards of near equal bytes: global prefix sums from per-partition totals.

Rows are range-partitioned by doc_id (null first; equal ids by checksum and size). Each partition's
bytes and rows are totalled, the totals summed up to offsets, and offset plus the running sum within
the partition is a row's place among all bytes. The shard is the equal cut that holds its middle.
A null text has no bytes (size 1: the separator). Repeated rows each get a slot. Only ids, sizes and
checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 8


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-sizes")
    keys = ["doc_id", "text_crc32", "size"]
    rows = written(rows.repartitionByRange(*keys).withColumn("pid", F.spark_partition_id()), "shard-ranges")
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = rows.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = totals.select("pid", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("rows_ahead"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    totals = written(totals, "shard-totals")
    within = Window.partitionBy("pid").orderBy(*keys)
    rows = rows.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(within))
    rows = rows.join(totals, "pid")
    twice_middle = 2 * (F.col("bytes_ahead") + F.col("upto")) - F.col("size")
    cut = F.floor(twice_middle.cast("double") * shards / (2.0 * F.col("all_bytes"))).cast("int")
    rows = written(rows.select(*keys, F.least(F.lit(shards - 1), cut).alias("shard"), (F.col("rows_ahead") + F.col("at")).alias("at")), "shard-cut")
    first = written(rows.groupBy("shard").agg(F.min("at").alias("first")), "shard-first")
    return rows.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
