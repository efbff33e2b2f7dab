"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospector.llm.common import cut, table

#: Bytes that a document counts besides its text.
OVERHEAD = 16


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of `shards` contiguous shards of near-equal bytes.

    Rows are laid out by (text hash, crc, id, null first), so equal texts lie together. Ranges of that order are dealt to partitions;
    only a total per partition reaches the driver, which adds them up to offsets; a window inside each partition does the rest. A row
    goes to shard k if it begins at byte k * total / shards or later, and before that of k + 1. Groups of equal texts are cut like other
    rows. Null text: size 16, crc32 0, hash of the empty text. Null ids, repeated rows and ids are rows like others. A text longer
    than a shard takes the shards it covers, which stay empty but for its own. No rows: no shards. Other columns are not looked at.
    Returns (id, size, text_crc32, text_hash, shard, slot); slot counts from 0 in each shard without gaps.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    order = ["text_hash", "text_crc32", id_col]
    rows = cut(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("part").collect()
    at, count, offsets = 0, 0, []
    for p in parts:
        offsets.append((p["part"], at, count))
        at, count = at + p["b"], count + p["n"]
    total = at
    base = F.broadcast(spark.createDataFrame(offsets, "part int, byte0 long, row0 long"))  # one row per partition
    w = Window.partitionBy("part").orderBy(*order)
    start = F.col("byte0") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.join(base, "part").select(id_col, "size", "text_crc32", "text_hash", start.alias("start"), (F.col("row0") + F.row_number().over(w) - 1).alias("pos"))
    number = F.lit(0)
    for k in range(1, shards):
        number = number + (F.col("start") >= F.lit(total * k // shards)).cast("int")
    placed = placed.withColumn("shard", number)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("pos").alias("first")))  # one row per shard
    return placed.join(first, "shard").select(id_col, "size", "text_crc32", "text_hash", "shard", (F.col("pos") - F.col("first")).alias("slot"))


def op2(spark, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
