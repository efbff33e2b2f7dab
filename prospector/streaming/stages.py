"""Structured Streaming: stateless stages, windowed status with late data, and idempotent keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.operators import logs


def windowed_status(events: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts by window and kind; rows later than `late` behind the newest are dropped by a stream, and none by a batch."""
    out = events.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), by, "n", "total")


def first_of_key(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key's first row within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def keyed_sink(path: str, keys: list[str], seq: str):
    """A foreachBatch writer: rows of keys that the table lacks are added, so a batch written twice changes nothing.

    The batch number names the folder, so a repeated batch overwrites its own files.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = logs.earliest(batch, keys, seq)
        try:
            old = spark.read.option("basePath", path).parquet(path).where(F.col("batch") != number).select(*keys)
            new = new.join(old, keys, "left_anti")
        except Exception as none:  # no table yet
            if "PATH_NOT_FOUND" not in str(none) and "UNABLE_TO_INFER_SCHEMA" not in str(none):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
