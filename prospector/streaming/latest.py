"""An append-only log as a stream: the latest record of each key in state, told from late ones, dropped after a time without news."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What became of a record: a key's first, a later one, one that is older than what is known, and a key that was dropped.
NEW, CHANGED, LATE, DROPPED = "new", "changed", "late", "dropped"


class Latest(StatefulProcessor):
    """Holds one record a key, that of the highest seq; of equal ones the first stays."""

    def __init__(self, schema: StructType, seq: str, at: str | None, ttl_ms: int | None):
        self.schema, self.seq, self.at, self.ttl_ms = schema, schema.fieldNames().index(seq), at and schema.fieldNames().index(at), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("latest", self.schema)

    def told(self, record: tuple, outcome: str) -> Row:
        return Row(**dict(zip(self.schema.fieldNames(), record, strict=True)), outcome=outcome)

    def keep(self, record: tuple) -> None:
        """Hold a record, and let its timer be the key's only one."""
        self.held.update(record)
        if self.ttl_ms is not None and record[self.at] is not None:
            for other in list(self.handle.listTimers()):
                self.handle.deleteTimer(other)
            self.handle.registerTimer(int(record[self.at].timestamp() * 1000) + self.ttl_ms)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        known = self.held.get()  # null where there is none
        if known is None or initialState[self.seq] > known[self.seq]:
            self.keep(tuple(initialState))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, best = self.held.get(), None
        for row in rows:
            record = tuple(row)
            low, best = (best, record) if best is None or record[self.seq] > best[self.seq] else (record, best)
            if low is not None:
                yield self.told(low, LATE)
        if known is not None and best[self.seq] <= known[self.seq]:
            yield self.told(best, LATE)
            return
        self.keep(best)
        yield self.told(best, NEW if known is None else CHANGED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            record = tuple(self.held.get())
            self.held.clear()
            yield self.told(record, DROPPED)

    def close(self) -> None:
        pass


def newest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the highest seq of each key, so that state is asked for once a key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), seq).alias("_r")).select("_r.*")


def latest_rows(log: DataFrame, keys: list[str], seq: str = "seq", at: str | None = None, late: str = "0 seconds", ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The columns of a streamed log and `outcome`: the latest record of a key as new or changed, every other one as late.

    Of the records of one batch only the latest changes anything. ttl_ms: a key is dropped once event time, `late` behind the newest `at`,
    is that much past the key's record; its next record is new. initial: records known before the stream, of the same columns; the latest
    of each key counts. Rows need a seq. State is one record a key, whatever the log's length; keys are dealt out by their hash.
    """
    if ttl_ms is not None and at is None:
        raise ValueError("dropping keys takes the time column")
    names = log.columns
    out = StructType([*log.schema.fields, StructField("outcome", StringType())])
    rows = log.withWatermark(at, late) if at and ttl_ms is not None else log
    known = newest(initial.select(*names), keys, seq).groupBy(*keys) if initial is not None else None
    return rows.groupBy(*keys).transformWithState(
        statefulProcessor=Latest(StructType([StructField(f.name, f.dataType) for f in log.schema.fields]), seq, at, ttl_ms), outputStructType=out, outputMode="Update",
        timeMode="EventTime" if ttl_ms is not None else "None", initialState=known,
    )


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, as this kind of state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_now(rows: DataFrame, table: str, checkpoint: str) -> None:
    """Take in what is there and stop. A batch is written to a folder of its number, so one that is done again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    with rocksdb(rows.sparkSession):
        query = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def current(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The latest record of each key from the table that run_now() writes; a key that was dropped is gone until its next record."""
    rows = spark.read.option("basePath", table).parquet(table).where(F.col("outcome") != LATE)
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"), F.desc(F.col("outcome") == DROPPED))
    return rows.withColumn("_k", F.row_number().over(last)).where((F.col("_k") == 1) & (F.col("outcome") != DROPPED)).drop("_k", "outcome", "batch")


def file_log(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a table's files, so many a batch; path may be one file or a folder of them."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")
