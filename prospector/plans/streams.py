"""Queries that run as streams over the shared tables until all that is there is read, beside the SQL of the tables they leave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prospector.operators import graph
from prospector.plans.catalog import DECISIONS, C, decided, decisions, load, query
from prospector.streaming import latest, progress

LATEST = f"WITH {DECISIONS} SELECT repository, item, run, max(seq) AS seq, arg_max(prediction, seq) AS prediction FROM dec GROUP BY ALL"
KEYS = ["repository", "item", "run"]


def followed(spark, d, log, initial=None):
    """The latest record of each key after the stream has read all files of events."""
    at = f"{graph.shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    columns = [*KEYS, "seq", "prediction"]
    rows = latest.latest_rows(log.select(*columns), KEYS, initial=initial.select(*columns) if initial is not None else None)
    latest.run_now(rows, f"{at}/table", f"{at}/checkpoint")
    return latest.current(spark, f"{at}/table", KEYS).select(*columns)


@query(LATEST)
def streamed_latest(spark, d):
    """The log's latest labels from state, in place of a window over the whole log."""
    return followed(spark, d, decided(latest.file_log(spark, f"{d}/events.parquet")))


@query(f"WITH {DECISIONS}, k AS (SELECT repository, item, run, max(seq) AS seq, arg_max(prediction, seq) AS prediction, max(seq) FILTER (seq % 2 = 0) AS known FROM dec GROUP BY ALL) SELECT repository, item, run, seq, prediction FROM k WHERE known IS NULL OR seq > known")
def streamed_news(spark, d):
    """What the records of odd number change in a table of the others, which the stream begins with."""
    log = decided(latest.file_log(spark, f"{d}/events.parquet")).where(C("seq") % 2 == 1)
    return followed(spark, d, log, decisions(spark, d).where(C("seq") % 2 == 0))


@query("""WITH e AS (SELECT event_type AS stage, CAST(ts AS TIMESTAMP) AS t, CAST(1 AS BIGINT) AS n, CASE WHEN event_type <> 'view' THEN count(*) OVER (PARTITION BY event_type) + 100 END AS total FROM events),
  s AS (SELECT stage, count(*) AS done, any_value(total) AS total, (epoch_us(max(t)) - epoch_us(min(t))) / 1e6 AS seconds FROM e GROUP BY stage), r AS (SELECT *, CASE WHEN seconds > 0 THEN done / seconds END AS rate FROM s)
  SELECT stage, done, total, round(rate, 9) AS rate, round(CASE WHEN done < total THEN (total - done) / rate END, 6) AS left_s FROM r""")
def stage_standing(spark, d):
    """Kinds of events as stages: how far each is, at what pace, and what is left where a total is known."""
    e = load(spark, d, "events").select(C("event_type").alias("stage"), C("ts").cast("timestamp").alias("at"), F.lit(1).cast("long").alias("rows"))
    total = e.groupBy("stage").agg((F.count("*") + 100).alias("total")).where("stage <> 'view'")
    out = progress.standing(e.join(total, "stage", "left"))
    return out.select("stage", "done", "total", F.round("rate", 9).alias("rate"), F.round("left_s", 6).alias("left_s"))
