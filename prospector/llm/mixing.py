"""Mix sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospector.llm.common import cut, table, word_count

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input, and uses of one document at most.
SHARE, REPEATS = 1.5, 2
#: Rows that one bucket of a running sum takes on average.
BUCKET_ROWS = 20_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Target of each source from (source, source_size), one row a source.

    Source k in code-point order, null last, weighs weights[k mod len]. With level L a source gets min(weight * L, repeats * size),
    and L is set so that all of them sum to share * all sizes: what sources above their limit leave is shared again by weight.
    Sorted by limit / weight, the sources at their limit come first, so L follows from running sums.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    # one row a source; these windows see no documents
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    lim = ranked.withColumn("limit", F.col("source_size") * repeats).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    lim = lim.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    everything = Window.partitionBy()
    lim = lim.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(everything))
    lim = lim.withColumn("here", (F.col("budget") - F.col("full")) / (F.col("all_weight") - F.col("gone")))
    lim = lim.withColumn("level", F.min(F.when(F.col("here") <= F.col("ratio"), F.struct("ratio", "k", "here"))).over(everything)["here"])
    target = F.when(F.col("level").isNull() | (F.col("weight") * F.col("level") >= F.col("limit")), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return lim.select("source", "source_size", target.cast("double").alias("target"), "budget")


def running(df: DataFrame, keys: list[str], bucket: str, order: list, size: str) -> DataFrame:
    """`size` summed up to each row by (bucket, order) for each of keys, as column upto.

    A total per bucket, a running sum of those totals, and a window inside each bucket: a hot key is split over its buckets.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_b"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_b").over(w), F.lit(0).cast("long"))).drop("_b")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.withColumn("_in", F.sum(size).over(inner))
    same = [joined[k].eqNullSafe(totals[k]) for k in keys] + [joined[bucket] == totals[bucket]]
    return joined.join(totals.hint("shuffle_hash"), same).select(*[joined[c] for c in df.columns], (F.col("_before") + F.col("_in")).alias("upto"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each row of docs (doc_id, source, text).

    Every source queues its documents in an order shuffled by md5(id), `repeats` rounds one after another. A document's virtual
    finish time is the words that its source has queued up to it, divided by the source's target. All queues are merged by finish
    time, and the merged queue ends where its words would pass the budget. Documents are taken whole, so a source misses its target
    by about one document. Null text and texts of no words: size 0, not taken. Null source: a source of its own, last. Repeated rows
    queue one by one. Ties: source, round, md5, id. No rows: none. Returns (doc_id, source, size, source_size, target, taken, times).
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), *carry)
    rows = cut(rows.withColumn("uid", F.monotonically_increasing_id()))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sizes, weights, share, repeats))  # one row a source
    n, budget = rows.count(), goal.agg(F.max("budget")).first()[0] or 0.0
    buckets = max(256, n // BUCKET_ROWS)
    # md5 is even over its first 8 hex digits, which cut each source into buckets
    rows = rows.withColumn("b", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets).cast("long"))
    queued = running(rows, ["source"], "b", ["h", "doc_id", "uid"], "size").drop("b")
    g = F.broadcast(goal.drop("budget")) if goal.count() <= 100_000 else goal
    queued = queued.join(g, queued["source"].eqNullSafe(g["source"])).drop(g["source"])
    rounds = queued.where("size > 0 AND target > 0").withColumn("round", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    rounds = rounds.select("uid", "source", "h", "doc_id", "size", "round", ((F.col("source_size") * F.col("round") + F.col("upto")) / F.col("target")).alias("vft"))
    # every source fills its target over finish times 0 to 1, so equal steps of it hold equal words
    rounds = rounds.withColumn("b", F.floor(F.col("vft") * buckets).cast("long")).withColumn("one", F.lit(1))
    merged = running(rounds, ["one"], "b", ["vft", "source", "round", "h", "doc_id", "uid"], "size")
    taken = merged.where(F.col("upto") <= F.lit(budget)).groupBy("uid").agg(F.count("*").cast("int").alias("times"))
    out = queued.join(taken, "uid", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times", *carry)


def op5(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rules in one statement, for small tables; all windows run over whole tables.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
             CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS wt, 2 * ss AS lim, CAST(2 * ss AS DOUBLE) / [5, 2, 1][k % 3 + 1] AS ratio FROM s),
v AS (SELECT *, (CAST(sum(ss) OVER () AS DOUBLE) * 1.5 - coalesce(sum(lim) OVER p, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER p, 0)) AS here
      FROM w WINDOW p AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, first_value(CASE WHEN here <= ratio THEN here END IGNORE NULLS) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev, sum(ss) OVER () * 1.5 AS budget FROM v),
t AS (SELECT source, ss, budget, CASE WHEN lev IS NULL OR wt * lev >= lim THEN CAST(lim AS DOUBLE) ELSE wt * lev END AS target FROM l),
q AS (SELECT d.*, t.ss, t.target, t.budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT q.*, g.r AS rnd, CAST(ss * g.r + upto AS DOUBLE) / target AS vft FROM q, (VALUES (0), (1)) g(r) WHERE size > 0 AND target > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY vft, source, rnd, h, doc_id ROWS UNBOUNDED PRECEDING) AS all_upto FROM r),
k AS (SELECT doc_id, sum(size) AS taken FROM m WHERE all_upto <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, CAST(q.ss AS BIGINT) AS source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""
