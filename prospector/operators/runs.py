"""Runs of the two model stages: folds of chunks, budgets, resumption, and figures about a run."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prospector.functions.calls import usage_cost, usage_tokens
from prospector.functions.diffs import extension
from prospector.functions.text import ends_with

RESULT = "key string, config string, verdict string, tokens long, cost double, error string"
RESULT_NAMES, RESULT_ARROW = ["key", "config", "verdict", "tokens", "cost", "error"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]


def fold_chunks(chunks: DataFrame, *key: str) -> DataFrame:
    """Chunks (index, status, verdict, retryable, latency_ms, tokens, cache_hit) to one decision a key.

    One YES decides, partly valid if a chunk failed; NO takes all chunks valid; else there is no verdict, and a backend error
    outweighs a malformed answer. Unknown tokens stay unknown only if all are.
    """
    ok = F.col("status") == "valid"
    a = chunks.groupBy(*key).agg(
        F.count("*").alias("chunks"), F.count_if(ok).alias("valid"), F.count_if(ok & (F.col("verdict") == "YES")).alias("yes"), F.count_if(F.col("status") == "backend_error").alias("broken"),
        F.coalesce(F.bool_or(~ok & F.col("retryable")), F.lit(False)).alias("retryable"), F.sum("latency_ms").alias("latency_ms"), F.sum("tokens").alias("tokens"), F.bool_and("cache_hit").alias("cache_hit"),
        F.array_join(F.array_sort(F.collect_list(F.when(~ok, F.col("index")))).cast("array<string>"), ", ").alias("failed"),
    )
    whole = F.col("valid") == F.col("chunks")
    failure = F.when(F.col("broken") > 0, "backend_error").otherwise("malformed")
    return a.select(
        *key, F.when(F.col("yes") > 0, "YES").when(whole, "NO").alias("verdict"), F.when(whole, "valid").when(F.col("yes") > 0, "partial").otherwise(failure).alias("status"),
        F.when(~whole, failure).alias("error"), F.when(~whole, F.col("failed")).alias("failed"), "retryable", "latency_ms", "tokens", "cache_hit",
    )


def cacheable(decisions: DataFrame) -> DataFrame:
    return decisions.where("status <> 'backend_error' AND NOT retryable AND coalesce(error, '') <> 'backend_error'")


@dataclasses.dataclass(frozen=True)
class Limits:
    """Caps on a run; None means none."""

    calls: int | None = None
    tokens: int | None = None
    cost: float | None = None
    seconds: float | None = None

    def __post_init__(self):
        for f in dataclasses.fields(self):
            cap = getattr(self, f.name)
            if cap is not None and (isinstance(cap, bool) or not 0 <= cap < float("inf")):
                raise ValueError(f"{f.name} must be a finite number from 0 on")


def exhausted(limits: Limits, calls: Column, tokens: Column, cost: Column, seconds: Column | None = None) -> Column:
    """Name of the first cap that is reached, time first; null if none is."""
    spent = (("seconds", seconds), ("calls", calls), ("tokens", tokens), ("cost", cost))
    return F.coalesce(*[F.when(used >= getattr(limits, name), F.lit(name)) for name, used in spent if used is not None and getattr(limits, name) is not None], F.lit(None).cast("string"))


def call_slots(limits: Limits, workers: int, calls: Column, tokens: Column, cost: Column) -> Column:
    """Calls that may start now: as many as the rest of each budget pays for at the mean price so far, from 1 on until it is spent.

    Before the first call there is no price, so one call goes alone.
    """

    def affordable(cap, spent: Column) -> Column:
        left, mean = F.lit(float(cap)) - spent, spent / calls
        by_mean = F.when(mean > 0, F.greatest(F.floor(left / F.nullif(mean, F.lit(0.0))).cast("long"), F.lit(1))).otherwise(workers)
        return F.when(left <= 0, 0).when(calls <= 0, 1).otherwise(by_mean)

    bounds = [F.lit(workers)]
    if limits.calls is not None:
        bounds.append(F.lit(limits.calls) - calls)
    bounds += [affordable(cap, spent.cast("double")) for cap, spent in ((limits.tokens, tokens), (limits.cost, cost)) if cap is not None]
    return F.greatest(F.least(*bounds) if len(bounds) > 1 else bounds[0], F.lit(0)).cast("long")


def pending(items: DataFrame, done: DataFrame, config: str) -> DataFrame:
    """Items (key, ...) without a stored result under this configuration."""
    return items.join(done.where(F.col("config") == config).select("key"), "key", "left_anti")


def counters(results: DataFrame, *keys: str) -> DataFrame:
    """A run's figures from its stored results: one row, or one for each value of keys."""
    v = lambda x: F.count_if(F.col("verdict") == x)
    tokens, cost = usage_tokens(F.col("tokens"), F.lit(None), F.lit(None)), usage_cost(F.col("cost"))
    return results.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"),
        v("YES").alias("yes"), v("NO").alias("no"), v("ABSTAIN").alias("abstain"), v("ERROR").alias("errors"),
    )


def stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RESULT).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], RESULT)


def run_stage(items: DataFrame, call: Callable[[dict], dict], path: str, config: str, limits: Limits = Limits(), batch: int = 10_000) -> dict:
    """Calls `call` once for every pending item (key, ...) and appends its results to path; gives status and figures.

    Each batch is one distributed job, its keys in hash order, and its results are in the store before budgets are looked at
    again, so a failure loses one batch at most and a second run calls nothing that is stored; a task that Spark repeats calls its
    rows again. A call that raises gives an ERROR row. `call` takes a row as dict and returns verdict, tokens and cost.
    """
    spark, names = items.sparkSession, items.columns

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    got = call(row)
                    out.append((str(row["key"]), config, got.get("verdict", "ERROR"), got.get("tokens"), got.get("cost"), None))
                except Exception as broken:
                    out.append((str(row["key"]), config, "ERROR", None, None, f"{type(broken).__name__}: {broken}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(RESULT_ARROW)], names=RESULT_NAMES)

    while True:
        done = stored(spark, path).where(F.col("config") == config)
        now = counters(done).select("*", exhausted(limits, F.col("calls"), F.col("tokens"), F.col("cost")).alias("reason"), call_slots(limits, batch, F.col("calls"), F.col("tokens"), F.col("cost")).alias("slots")).first().asDict()
        reason, slots = now.pop("reason"), now.pop("slots")
        todo = pending(items, done, config).select(*names)
        if todo.isEmpty():
            return {**now, "status": "completed_with_errors" if now["errors"] else "completed"}
        if reason or slots < 1:
            return {**now, "status": "budget_exhausted", "reason": reason}
        part = todo.orderBy(F.xxhash64("key"), "key").limit(slots)
        part.repartition(spark.sparkContext.defaultParallelism).mapInArrow(answers, RESULT).write.mode("append").parquet(path)


def prefilter_stats(admitted: DataFrame, *by: str) -> DataFrame:
    """Rows (admit, reason) to seen, admitted, rejected and the share rejected."""
    a = admitted.groupBy(*by).agg(F.count("*").alias("seen"), F.count_if("admit").alias("admitted"))
    return a.withColumn("rejected", F.col("seen") - F.col("admitted")).withColumn("reduction_rate", F.round(F.coalesce(F.col("rejected") / F.col("seen"), F.lit(0.0)), 4))


def counted(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """How often each value occurs, most first, ties by first occurrence."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first")).orderBy(F.desc("n"), "first").drop("first")


def funnel(prefilter: DataFrame, triage: DataFrame, review: DataFrame) -> DataFrame:
    """(stage, outcome, n) over the stages of a run: prefilter (admit), triage (verdict), review (verdict)."""
    first = prefilter.select(F.lit("prefilter").alias("stage"), F.when(F.col("admit"), "admitted").otherwise("rejected").alias("outcome"))
    second = triage.select(F.lit("triage"), F.when(F.col("verdict").isin("YES", "NO"), F.lower("verdict")).otherwise("error"))
    third = review.select(F.lit("review"), F.when(F.col("verdict").isin("YES", "NO"), F.lower("verdict")).otherwise("abstain"))
    return first.union(second).union(third).groupBy("stage", "outcome").agg(F.count("*").alias("n"))


def merge_truth(base: DataFrame, panel: DataFrame, repository: str) -> DataFrame:
    """Truth rows (sha, repo, role, confidence); the panel's replace others of their sha but take over its repo."""
    b, p = base.alias("b"), panel.alias("p")
    c = F.col
    over = c("p.sha").isNotNull()
    return b.join(p, c("b.sha") == c("p.sha"), "full_outer").select(
        F.coalesce("p.sha", "b.sha").alias("sha"), F.coalesce(c("b.repo"), F.lit(repository)).alias("repo"), F.when(over, c("p.role")).otherwise(c("b.role")).alias("role"),
        F.coalesce(F.when(over, c("p.confidence")).otherwise(c("b.confidence")), F.lit("medium")).alias("confidence"), F.when(over, "panel").otherwise("matrix").alias("source"),
    )


def report_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(change, sha) between two sets of scored rows (sha, outcome), outcome TP or FP: hits gained and lost, false alarms fixed and added."""
    n, o = new.where("outcome IN ('TP', 'FP')").distinct(), old.where("outcome IN ('TP', 'FP')").distinct()
    came = n.join(o, ["sha", "outcome"], "left_anti").select(F.when(F.col("outcome") == "TP", "gained").otherwise("added").alias("change"), "sha")
    went = o.join(n, ["sha", "outcome"], "left_anti").select(F.when(F.col("outcome") == "TP", "lost").otherwise("fixed").alias("change"), "sha")
    return came.union(went)


def still_applies(findings: DataFrame, blobs: DataFrame) -> DataFrame:
    """(finding, applies): true if a quote of the finding's anchors is in the file's text now, null if it has none to look for.

    findings (finding, path, quoted_span), one row an anchor; blobs (path, text).
    """
    from prospector.functions.calls import quote_in

    a = findings.join(blobs, "path", "left")
    return a.groupBy("finding").agg(F.bool_or(F.when(F.trim("path") != "", quote_in(F.col("quoted_span"), F.col("text")))).alias("applies"))


def similar_call_sites(names: DataFrame, files: DataFrame, limit: int = 100) -> DataFrame:
    """Lines of files (path, text) that call a name of names (name): by path, line and name, the first `limit`.

    A line's calls are read off once and joined to the names by equality.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("k", "line")).withColumn("snippet", F.trim("line"))
    code = lines.where("snippet <> '' AND NOT snippet RLIKE '^(def|func|function) '")
    calls = code.select("path", (F.col("k") + 1).alias("line"), F.substring("snippet", 1, 500).alias("snippet"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][\w$]*)\s*\("), 1))).alias("name"))
    return calls.join(names.select("name").distinct(), "name", "left_semi").orderBy("path", "line", "name").limit(limit)


def issued_only(anchors: DataFrame, issued: DataFrame) -> DataFrame:
    """Anchors whose range was cited before; both have revision_sha, path, start_line and end_line."""
    from prospector.functions.calls import citation_key

    key = citation_key(F.col("revision_sha"), F.col("path"), F.col("start_line"), F.col("end_line"))
    return anchors.withColumn("_k", key).join(issued.select(key.alias("_k")), "_k", "left_semi").drop("_k")


def quantile(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """(by, quantile): the value of nearest rank (n-1)p, halves to the even rank; only counts of distinct values are ranked."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = F.bround((F.col("_n") - 1) * p)
    return ranked.where((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*by, F.col(value).alias("quantile"))


def precision_range(recall: tuple[Column, Column], fpr: tuple[Column, Column], prevalence: Column) -> tuple[Column, Column]:
    """Least and greatest precision: low recall goes with high false alarms, and the other way round."""
    from prospector.functions.stats import precision_at

    return precision_at(recall[0], fpr[1], prevalence), precision_at(recall[1], fpr[0], prevalence)


def gates(summary: DataFrame) -> DataFrame:
    """Whether a run qualifies: rows (recall, quiet_recall, uncovered) with unknown recalls failing."""
    a, b, c = F.col("recall") >= 0.95, F.col("quiet_recall") >= 0.90, F.col("uncovered") == 0
    yes = lambda x: F.coalesce(x, F.lit(False))
    return summary.select("*", yes(a).alias("recall_met"), yes(b).alias("quiet_recall_met"), yes(c).alias("all_evaluated"), (yes(a) & yes(b) & yes(c)).alias("qualifies"))


# Languages of file endings, endings that tell nothing, and the weight of a test file.
LANGUAGES = {".go": "go", ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "javascript", ".tsx": "javascript"}
NO_LANGUAGE = (".md", ".txt", ".json", ".yaml", ".yml", ".lock", ".sum", ".mod")
TEST_WEIGHT = 0.25


def language_votes(files: DataFrame, keys: list[str], path: str, seq: str) -> DataFrame:
    """(keys, language): the language most files of each key are written in, tests at a discount; of equal ones the first by seq. Keys
    without a file of a known language are absent."""
    low = F.lower(path)
    languages = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    language = F.when(~ends_with(low, NO_LANGUAGE), F.try_element_at(languages, extension(F.col(path))))
    test = low.contains("_test.") | low.contains("/test") | low.startswith("test")
    votes = files.select(*keys, language.alias("language"), F.when(test, TEST_WEIGHT).otherwise(1.0).alias("w"), F.col(seq).alias("f")).where("language IS NOT NULL")
    votes = votes.groupBy(*keys, "language").agg(F.sum("w").alias("w"), F.min("f").alias("f"))
    return votes.groupBy(*keys).agg(F.max_by("language", F.struct("w", -F.col("f"))).alias("language"))


def candidate_paths(*sources: Column) -> Column:
    """Distinct paths of arrays of paths, in order, without empty ones; null arrays hold none."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.coalesce(s, none) for s in sources])), lambda x: x.isNotNull() & (x != "")))


def with_appendix(candidates: DataFrame, language: str, appendices: DataFrame) -> DataFrame:
    """candidates with the text that belongs to their language, after a blank line; the empty text where there is none."""
    side = appendices.select(F.col("language").alias("_l"), F.trim("body").alias("_b"))
    body = F.when(F.coalesce("_b", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n\n"), "_b", F.lit("\n")))
    return candidates.join(F.broadcast(side), F.col(language) == F.col("_l"), "left").withColumn("appendix", body).drop("_l", "_b")  # a row for each language
