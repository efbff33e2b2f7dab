"""Profiles run over commits with a cache of decisions: an input that was decided on once is never asked for again.

A decision is known by its backend, its profile and what the profile showed: the hashes of the raw diff, of what is left of it, and of the
whole input and its chunks in their order. Anything else about a commit may change without a new call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.functions import profiles
from prospector.operators import runs, stages
from prospector.operators.graph import cut
from prospector.operators.state import FOLDERS
from prospector.sources.ledger import ORDER, Ledger

DECISION = ("verdict", "status", "error", "failed", "retryable", "latency_ms", "tokens")
ROW = "memo string, profile string, backend string, verdict string, status string, error string, failed string, retryable boolean, latency_ms long, tokens long"


def memo(backend: str, profile: Column, shown: Column) -> Column:
    """What a decision is known by. shown: raw_diff_hash, normalized_diff_hash, input_hash and chunk_hashes of an input."""
    parts = [F.lit(backend), profile, shown["raw_diff_hash"], shown["normalized_diff_hash"], shown["input_hash"], F.array_join(shown["chunk_hashes"], ",")]
    return F.sha2(F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in parts])).cast("binary"), 256)


def first_decision(_: str, rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("memo", ORDER)]
    return rows.groupBy("memo").agg(F.min_by(F.struct(*rest), ORDER).alias("r")).select("memo", "r.*")


class Decisions:
    """Decisions under a folder, one for each input: the first that was committed. Runs add to it side by side."""

    def __init__(self, spark: SparkSession, root: str):
        self.ledger = Ledger(spark, root, {"decisions": ROW}, first_decision, {"decisions": "memo"})

    def read(self) -> DataFrame:
        return self.ledger.at("decisions")

    def of(self, memos: DataFrame) -> DataFrame:
        """What is known of memos (memo)."""
        return self.read().join(memos.select("memo").distinct(), "memo", "left_semi")

    def add(self, decided: DataFrame) -> int:
        """Add decisions that stand: none of a backend that failed, none that may be asked for again. The commit they are in."""
        with self.ledger.transaction() as t:
            t.append("decisions", runs.cacheable(decided).dropDuplicates(["memo"]))
        if len(self.ledger.commit(t.done)["tables"]["decisions"]["parts"]) > FOLDERS:
            self.ledger.compact("decisions")
        return t.done

    def migrate(self, old: DataFrame, shown: DataFrame) -> int:
        """Take over decisions that are known by profile and input_hash only (profile, input_hash and DECISION): those of inputs that are
        shown now, under their new name; the commit they are in. Of several of one input the first by status and verdict counts."""
        known = shown.select("memo", "profile", "backend", F.col("hashes.input_hash").alias("input_hash")).distinct()
        rows = old.join(known, ["profile", "input_hash"]).groupBy("memo", "profile", "backend").agg(F.min(F.struct("status", *[c for c in DECISION if c != "status"])).alias("d"))
        new = rows.select("memo", "profile", "backend", *[F.col(f"d.{c}").alias(c) for c in DECISION])
        return self.add(new.join(self.of(new).select("memo"), "memo", "left_anti"))


def inputs(commits: DataFrame, names: Iterable[str], backend: str, key: str = "sha", most: int = profiles.INPUT_BYTES) -> DataFrame:
    """(key, profile, backend, input_status, input_error, hashes, chunks, memo) of commits (key, diff, subject, message) in each profile."""
    out = None
    for name in names:
        p = profiles.input_hashes(profiles.input_profile(commits, name, "diff", F.col("subject"), F.col("message"), most))
        rows = p.select(key, F.lit(name).alias("profile"), F.lit(backend).alias("backend"), F.col("status").alias("input_status"), F.col("error").alias("input_error"), "hashes", "chunks")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("memo", F.when(F.col("input_status") == "ready", memo(backend, F.col("profile"), F.col("hashes"))))


def run_profiles(commits: DataFrame, ask: Callable[[str], Any], cache: Decisions, names: Iterable[str] = profiles.PROFILES, backend: str = "default", key: str = "sha", most: int = profiles.INPUT_BYTES) -> DataFrame:
    """(key, profile, input_status, input_error, memo, DECISION, cache_hit) of every commit in each profile.

    Of inputs that are the same, only that of the smallest key is asked for, and only if the cache has no decision on it; cache_hit tells
    the others. What is asked for is written before the cache takes it, so neither a lost executor nor a conflict asks twice. A failed
    backend leaves nothing in the cache, so the next run asks again. Inputs that are not ready have no decision.
    """
    shown = cut(inputs(commits, names, backend, key, most))
    ready = shown.where("memo IS NOT NULL")
    known = cut(cache.of(ready))
    one = ready.groupBy("memo").agg(F.min(key).alias(key)).join(known.select("memo"), "memo", "left_anti")
    chunks = ready.join(one, ["memo", key]).dropDuplicates(["memo"]).select("memo", "profile", F.explode("chunks").alias("c")).select("memo", "profile", F.col("c.number").alias("index"), "c.text")
    decided = runs.fold_chunks(stages.asked(chunks, ask), "memo", "profile")
    new = cut(decided.select("memo", "profile", F.lit(backend).alias("backend"), *DECISION))
    cache.add(new)
    every = known.select("memo", *DECISION, F.lit(None).cast(shown.schema[key].dataType).alias("_by")).unionByName(new.join(one, "memo").select("memo", *DECISION, F.col(key).alias("_by")))
    out = shown.join(every, "memo", "left")
    hit = F.when(F.col("status").isNotNull(), ~F.col("_by").eqNullSafe(F.col(key)))
    return out.select(key, "profile", "input_status", "input_error", "memo", *DECISION, hit.alias("cache_hit"))


def profile_costs(rows: DataFrame) -> DataFrame:
    """What each profile's run came to: inputs, calls, and the share of decisions that the cache had."""
    had = F.count_if(F.coalesce("cache_hit", F.lit(False)))
    return rows.groupBy("profile").agg(
        F.count("*").alias("commits"), F.count("status").alias("decided"), F.count_if(~F.coalesce("cache_hit", F.lit(True))).alias("asked"), had.alias("reused"),
        F.count_if(F.col("verdict") == "YES").alias("yes"), F.coalesce(F.sum(F.when(~F.col("cache_hit"), F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
