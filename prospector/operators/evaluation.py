"""Confusion summaries, votes, set comparisons, truth scoring and the block bootstrap."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospector.functions import stats
from prospector.functions.text import prediction_literal, stable_score, truth_literal


def confusion(rows: DataFrame, *by: str, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Counts and rates; an uncovered row is never a NO, and an excluded one counts nowhere else."""
    t, p = F.col("_t"), F.col("_p")
    named = rows.withColumn("_t", truth_literal(F.col(truth))).withColumn("_p", prediction_literal(F.col(prediction)))
    count = lambda c: F.count_if(c)
    base = named.groupBy(*by).agg(
        count(t & p).alias("tp"), count(t & ~p).alias("fn"), count(~t & p).alias("fp"), count(~t & ~p).alias("tn"),
        count(t & p.isNull()).alias("uncovered_positive"), count(~t & p.isNull()).alias("uncovered_negative"), count(t.isNull()).alias("excluded"),
    )
    c = F.col
    positives, negatives = c("tp") + c("fn") + c("uncovered_positive"), c("fp") + c("tn") + c("uncovered_negative")
    low, high = stats.wilson(c("tp"), positives)
    return base.select(
        *base.columns, stats.rate(c("tp"), positives).alias("recall"), stats.rate(c("tp"), c("tp") + c("fn")).alias("covered_recall"), stats.rate(c("fp"), negatives).alias("fpr"),
        stats.rate(c("tp"), c("tp") + c("fp")).alias("precision"), F.coalesce(stats.rate(c("tp") + c("fn") + c("fp") + c("tn"), positives + negatives), F.lit(0.0)).alias("coverage"),
        low.alias("recall_low"), high.alias("recall_high"),
    )


def fold_verdicts(verdict: Column) -> Column:
    """true if any is; false if all are and there is one; else null."""
    return F.when(F.bool_or(verdict), True).when((F.count(verdict) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), False)


def consensus(votes: DataFrame, key: str, rounds: int, threshold: int | None = None) -> DataFrame:
    """Votes (key, round, verdict, anchors) to a verdict: YES, then NO, then ABSTAIN at the threshold, a majority of all rounds asked for.

    The winning YES is the one of most anchors, of several the earliest.
    """
    need = threshold or rounds // 2 + 1
    n = lambda v: F.count_if(F.col("verdict") == v)
    out = votes.groupBy(key).agg(n("YES").alias("yes"), n("NO").alias("no"), n("ABSTAIN").alias("abstain"), F.count_if(F.col("verdict").isNotNull()).alias("cast"), F.max_by("round", F.when(F.col("verdict") == "YES", F.struct("anchors", -F.col("round")))).alias("best"))
    verdict = F.when(F.col("yes") >= need, "YES").when(F.col("no") >= need, "NO").otherwise("ABSTAIN")
    agree = F.round(stats.rate(F.greatest("yes", "no", "abstain"), F.col("cast")), 2)
    return out.select(key, verdict.alias("verdict"), F.when(F.col("yes") >= need, F.col("best")).alias("winner"), agree.alias("agreement"), (~((F.col("yes") >= need) | (F.col("no") >= need) | (F.col("abstain") >= need))).alias("no_consensus"))


def set_sizes(members: DataFrame, run: str, item: str) -> DataFrame:
    """Per run: its items, those only it has, those that all runs have, and the items of all runs."""
    runs = members.select(run).distinct()
    per_item = members.groupBy(item).agg(F.collect_set(run).alias("runs"))  # as many as there are runs
    total = runs.agg(F.count("*").alias("n_runs"))
    facts = per_item.crossJoin(F.broadcast(total))  # one row
    sizes = facts.select(F.explode("runs").alias(run), (F.size("runs") == 1).alias("own"), (F.size("runs") == F.col("n_runs")).alias("all"))
    union = per_item.agg(F.count("*").alias("in_any"))
    return sizes.groupBy(run).agg(F.count("*").alias("items"), F.count_if("own").alias("exclusive"), F.count_if("all").alias("in_all")).crossJoin(F.broadcast(union))


def pairs_of_runs(members: DataFrame, run: str, item: str) -> DataFrame:
    """(left, right, in_both, only_left, only_right) of each two runs, the smaller name first."""
    sizes = members.select(run, item).distinct().groupBy(run).agg(F.count("*").alias("k"))
    per_item = members.groupBy(item).agg(F.array_sort(F.collect_set(run)).alias("runs"))  # as many as there are runs
    pair = F.flatten(F.transform("runs", lambda a, i: F.transform(F.slice("runs", i + 2, F.size("runs")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    both = per_item.select(F.explode(pair).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("in_both"))
    one = lambda side: sizes.select(F.col(run).alias(side), F.col("k").alias(f"k_{side}"))
    names = sizes.select(F.array_sort(F.collect_list(run).over(Window.partitionBy())).alias("runs")).limit(1)  # as many as there are runs
    every = names.select(F.explode(pair).alias("p")).select("p.left", "p.right")
    out = every.join(both, ["left", "right"], "left").join(one("left"), "left").join(one("right"), "right").withColumn("in_both", F.coalesce("in_both", F.lit(0)))
    return out.select("left", "right", "in_both", (F.col("k_left") - F.col("in_both")).alias("only_left"), (F.col("k_right") - F.col("in_both")).alias("only_right"))


def pair_sizes(members: DataFrame, run: str, item: str, left: str, right: str) -> DataFrame:
    """How many items both runs have, and each alone."""
    sides = members.groupBy(item).agg(F.bool_or(F.col(run) == left).alias("l"), F.bool_or(F.col(run) == right).alias("r"))
    return sides.agg(F.count_if(F.col("l") & F.col("r")).alias("in_both"), F.count_if(F.col("l") & ~F.col("r")).alias("only_left"), F.count_if(~F.col("l") & F.col("r")).alias("only_right"))


def score_truth(emitted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per repository of the truth and in total: hits, false alarms, emitted but unknown, and fixes missed.

    emitted (repository, sha), truth (repository, sha, role); role fix is positive.
    """
    e = emitted.select("repository", "sha").distinct().withColumn("emitted", F.lit(True))
    known = truth.select("repository").distinct()
    both = truth.join(e, ["repository", "sha"], "full_outer").join(known, "repository", "left_semi")
    fix, out = F.col("role") == "fix", F.col("emitted").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    scored = both.rollup("repository").agg(n(out & fix, "tp"), n(out & F.col("role").isNotNull() & ~fix, "fp"), n(out & F.col("role").isNull(), "unscored"), n(~out & fix, "missed"), F.grouping_id().alias("g"))
    return scored.select(F.when(F.col("g") == 1, "total").otherwise(F.col("repository")).alias("repository"), "tp", "fp", "unscored", "missed", stats.rate(F.col("tp"), F.col("tp") + F.col("missed")).alias("recall"), stats.rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def block_bootstrap(rows: DataFrame, block: str = "repository", samples: int = 2000, seed: int = 7) -> DataFrame:
    """95% intervals of recall and false positive rate over resampled blocks: nearest-rank percentiles.

    Blocks are counted first; draws of all blocks by a seeded generator then weigh the counts, sample by sample, spread over tasks.
    """
    counts = confusion(rows, block).select(block, "tp", (F.col("tp") + F.col("fn") + F.col("uncovered_positive")).alias("pos"), "fp", (F.col("fp") + F.col("tn") + F.col("uncovered_negative")).alias("neg"))
    spark = rows.sparkSession
    table = np.array([r[1:] for r in counts.orderBy(block).collect()], float).reshape(-1, 4)  # one row a repository

    def draw(frames):
        import pandas as pd

        for f in frames:
            out = []
            for k in f["id"]:
                pick = np.random.default_rng([seed, int(k)]).integers(0, len(table), len(table))
                tp, pos, fp, neg = table[pick].sum(axis=0)
                out.append((tp / pos if pos else None, fp / neg if neg else None))
            yield pd.DataFrame(out, columns=["recall", "fpr"])

    drawn = spark.range(samples if len(table) else 0).mapInPandas(draw, "recall double, fpr double")
    rank = lambda c, p: F.element_at(F.array_sort(F.collect_list(c)), (F.bround((F.count(c) - 1) * p) + 1).cast("int"))
    return drawn.agg(*[F.when(F.count(c) > 0, rank(c, p)).alias(f"{c}_{name}") for c in ("recall", "fpr") for name, p in (("low", 0.025), ("high", 0.975))])


#: Draws of one block in one sample, at most; more have a chance below 10^-15.
MOST_DRAWS = 17


def poisson_weight(share: Column) -> Column:
    """How often a block is drawn: the number of Poisson(1) for a share of [0, 1), by its cumulative chances."""
    total, each, steps = 0.0, math.exp(-1.0), []
    for k in range(1, MOST_DRAWS + 1):
        total += each
        each /= k
        steps.append(F.when(share >= F.lit(total), 1).otherwise(0))
    return functools.reduce(lambda a, b: a + b, steps)


def nearest_rank(values: Column, p: float) -> Column:
    """The value at the nearest rank of a share p of the values that are not null."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.bround((F.count(values) - 1) * p) + 1).cast("int"))


def poisson_bootstrap(rows: DataFrame, block: str = "repository", samples: int = 2000, seed: str = "7", alpha: float = 0.05) -> DataFrame:
    """Intervals of recall and false positive rate over resampled blocks, for any number of blocks.

    Every block draws for itself how often it is in each sample, by a hash of seed, sample and block, so nothing is gathered to draw from:
    counts of a block are weighed where they lie and tasks sum them up by sample before they are shuffled. The same blocks give the same
    draws whatever their order or partitions. Percentiles are nearest ranks of at most `samples` values.
    """
    counts = confusion(rows, block).select(block, "tp", (F.col("tp") + F.col("fn") + F.col("uncovered_positive")).alias("pos"), "fp", (F.col("fp") + F.col("tn") + F.col("uncovered_negative")).alias("neg"))
    # counts are small and would be one task, but each makes a row a sample
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = counts.repartition(parts, block).withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    share = stable_score(seed, F.concat_ws("|", F.col("sample").cast("string"), F.coalesce(F.col(block).cast("string"), F.lit(""))))
    # a share is bound before it is compared, or each of its comparisons hashes it again; weights of 0 add nothing
    drawn = each.withColumn("w", F.transform(F.array(share), poisson_weight)[0])
    sums = drawn.groupBy("sample").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "pos", "fp", "neg")])
    rates = sums.select(stats.rate(F.col("tp"), F.col("pos")).alias("recall"), stats.rate(F.col("fp"), F.col("neg")).alias("fpr"))
    ends = (("low", alpha / 2), ("high", 1 - alpha / 2))
    return rates.agg(*[F.when(F.count(c) > 0, nearest_rank(F.col(c), p)).alias(f"{c}_{name}") for c in ("recall", "fpr") for name, p in ends])


# --- keys of any type

#: Names of the kinds of a JSON value, by how the schema of a variant begins; other numbers are floats.
KINDS = {"VOID": "NoneType", "BOOLEAN": "bool", "BIGINT": "int", "STRING": "str", "ARRAY": "list", "OBJECT": "dict"}


def any_key(value: Column) -> Column:
    """(kind, text) of a JSON value: what tells keys of mixed types apart and orders them, first by the kind's name and then by the text.
    1 and "1" and true are three keys; null and what is no JSON are none."""
    v = F.try_parse_json(value)
    schema = F.schema_of_variant(v)
    kind = F.coalesce(*[F.when(schema.startswith(start), name) for start, name in KINDS.items()], F.when(schema.isNotNull(), "float"), F.lit("NoneType"))
    return F.struct(kind.alias("kind"), F.coalesce(F.to_json(v), F.lit("null")).alias("text"))


def confusion_by_any(rows: DataFrame, key: Column) -> DataFrame:
    """confusion() for each value of a JSON key of any type, as place, kind and text; place is the key's in the order of any_key(). key is
    any expression over rows."""
    held = confusion(rows.withColumn("_key", any_key(key)).withColumns({"kind": F.col("_key.kind"), "text": F.col("_key.text")}), "kind", "text")
    places = held.select("kind", "text").withColumn("place", F.row_number().over(Window.orderBy("kind", "text")) - 1)  # one row a stratum
    return held.join(places, ["kind", "text"]).select("place", *held.columns)
