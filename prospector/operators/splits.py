"""Manifests of development and holdout splits, and the checks they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospector.functions.text import canonical_json


def row_digest(rows: DataFrame) -> DataFrame:
    """sha256 of each row's canonical JSON; arrays in sorted order, so that theirs doesn't matter."""
    flat = [F.array_sort(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    return rows.select(*flat).select(F.sha2(canonical_json(*rows.columns), 256).alias("digest"))


def dataset_hash(rows: DataFrame) -> DataFrame:
    """One row (rows, dataset_hash), whatever the order of rows: exact sums of four 32-bit words of all row digests, hashed.

    Sums combine on the map side, so no task sees more than its own rows, and repeated rows count.
    """
    word = lambda k: F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)"))
    sums = row_digest(rows).agg(F.count("*").alias("rows"), *[word(k).alias(f"w{k}") for k in range(4)])
    text = F.concat_ws("|", "rows", *[F.coalesce(F.col(f"w{k}").cast("string"), F.lit("0")) for k in range(4)])
    return sums.select("rows", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("dataset_hash"))


def split_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group").alias("groups"))


def manifest_problems(assignments: DataFrame) -> DataFrame:
    """(problem, subject) of assignments (record, group, split): repeated records, groups in several splits, unknown splits."""
    a = assignments
    twice = a.groupBy("record").count().where("count > 1").select(F.lit("repeated record").alias("problem"), F.col("record").cast("string").alias("subject"))
    spans = a.groupBy("group").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select(F.lit("group in several splits"), F.col("group").cast("string"))
    unknown = a.where("split IS NULL OR split NOT IN ('development', 'holdout')").select(F.lit("unknown split"), F.col("record").cast("string"))
    return twice.union(spans).union(unknown)


def write_manifest(assignments: DataFrame, rows: DataFrame, path: str, method: str, seed: str | None = None, cutoff: str | None = None) -> None:
    """Assignments sorted by record under path/assignments and one header row under path/manifest; unsound manifests raise."""
    if (method == "grouped_hash") != (seed is not None) or (method == "grouped_hash" and cutoff is not None):
        raise ValueError("grouped_hash takes a seed and no cutoff, temporal no seed")
    wrong = manifest_problems(assignments).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['problem']}: {r['subject']}" for r in wrong))
    assignments.orderBy("record").write.mode("overwrite").json(f"{path}/assignments")
    counts = assignments.agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("development", "holdout")])
    header = dataset_hash(rows).crossJoin(F.broadcast(counts))  # one row each
    header.select("*", F.lit(method).alias("method"), F.lit(seed).alias("seed"), F.lit(cutoff).alias("cutoff")).write.mode("overwrite").json(f"{path}/manifest")


def record_ids(rows: DataFrame, id_column: str = "id") -> Column:
    """A record's id, else repository@sha; a record with neither raises."""
    has = lambda *names: [F.col(n).cast("string") for n in names if n in rows.columns]
    own = has(id_column)
    repository, sha = has("repository", "repo"), has("commit_sha", "sha")
    made = [F.concat(F.coalesce(*repository), F.lit("@"), F.coalesce(*sha))] if repository and sha else []
    value = F.coalesce(*own, *made) if own or made else F.lit(None).cast("string")
    return F.when(F.coalesce(F.trim(value), F.lit("")) != "", value).otherwise(F.raise_error(F.lit("every record needs a stable non-empty identity")).cast("string"))


def relation_values(value: Column) -> Column:
    """A relation's values as text, sorted, each once, without empty ones; value is an array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(value, lambda v: v.cast("string")), lambda v: v.isNotNull() & (v != ""))))


def timestamp_of(text: Column) -> Column:
    """A time of an ISO text or a bare date; without a zone it is UTC. Anything else raises."""
    at = F.try_to_timestamp(F.regexp_replace(F.trim(text), "[Zz]$", "+00:00"))
    return F.coalesce(at, F.raise_error(F.concat(F.lit("not a time: "), F.coalesce(text, F.lit("null")))).cast("timestamp"))


def iso_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
