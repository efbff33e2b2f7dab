"""Tables that runs write: blobs by content, labels by appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from prospector.functions import contracts
from prospector.functions.text import canonical_json, content_hash


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as none:
        if "PATH_NOT_FOUND" not in str(none):
            raise
        return spark.createDataFrame([], schema)


BLOB = "hash string, size long, content binary, fan string"


def put_blobs(contents: DataFrame, path: str, column: str = "content") -> None:
    """Store each distinct content once under its sha256, in folders by the hash's first two digits; what is there stays."""
    spark = contents.sparkSession
    rows = contents.where(F.col(column).isNotNull()).select(F.col(column).cast("binary").alias("content"))
    rows = rows.select(content_hash(F.col("content")).alias("hash"), F.length("content").cast("long").alias("size"), "content").dropDuplicates(["hash"])
    new = rows.join(existing(spark, path, BLOB).select("hash"), "hash", "left_anti")
    new.withColumn("fan", F.substring("hash", 8, 2)).write.mode("append").partitionBy("fan").parquet(path)


def get_blobs(spark: SparkSession, path: str, hashes: DataFrame, most: int | None = None) -> DataFrame:
    """(hash, size, content) of hashes (hash); content is checked against its name and null above `most` bytes.

    The folder is part of the join, so that only folders of wanted hashes are read.
    """
    wanted = hashes.select("hash", F.substring("hash", 8, 2).alias("fan")).distinct()
    rows = existing(spark, path, BLOB).join(wanted, ["fan", "hash"])
    sound = F.when(content_hash(F.col("content")) == F.col("hash"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("damaged blob "), "hash")).cast("binary"))
    small = F.lit(True) if most is None else F.col("size") <= most
    return rows.select("hash", "size", F.when(small, sound).alias("content"))


def normal_labels(labels: DataFrame) -> DataFrame:
    """Labels with one spelling and a record_id, the hash of all else. Unknown verdicts follow from the role.

    Takes the columns that contracts.label_problems() reads, and repository and annotator_id.
    """
    c = F.col
    role, verdict = F.lower(F.trim("role")), F.upper(F.trim("verdict"))
    by_role = F.when(role.isin("fix", "backport"), "YES").when(role.isin("context", "introduce", "other"), "NO")
    kind = F.coalesce(F.lower("record_type"), F.lit("annotation"))
    status = F.coalesce(F.lower("status"), F.lit("draft"))
    none = F.array().cast("array<string>")
    out = labels.withColumns({
        "role": role, "verdict": F.coalesce(verdict, by_role), "record_type": kind, "commit_sha": F.lower("commit_sha"), "l0_class": F.lower("l0_class"), "cwe_id": F.upper("cwe_id"),
        "status": F.when((kind == "adjudication") | (status == "resolved"), "frozen").otherwise(status), "independent": F.coalesce(c("independent"), kind == "annotation"),
        **{x: F.array_sort(F.array_distinct(F.coalesce(c(x), none))) for x in ("affected_paths", "source_record_hashes", "source_annotators")},
    })
    rest = [x for x in out.columns if x != "record_id"]
    return out.withColumn("record_id", content_hash(canonical_json(*rest)))


def append_labels(labels: DataFrame, path: str, frozen_only: bool = False) -> None:
    """Add sound labels to the log; one unsound label and none is added. The log is never rewritten."""
    out = normal_labels(labels)
    wrong = out.select("commit_sha", contracts.label_problems(F.col, frozen_only).alias("p")).where(F.size("p") > 0).limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['commit_sha']}: {', '.join(r['p'])}" for r in wrong))
    out.write.mode("append").parquet(path)
