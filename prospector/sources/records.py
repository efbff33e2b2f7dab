"""Readers: strict and lenient JSON lines, change records, truth files, catalogues of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

CHANGED_PATH = StructType([StructField(n, StringType()) for n in ("status", "path", "old_path")])
COMMIT = StructType(
    [StructField("sha", StringType()), StructField("parents", ArrayType(StringType())), *[StructField(n, StringType()) for n in ("message", "author_name", "author_email", "author_time", "committer_name", "committer_email", "committer_time")]]
    + [StructField("changed_paths", ArrayType(CHANGED_PATH)), StructField("patch", BinaryType()), StructField("patch_id", StringType())]
)


def read_json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped. Strict: a malformed line fails the read; else it is left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(kept).option("mode", "PERMISSIVE").json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(repository, sha, role, confidence, source) from a document {"entries": [...]}; confidence and source have defaults."""
    entry = StructType([StructField(n, StringType()) for n in ("sha", "repo", "role", "confidence", "source")])
    doc = spark.read.schema(StructType([StructField("entries", ArrayType(entry))])).option("multiLine", True).json(path)
    e = doc.select(F.explode("entries").alias("e"))
    return e.select(F.col("e.repo").alias("repository"), F.lower("e.sha").alias("sha"), "e.role", F.coalesce("e.confidence", F.lit("medium")).alias("confidence"), F.coalesce("e.source", F.lit("unknown")).alias("source"))


def read_emitted(spark: SparkSession, path: str) -> DataFrame:
    """(repository, sha) of the findings in contexts at path, JSON documents as a scan writes them; each once."""
    own = "repo struct<owner:string,name:string>, fingerprints array<struct<commit_sha:string>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", own, {"mode": "PERMISSIVE"}).alias("c"))
    checked = docs.select(F.when(F.col("c.fingerprints").isNull(), F.raise_error(F.lit(f"{path} holds what is no context")).cast("array<struct<commit_sha:string>>")).otherwise(F.col("c.fingerprints")).alias("f"), F.concat_ws("/", "c.repo.owner", "c.repo.name").alias("repository"))
    return checked.select("repository", F.explode("f").alias("f")).select("repository", F.lower("f.commit_sha").alias("sha")).distinct()


def read_weakness_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every distinct weakness id anywhere in a catalogue file."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"\b(CWE-\d+)\b"), 1)).alias("id")).distinct()


def derived(commits: DataFrame) -> DataFrame:
    """Commits with what their parents say: the first parent, root or merge."""
    n = F.size(F.coalesce("parents", F.array().cast("array<string>")))
    return commits.withColumn("parent_sha", F.get("parents", F.lit(0))).withColumn("is_root", n == 0).withColumn("is_merge", n > 1)


def search(blobs: DataFrame, needle: str, limit: int = 100) -> DataFrame:
    """Lines of blobs (path, content) that hold a fixed string: (path, line, text), the first `limit` by path and line."""
    rows = blobs.where(F.contains("content", F.lit(needle))).select("path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    return rows.where(F.contains("text", F.lit(needle))).select("path", (F.col("at") + 1).alias("line"), "text").orderBy("path", "line").limit(limit)


def line_range(content, start: int, end: int):
    """Lines start to end, 1-based and inclusive; fewer past the end."""
    return F.array_join(F.slice(F.split(content, "\n"), start, end - start + 1), "\n")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a file of JSON lines with seq, their order in the file; a missing file is an empty one, blank lines are skipped, and a
    line that is no object is left out."""
    kept = StructType([*StructType.fromDDL(schema).fields, StructField("_corrupt_record", StringType())])
    try:
        lines = spark.read.text(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"seq long, {schema}")
    rows = lines.withColumn("seq", F.monotonically_increasing_id()).where(F.col("value").rlike(r"\S"))
    out = rows.select("seq", F.from_json("value", kept, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return out.where("r IS NOT NULL AND r._corrupt_record IS NULL").select("seq", *[F.col("r")[f.name].alias(f.name) for f in kept.fields[:-1]])
