"""The corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, mixing and sharding of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.llm import decontaminate, mixing, sharding, simhash, toxicity
from prospector.llm.common import drop, fresh, repeat_rows, row_key, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5. Null and empty texts score low and stay; without labels of both kinds all stay."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return toxicity.score(docs, scorer, score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles reach a Jaccard similarity of 0.8: the one of the smallest id, nulls
    last. Rows repeated whole are one document, and null and empty texts are one group."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within a fifth of its words. Null and empty texts stay; an empty benchmark drops nothing."""
    found = fresh(docs, "leaks")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), found).where(F.size(found) == 0).drop(found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Texts without words are not taken; a null source is a
    source of its own; rows repeated whole are taken by turns."""
    key = fresh(docs, "row")
    keyed = docs.withColumn(key, row_key(docs))
    taken = mixing.mix(keyed.select("doc_id", "source", "text", F.col(key).alias("row")), carry=("row",))
    return repeat_rows(keyed, key, taken.select(F.col("row").alias(key), F.col("times").alias("n")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every document and its place there, in place of its other columns: shards 0 to 39 of near-equal bytes. Null texts and
    repeated rows are placed like others; no documents, no shards."""
    return sharding.shard(docs).drop("text_hash")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints, learned scores and edit distances have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and dropped when the next one is
    there."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                drop(spark, f"{at}/{k - 1}")
    return docs
