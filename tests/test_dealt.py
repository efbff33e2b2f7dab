"""Steps whose work follows from rows, not from the bytes of a small table: how they are dealt, and what is done once."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from prospector.functions import profiles


def test_profiles_of_one_file_are_many_tasks(spark):
    diffs = spark.range(40, numPartitions=1).select("id", F.lit("diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b\n").alias("diff"))
    shown = profiles.input_profile(diffs, "D1", "diff").withColumn("task", F.spark_partition_id())
    assert shown.where("status = 'ready'").count() == 40 and shown.select("task").distinct().count() == 4


def test_turns_of_a_small_table_are_many_tasks(spark):
    from prospector.operators import reviews

    k = F.col("id").cast("string")
    c = spark.range(60, numPartitions=1)
    commits = c.select(k.alias("sha"), F.col("id").alias("place"), F.array().cast("array<string>").alias("parents"))
    asked = c.select(k.alias("sha"), F.array(F.lit('{"role":"user","content":"review"}')).alias("prompt"))
    out = reviews.review(asked, lambda messages, may_call: str(TaskContext.get().partitionId()), commits, None, None).collect()
    assert len(out) == 60 and {r["status"] for r in out} == {"answered"} and len({r["answer"] for r in out}) > 1


def test_a_stream_begins_with_one_row_a_key(spark):
    from prospector.streaming import latest

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "y"), ("b", 5, "z")], "k string, seq long, v string")
    assert sorted(map(tuple, latest.newest(rows, ["k"], "seq").collect())) == [("a", 3, None), ("b", 5, "z")]


def test_a_share_is_hashed_once(spark):
    from prospector.operators import evaluation

    rows = spark.createDataFrame([("a", "fix", "YES"), ("b", "other", "NO")], "repository string, truth string, prediction string")
    plan = evaluation.poisson_bootstrap(rows, samples=20)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("sha2(") <= 2
