"""The profile runner and its cache: nothing is asked twice, one changed hash asks once, failures are not kept, old names migrate."""

import pytest
from pyspark.sql import functions as F

from prospector.operators import profiled

DIFF = "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-x\n+{}\n"
COMMITS = "sha string, diff string, subject string, message string"


@pytest.fixture
def asked(spark):
    """A backend that counts its calls, and their number since the last look."""
    calls = spark.sparkContext.accumulator(0)
    seen = [0]

    def ask(text):
        calls.add(1)
        if "boom" in text:
            raise OSError("down")
        return {"text": "what" if "odd" in text else "YES" if "fix" in text else "NO", "usage": {"total_tokens": 5}}

    def since():
        n, seen[0] = calls.value - seen[0], calls.value
        return n

    return ask, since


def run(spark, commits, ask, cache, **more):
    out = profiled.run_profiles(spark.createDataFrame(commits, COMMITS), ask, cache, **{"names": ("D0", "D2"), **more})
    return {(r["sha"], r["profile"]): r for r in out.collect()}


def test_nothing_is_asked_twice(spark, tmp_path, asked):
    ask, since = asked
    cache = profiled.Decisions(spark, f"{tmp_path}/c")
    commits = [("a", DIFF.format("fix"), "one", "m"), ("b", DIFF.format("fix"), "one", "m"), ("c", DIFF.format("other"), "two", "m"), ("d", "", "x", "m"), ("e", None, None, None)]
    got = run(spark, commits, ask, cache)
    assert since() == 4  # a and b are one input in each profile
    assert {k: (r["verdict"], r["cache_hit"]) for k, r in got.items() if k[1] == "D0"} == {("a", "D0"): ("YES", False), ("b", "D0"): ("YES", True), ("c", "D0"): ("NO", False), ("d", "D0"): (None, None), ("e", "D0"): (None, None)}
    assert got["d", "D2"]["input_status"] == "empty" and len(got) == 10
    again = run(spark, commits, ask, cache)
    assert since() == 0 and all(r["cache_hit"] for r in again.values() if r["verdict"])
    assert {k: r["verdict"] for k, r in again.items()} == {k: r["verdict"] for k, r in got.items()}
    # another subject changes what D2 shows and not what D0 does
    run(spark, [("a", DIFF.format("fix"), "new", "m")], ask, cache)
    assert since() == 1
    run(spark, commits[:1], ask, cache, backend="another")
    assert since() == 2
    assert cache.read().count() == 7 and cache.ledger.compact("decisions")
    run(spark, commits, ask, cache)
    assert since() == 0


def test_failures_are_not_kept(spark, tmp_path, asked):
    ask, since = asked
    cache = profiled.Decisions(spark, f"{tmp_path}/c")
    commits = [("a", DIFF.format("boom"), "s", "m"), ("b", DIFF.format("odd"), "s", "m")]
    got = run(spark, commits, ask, cache, names=("D0",))
    assert (got["a", "D0"]["status"], got["b", "D0"]["status"]) == ("backend_error", "malformed") and since() == 2
    run(spark, commits, ask, cache, names=("D0",))
    assert since() == 1  # a malformed answer stands, a failure doesn't


def test_inputs_in_chunks_and_costs(spark, tmp_path, asked):
    ask, since = asked
    cache = profiled.Decisions(spark, f"{tmp_path}/c")
    long = "".join(DIFF.replace("a.py", f"a{k}.py").format("fix" if k == 3 else "no") for k in range(5))
    rows = profiled.run_profiles(spark.createDataFrame([("a", long, "s", "m"), ("b", long, "s", "m")], COMMITS), ask, cache, ("D1",), most=160)
    cost = profiled.profile_costs(rows).first().asDict()
    n = since()
    assert n > 2 and cost == {"profile": "D1", "commits": 2, "decided": 2, "asked": 1, "reused": 1, "yes": 2, "tokens": 5 * n}


def test_old_decisions_get_new_names(spark, tmp_path, asked):
    ask, since = asked
    cache = profiled.Decisions(spark, f"{tmp_path}/c")
    commits = [("a", DIFF.format("fix"), "one", "m"), ("c", DIFF.format("other"), "two", "m")]
    shown = profiled.inputs(spark.createDataFrame(commits, COMMITS), ("D0",), "default")
    none = {c: F.lit(None).cast(t) for c, t in (("error", "string"), ("failed", "string"), ("latency_ms", "long"), ("tokens", "long"))}
    old = shown.select("profile", "hashes.input_hash", F.lit("NO").alias("verdict"), F.lit("valid").alias("status"), F.lit(False).alias("retryable")).withColumns(none)
    old = old.where(F.col("input_hash") == shown.where("sha = 'a'").first()["hashes"]["input_hash"]).unionByName(old.limit(1).withColumn("input_hash", F.lit("gone")))
    cache.migrate(old, shown)
    got = run(spark, commits, ask, cache, names=("D0",))
    assert since() == 1 and got["a", "D0"]["verdict"] == "NO" and got["a", "D0"]["cache_hit"] and got["c", "D0"]["verdict"] == "NO"
    cache.migrate(old, shown)
    assert cache.read().count() == 2


def test_two_runs_side_by_side_keep_the_first_decision(spark, tmp_path):
    a, b = (profiled.Decisions(spark, f"{tmp_path}/c") for _ in range(2))
    row = lambda verdict: spark.createDataFrame([("k", "D0", "x", verdict, "valid", None, None, False, 1, 1)], profiled.ROW)
    one, two = a.ledger.transaction(), b.ledger.transaction()
    one.append("decisions", row("YES"))
    two.append("decisions", row("NO"))
    two.commit(), one.commit()
    assert [r["verdict"] for r in a.read().collect()] == ["NO"]
