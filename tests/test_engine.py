"""Engine operators: goldens, each query against its SQL, and sources, sinks and streams."""

import datetime
import subprocess

import duckdb
import pytest
from pyspark.sql import functions as F

from prospector.functions import stats, text
from prospector.operators import evaluation, graph, logs
from prospector.plans import catalog, contexts, corpus, histories, reports, reviews, runs, states, streams  # noqa: F401  the others add their queries to the catalog
from prospector.sources import records
from prospector.sources.git import GitSource
from prospector.streaming import stages

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def test_rates(spark):
    low, high = stats.wilson(F.lit(50), F.lit(100))
    assert one(spark, low) == pytest.approx(0.4038, abs=2e-4) and one(spark, high) == pytest.approx(0.5962, abs=2e-4)
    assert one(spark, stats.zero_event_bound(F.lit(100))) < 0.03
    assert one(spark, stats.alerts_per_1000(F.lit(0.95), F.lit(0.01), F.lit(0.015))) == pytest.approx(24.1)
    assert one(spark, stats.cascade_cost(F.lit(0.002), F.lit(0.02), F.lit(0.2))) == pytest.approx(0.006)
    now = F.lit("2026-01-01").cast("timestamp")
    assert one(spark, stats.recency_weight(F.lit("2024-01-02").cast("timestamp"), now)) == pytest.approx(0.5, abs=0.02)
    assert one(spark, stats.recency_weight(F.lit(None).cast("timestamp"), now)) == 0.5 and one(spark, stats.recency_weight(F.lit("2030-01-01").cast("timestamp"), now)) == 1.0


def test_confusion(spark):
    rows = [("fix", "YES"), ("fix", "NO"), ("fix", None), ("other", "YES"), ("other", "NO"), ("other", "ERROR"), ("backport", "YES")]
    r = evaluation.confusion(spark.createDataFrame(rows, "truth string, prediction string")).first()
    assert (r["tp"], r["fn"], r["fp"], r["tn"], r["uncovered_positive"], r["uncovered_negative"], r["excluded"]) == (1, 1, 1, 1, 1, 1, 1)
    assert r["recall"] == pytest.approx(1 / 3) and r["fpr"] == pytest.approx(1 / 3) and r["coverage"] == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="unsupported"):
        evaluation.confusion(spark.createDataFrame([("what", "YES")], "truth string, prediction string")).collect()


def test_folds(spark):
    v = spark.createDataFrame([(1, False), (1, False), (2, False), (2, None), (3, None), (3, True)], "k int, v boolean")
    assert {r["k"]: r["x"] for r in v.groupBy("k").agg(evaluation.fold_verdicts(F.col("v")).alias("x")).collect()} == {1: False, 2: None, 3: True}
    votes = spark.createDataFrame([(1, 1, "YES", 2), (1, 2, "YES", 2), (1, 3, "NO", 0), (2, 1, "YES", 1), (2, 2, None, 0), (2, 3, "NO", 0)], "k int, round int, verdict string, anchors int")
    got = {r["k"]: tuple(r)[1:] for r in evaluation.consensus(votes, "k", 3).collect()}
    assert got == {1: ("YES", 1, 0.67, False), 2: ("ABSTAIN", None, 0.5, True)}


def test_bootstrap(spark):
    rows = spark.createDataFrame([("a", "fix", "YES"), ("a", "other", "YES"), ("b", "fix", "NO"), ("b", "other", "NO")], "repository string, truth string, prediction string")
    assert tuple(evaluation.block_bootstrap(rows, samples=100, seed=19).first()) == (0.0, 1.0, 0.0, 1.0)


def test_text(spark):
    terms = lambda s: one(spark, text.matched_terms(F.lit(s)))
    assert terms("fix sql injection here") == ["sql injection"] and terms("sql injection and other injection") == ["injection", "sql injection"]
    assert terms("enforce the source") == [] and terms("use-after-free in x") == ["use after free"]
    assert [one(spark, text.strict_answer(F.lit(s))) for s in (" YES\n", "NO", "yes", "YES because", "")] == [True, False, None, None, None]
    assert one(spark, text.redact(F.lit("CVE-2024-1234: sql injection"))) == "[redacted]: sql [redacted]"
    assert one(spark, text.normalise_component(F.lit("a/b/./Src\\X"))) == "src/x"
    assert one(spark, F.size(text.file_sections(F.lit("x\ndiff --git a b\n+1\ndiff --cc c\n")))) == 2


def test_groups(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "x", "p"), ("c", None, "p"), ("d", "y", None), ("e", "y", None), ("f", None, None)], "id string, adv string, grp string")
    assert {r["id"]: r["group"] for r in graph.linked_groups(rows, "id", ["adv", "grp"]).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_temporal_holdout(spark):
    rows = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-03-01"), ("b", "2024-02-01"), ("c", "2024-04-01"), ("d", "2024-04-01")], "g string, at string")
    split = lambda **o: {r["g"] for r in graph.temporal_holdout(rows, "g", "at", **o).collect() if r["split"] == "holdout"}
    assert split(target=1) == {"d"} and split(target=3) == {"d", "c", "a"} and split(target=0) == set() and split(cutoff="2024-03-01") == {"a", "c", "d"}
    with pytest.raises(ValueError):
        split()
    assert graph.temporal_holdout(rows.limit(0), "g", "at", 3).count() == 0


def test_logs(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 2), (2, "e", 1), (None, "f", 3), (None, "f", 4)], "k int, v string, seq int")
    assert sorted(map(tuple, logs.insert_new(old, new, ["k"], "seq").collect()), key=repr) == [(1, "a"), (2, "e"), (None, "b"), (None, "f"), (None, "f")]
    logs.export(spark.createDataFrame([(2, None), (1, "x")], "b int, a string"), f"{tmp_path}/out", ["b"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a":"x","b":1}', '{"a":null,"b":2}']


def test_readers(spark, tmp_path):
    at = tmp_path / "x.jsonl"
    at.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    lenient = records.read_json_lines(spark, str(at), records.StructType([records.StructField("a", records.StringType())]), strict=False)
    assert sorted(r["a"] for r in lenient.collect()) == ["1", "2"]
    with pytest.raises(Exception):
        records.read_json_lines(spark, str(at), lenient.schema).collect()
    (tmp_path / "t.json").write_text('{"entries": [{"sha": "AB", "repo": "r", "role": "fix"}]}')
    assert tuple(records.read_truth(spark, str(tmp_path / "t.json")).first()) == ("r", "ab", "fix", "medium", "unknown")
    (tmp_path / "c.json").write_text('{"CWE-79": [{"id": "CWE-89"}, "CWE-79"]}')
    assert sorted(r["id"] for r in records.read_weakness_ids(spark, str(tmp_path / "c.json")).collect()) == ["CWE-79", "CWE-89"]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    run("add", "."), run("commit", "-qm", "root")
    run("mv", "a.txt", "b.txt"), run("commit", "-qm", "rename\n\nbody")
    run("checkout", "-qb", "side"), (tmp_path / "c.txt").write_text("c\n"), run("add", "."), run("commit", "-qm", "side")
    run("checkout", "-q", "main"), (tmp_path / "d.txt").write_text("d\n"), run("add", "."), run("commit", "-qm", "main"), run("merge", "-q", "--no-ff", "-m", "merge", "side")
    spark.dataSource.register(GitSource)
    rows = records.derived(spark.read.format("git_commits").option("path", str(tmp_path)).option("slice", 2).load()).collect()
    by = {r["message"].split("\n")[0]: r for r in rows}
    assert len(rows) == 5 and by["merge"]["is_merge"] and by["root"]["is_root"]
    assert [tuple(p) for p in by["rename"]["changed_paths"]] == [("R100", "b.txt", "a.txt")] and [p["path"] for p in by["merge"]["changed_paths"]] == ["c.txt"]
    assert by["rename"]["message"] == "rename\n\nbody" and b"+one" in bytes(by["root"]["patch"])
    assert spark.read.format("git_commits").option("path", str(tmp_path)).option("last", 2).load().count() == 2


def test_streams(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, t(1), "click", 1.0), (1, t(2), "click", 2.0), (2, t(3), "view", 3.0)]
    spark.createDataFrame(rows, "user_id int, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id int, ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    q = stages.windowed_status(stream).writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(60)
    assert sorted((r["event_type"], r["n"], r["total"]) for r in spark.table("status").collect()) == [("click", 2, 3.0), ("view", 1, 3.0)]
    write = stages.keyed_sink(f"{tmp_path}/sink", ["user_id"], "ts")
    for c in ("c2", "c3"):  # the second run starts afresh and changes nothing
        q = stream.writeStream.foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{c}").start()
        q.awaitTermination(60)
    assert sorted((r["user_id"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [(1, 1.0), (2, 3.0)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_chunks():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from prospector.functions import diffs

    line = st.text(alphabet="ab é\U0001f600+-@", max_size=30)
    section = st.builds(lambda h, hunks: f"diff --git a/{h} b/{h}\n+++ b/{h}\n" + "".join("@@ -1 +1 @@\n" + "".join(f"+{x}\n" for x in xs) for xs in hunks), st.sampled_from("xyz"), st.lists(st.lists(line, max_size=8), max_size=4))

    @settings(max_examples=150, deadline=None)
    @given(st.lists(section, max_size=4), st.integers(30, 200))
    def holds(sections, most):
        diff = "".join(sections)
        if 41 < most < 45 and any(ord(c) > 127 for c in diff):  # beside the repeated headers there may be no room for one character
            return
        out = diffs.chunks_of(diff, most, "#\n")
        out = [c for c, _ in out]
        assert all(diffs.size(c) <= most and c.startswith("#\n") for c in out)
        rest = "".join(c[2:] for c in out)
        at = 0
        for ch in diff:  # all of the diff is there, in order
            at = rest.index(ch, at) + 1

    holds()
    one, two = "diff --git a/x b/x\n@@ -1 +1 @@\n+1\n", "diff --git a/x b/x\n@@ -2 +2 @@\n+2\n"
    assert diffs.chunks_of(one + two.split("\n", 1)[1], 42) == [(one, ["x"]), (two, ["x"])]
    hunk = "diff --git a/x b/x\n@@@ -1,9 +1,9 @@@\n"  # every piece of a long hunk begins with the file's header and the hunk's
    assert diffs.chunks_of(hunk + "+aaaa\n+bbbb\n+cccc\n", 45) == [(hunk + f"+{c * 4}\n", ["x"]) for c in "abc"]


def test_hunks(spark):
    from prospector.functions import diffs

    d = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1 @@ def f\n-  a(b)\n-# note\n+a(b)\n@@ -9 +9,2 @@\n-x\n+y(1)\n+# noqa\n"
    h = spark.createDataFrame([(d,)], "d string").select(F.explode(diffs.hunks(F.col("d"))).alias("h"))
    got = h.select("h.path", "h.old_start", "h.old_count", "h.new_count", diffs.cosmetic(F.col("h.lines"), F.col("h.path")), diffs.changed_calls(F.col("h.lines"))).collect()
    assert [tuple(r) for r in got] == [("x.py", 1, 2, 1, False, ["a"]), ("x.py", 9, 1, 2, False, ["y"])]
    assert one(spark, diffs.cap(F.lit("é" * 30), 40)) == "é" * 13 + diffs.CUT
    normal = lambda line, path: one(spark, diffs.normal_line(F.lit(line), F.lit(path)))
    assert [normal(x, p) for x, p in (("  a  b ", "x.py"), ("  a  b ", "x.go"), ("  a  b ", "x.md"), ("# Title", "x.md"), ("# t", "x.py"), ("#!/x", "x.sh"), ("//go:build x", "x.go"), ("// y", "x.go"), ("  ", "x.c"))] == ["2:a  b", "a b", "  a  b", "# Title", None, "#!/x", "//go:build x", None, None]


EVIDENCE = "array<struct<revision:string,revision_sha:string,path:string,start_line:int,end_line:int,quoted_span:string>>"


def test_attribution(spark):
    from prospector.operators import attribution

    commits = spark.createDataFrame(
        [("e", 5, ["c", "b"], ["x"], [], "pe"), ("b", 4, ["a"], ["x"], ["fix it"], "p1"), ("a", 3, ["0"], ["x", "y"], ["else"], "p2"), ("c", 2, ["0"], ["z"], [], "p3"), ("0", 1, [], [], [], None)],
        "sha string, place int, parents array<string>, paths array<string>, added array<string>, patch_id string",
    )
    at = lambda path, quote, kind="commit": [(kind, "e", path, 1, 1, quote)]
    rows = [(1, "e", ["y"], at("y", "q")), (2, "e", ["x"], at("x", " fix   it ")), (3, "e", ["x"], at("x", "none")), (4, "c", ["z"], []), (5, "e", [], []), (6, "e", ["w"], []), (7, "q", ["x"], [])]
    found = spark.createDataFrame(rows, f"seq int, sha string, affected_paths array<string>, evidence {EVIDENCE}")
    got = {r["seq"]: (r["attributed"], r["method"]) for r in attribution.attribute(found, commits).collect()}
    assert got == {1: ("a", "merge_first_parent_walk"), 2: ("b", "merge_evidence_content"), 3: ("e", "ambiguous"), 4: ("c", "direct"), 5: ("e", "unchanged"), 6: ("e", "unchanged"), 7: ("q", "unchanged")}
    blobs = spark.createDataFrame([("a", "y", "other\n"), ("b", "x", "fix it\nmore")], "sha string, path string, content string")
    kept, moves, twice = attribution.apply(found, commits, blobs)
    kept = {r["seq"]: (r["sha"], r["method"]) for r in kept.collect()}
    # 1 stays as its quote is not in a:y, 2 moves to b, and what else is on the merge folds into 1
    assert kept == {1: ("e", "declined_anchor_mismatch"), 2: ("b", "merge_evidence_content"), 4: ("c", "direct"), 7: ("q", "unchanged")}
    assert [tuple(r) for r in moves.collect()] == [("b", "e", "merge_evidence_content")]
    assert {(r["sha"], r["duplicate_of"]) for r in twice.collect()} == {("e", "e")}
    rows = found.where("seq IN (3, 4, 7)").unionByName(found.where("seq = 2").selectExpr("seq", "'b' AS sha", "affected_paths", "evidence")).withColumn("attributed_from", F.lit(None).cast("string"))
    kept, folded = attribution.collapse(rows, commits)
    assert sorted(r["seq"] for r in kept.collect()) == [2, 4, 7] and [tuple(r) for r in folded.collect()] == [("e", None, "b", "")]


def test_duplicates_name_the_best_so_far(spark):
    from prospector.operators import attribution

    ev = lambda n: [("commit", "x", "p", 1, 1, "q")] * n
    rows = [(1, "c", "p", ev(1), None), (2, "b", "p", ev(2), "m"), (3, "a", "p", ev(2), None), (4, "0", "p", ev(2), None), (5, "f", None, ev(0), None), (6, "d", "q", ev(0), None)]
    found = spark.createDataFrame(rows, f"seq int, sha string, patch_id string, evidence {EVIDENCE}, attributed_from string")
    kept, dropped = attribution.deduplicate(found)
    assert sorted((r["seq"], r["sha"]) for r in kept.collect()) == [(1, "0"), (5, "f"), (6, "d")]
    assert sorted(map(tuple, dropped.collect()), key=repr) == [("a", None, "0", "p"), ("b", "m", "a", "p"), ("c", None, "b", "p")]


def test_profiles(spark):
    from prospector.functions import diffs, profiles

    vendor = "diff --git a/vendor/x.go b/vendor/x.go\nindex 1a..2b 100644\n--- a/vendor/x.go\n+++ b/vendor/x.go\n@@ -1 +1 @@\n-a\n+b\n"
    own = "diff --git a/src/m.py b/src/m.py\r\nindex 1a..2b 100644\r\n--- a/src/m.py\r\n+++ b/src/m.py\r\n@@ -1 +1 @@\r\n-a\r\n+b"
    rows = [(1, vendor + own), (2, vendor), (3, "no diff"), (4, " \n"), (5, None)]
    d = spark.createDataFrame(rows, "k int, diff string")
    first = {r["k"]: r for r in profiles.input_profile(d, "D1", "diff").collect()}
    assert [first[k]["status"] for k in range(1, 6)] == ["ready", "empty_first_party", "malformed", "empty", "empty"]
    assert first[1]["text"] == "diff --git a/src/m.py b/src/m.py\n--- a/src/m.py\n+++ b/src/m.py\n@@ -1 +1 @@\n-a\n+b\n" and first[1]["excluded_paths"] == ["vendor/x.go"]
    assert first[1]["change_kinds"] == ["source", "generated_vendor"] and first[3]["error"] == "input is not a recognizable Git diff"
    two = profiles.input_profile(d.where("k = 1"), "D2", "diff", subject=F.lit("\r\nlater")).first()
    assert two["text"].startswith("### Commit subject\n(empty)\n\n### Diff\ndiff --git a/src") and two["chunks"][0]["paths"] == ["src/m.py"]
    assert profiles.input_profile(d.where("k = 1"), "D3", "diff", message=F.lit("m" * 90), most=60).first()["status"] == "oversize"
    assert profiles.input_profile(d.where("k = 1"), "D0", "diff").first()["text"] == vendor + own
    patch = 'diff --git a/o b/n\nrename from o\nrename to "\\303\\251"\ndiff --git a/k b/k\nnew file mode 1\n--- /dev/null\n+++ b/k k\ndiff --git a/d b/d\ndeleted file mode 1\n--- a/d\n+++ /dev/null\ndiff --git a/m b/m\n'
    got = [tuple(x) for x in one(spark, diffs.changed_paths(F.lit(patch)))]
    assert got == [("R100", "é", "o"), ("A", "k k", None), ("D", "d", None), ("M", "m", None)]
    assert diffs.names_of('diff --git "a/x y" "b/x y"\n') == ("x y", "x y", "x y") and diffs.names_of("diff --cc z\n")[2] == "z"


def test_poisson_weights_and_keys_of_any_type(spark):
    import math

    share = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    drawn = {r["w"]: r["n"] for r in share.groupBy(evaluation.poisson_weight(F.col("u")).alias("w")).agg(F.count("*").alias("n")).collect()}
    assert all(abs(drawn[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 1e-4 for k in range(6))
    rows = spark.createDataFrame([(f"r{k}", "fix" if k % 3 else "context", "YES" if k % 2 else "NO") for k in range(60)], "repository string, truth string, prediction string")
    one = evaluation.poisson_bootstrap(rows, samples=200).first()
    assert one == evaluation.poisson_bootstrap(rows.repartition(7), samples=200).first() and one["recall_low"] < 0.5 < one["recall_high"]
    assert tuple(evaluation.poisson_bootstrap(rows.limit(0), samples=5).first()) == (None,) * 4
    keys = spark.createDataFrame([(x, "fix", "YES") for x in ("2", "10", '"a"', "true", "null", None, "oops", "1.5", "[1]", '{"a":1}', '"2"', "2")], "k string, truth string, prediction string")
    got = evaluation.confusion_by_any(keys, F.col("k")).orderBy("place").select("kind", "text", "tp").collect()
    assert [tuple(r) for r in got] == [("NoneType", "null", 3), ("bool", "true", 1), ("dict", '{"a":1}', 1), ("float", "1.5", 1), ("int", "10", 1), ("int", "2", 2), ("list", "[1]", 1), ("str", '"2"', 1), ("str", '"a"', 1)]
