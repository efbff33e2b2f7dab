"""State tables on disk, the corpus in files, worklists, and the context's texts."""

import json

import pytest
from pyspark.sql import functions as F

from prospector.operators import context, corpus, reports, runs, splits, state


def rows(spark, name, values):
    table = spark.createDataFrame([], state.TABLES[name].schema)
    df = spark.createDataFrame(values, "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in values[0]))
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in values[0]})


def test_store(spark, tmp_path):
    store = state.Store(spark, f"{tmp_path}/s")
    commit = lambda seq, message, patch: {"seq": seq, "repository": "r", "sha": "c", "message": message, "patch_id": patch}
    store.write("commits", rows(spark, "commits", [commit(1, "one", None)]))
    store.write("commits", rows(spark, "commits", [commit(2, "two", "p"), commit(1, "old", "q")]))
    store.write("commits", rows(spark, "commits", [commit(3, "three", "z")]))
    got = store.read("commits").first()
    assert (got["message"], got["patch_id"], store.read("commits").count()) == ("three", "p", 1)
    result = lambda seq, verdict, finding: {"seq": seq, "repository": "r", "sha": "c", "config_hash": "h", "verdict": verdict}
    results = rows(spark, "adjudication_results", [result(1, "YES", "{}"), result(2, "NO", None)]).withColumn("finding", F.lit("{}"))
    store.save_adjudications(results)
    store.save_adjudications(results.where("seq = 2").withColumn("verdict", F.lit("YES")))
    assert [r["verdict"] for r in store.read("adjudication_results").collect()] == ["YES"] and store.read("findings").count() == 1
    asked = spark.createDataFrame([(1, "r", "head", "h", None, False, "{}", "{}"), (2, "r", "head", "h", None, False, "{}", "{}")], "seq int, repository string, snapshot string, config_hash string, request_hash string, dry_run boolean, config string, limits string")
    asked = asked.withColumn("started_at", F.current_timestamp())
    made, answers = state.create_runs(store.read("runs"), asked)
    assert sorted((r["seq"], r["created"]) for r in answers.collect()) == [(1, True), (2, False)]
    store.replace("runs", made)
    run = made.first()["run"]
    made = state.update_run(store.read("runs"), run, F.current_timestamp(), status="interrupted", error="x")
    made = state.update_run(made, run, F.current_timestamp(), status="completed", completed=True)
    assert [(r["status"], r["error"], r["completed_at"] is None) for r in made.collect()] == [("completed", None, False)]
    with pytest.raises(KeyError):
        state.update_run(made, "nobody", F.current_timestamp())
    store.replace("runs", made)
    store.write("snapshots", rows(spark, "snapshots", [{"seq": 1, "repository": "r", "head_sha": "head", "default_branch": "main"}]))
    store.write("run_commits", rows(spark, "run_commits", [{"seq": 1, "run": run, "repository": "r", "sha": "c", "position": 0, "status": "done"}]))
    assert store.export("triage", f"{tmp_path}/t") == 1 and store.export("findings", f"{tmp_path}/f", run) == 1 and store.export("manifests", f"{tmp_path}/m") == 1
    line = json.loads(spark.read.text(f"{tmp_path}/t").first()[0])
    assert line["sha"] == "c" and line["verdict"] is None and list(line) == sorted(line)
    assert json.loads(spark.read.text(f"{tmp_path}/m").first()[0])["commit_statuses"] == {"done": 1}
    assert {r["table"]: r["n"] for r in store.status().collect()}["commits"] == 1
    spark.createDataFrame([(99,)], "version int").write.mode("append").parquet(f"{tmp_path}/s/schema")
    with pytest.raises(ValueError, match="newer"):
        state.Store(spark, f"{tmp_path}/s")


def test_corpus_in_files(spark, tmp_path):
    advisories, commits = corpus.load(spark, f"{tmp_path}/none")
    assert advisories.count() == commits.count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c/advisories.jsonl").write_text('{"ghsa_id": "A"}\n\n{"id": "B"}\nnot json\n{"ghsa_id": ""}\n')
    lines = [{"ghsa_id": "A", "repo": "o/r", "sha": "AB", "message": "Fix CVE-2024-12345", "msg_class": "quiet", "role": "fix", "diff_path": "d/1"}, {"ghsa_id": "A", "repo": "o/r", "sha": "cd", "subject": "tidy"}]
    (tmp_path / "c/commits.jsonl").write_text("\n".join(map(json.dumps, lines)))
    advisories, commits = corpus.load(spark, f"{tmp_path}/c")
    got = [(r["sha"], r["host"], r["msg_class"], r["announcement_strength"], r["subject"], r["ordinal"], r["n_in_advisory"]) for r in commits.orderBy("ordinal").collect()]
    assert got == [("ab", "github.com", "announced", "identifier", "Fix CVE-2024-12345", 0, 2), ("cd", "github.com", "quiet", "none", "tidy", 1, 2)]
    assert [r["ghsa_id"] for r in corpus.without_commits(advisories, commits).collect()] == ["B"]
    assert [(r["was"], r["now"]) for r in corpus.reclassified(commits).collect()] == [("quiet", "announced")] and corpus.labelled(commits).count() == 1
    files = spark.createDataFrame([("d/1", bytearray(b"+x"))], "path string, content binary")
    assert sorted(r["diff"] for r in corpus.with_diffs(commits, files).collect()) == ["", "+x"]
    manifest = corpus.write_worklist(corpus.holdout_worklist(commits, advisories), f"{tmp_path}/w", "holdout", 5)
    assert manifest["items"] == 2 and manifest["blind"] and manifest["worklist_sha256"].startswith("sha256:") and spark.read.text(f"{tmp_path}/w").count() == 2
    assert json.loads(spark.read.text(f"{tmp_path}/w-manifest").first()[0])["task"] == "holdout"


def test_context_texts(spark):
    schema = "seq int, commit_sha string, commit_date string, commit_subject string, l0_class string, cwe_id string, severity string, affected_paths array<string>, evidence array<struct<revision:string,revision_sha:string,path:string,start_line:int,end_line:int,quoted_span:string>>, sink string, sink_symbols array<string>, fix_effect string, root_cause string, impact string, invariant string, fix_completeness string"
    repo = context.repository_reference("https://h/o/n.git/", "f" * 40, "main")
    none = context.compile_context(spark.createDataFrame([], schema), repo, 3).first()
    assert none["summary"] == "No confirmed security fixes were adjudicated in 3 scanned commits of o/n." and none["archetype"] == "library" and "Components" not in none["agent_brief"]
    one = [(k, f"{k}" * 12, at, "s", "path_traversal", "CWE-22", "high", None, [("commit", "x", "a/Src/server.go", 1, 2, "fs.Open(p); if(x)")], None, None, None, "cause", None, inv, None) for k, at, inv in ((1, "2014-01-01", "clean it"), (2, "2025-12-01T00:00:00Z", None), (3, "junk", "check it"))]
    c = context.compile_context(spark.createDataFrame(one, schema), repo, 9, spark.createDataFrame([("a/Src/server.go", "x fs.Open(p);  if(x) y")], "path string, content string"), F.lit("2026-01-01").cast("timestamp"), leads=2).first()
    assert [f["commit_sha"][0] for f in c["fingerprints"]] == ["3", "2", "1"] and c["leads_withheld"] == 2 and c["archetype"] == "server"
    risk = c["top_risks"][0]
    assert (risk["component"], risk["fix_count"], risk["severity"], risk["rationale"], list(risk["evidence"])) == ("src/server.go", 3, "high", "check it", ["3" * 12, "2" * 12, "1" * 12])
    assert c["remediation"]["guarded_fixes"] == 2 and c["remediation"]["coverage"] == 66.7 and c["shared_surfaces"][0]["surface"] == "Path Traversal"
    brief = c["agent_brief"].split("\n")
    assert "- src/server.go — 3 past fix(es): path_traversal | known dangerous symbols: fs.Open" in brief and "- path_traversal in src/server.go (3 fix(es), peak high): check it" in brief and "    guard: fs.Open" in brief
    assert json.loads(context.summary_payload(context.compile_context(spark.createDataFrame(one, schema), repo, 9)).first()[0])["component_counts"] == {"src/server.go": 3}


def test_small_reports(spark):
    rows_ = spark.createDataFrame([("b", "a" * 40, "YES", True, 1.0), ("b", "c" * 40, "NO", True, 1.0), ("b", "d" * 40, "YES", False, None)], "backend string, sha string, verdict string, truth_is_fix boolean, agreement double")
    rows_ = rows_.selectExpr("*", "2.0D AS elapsed_s", "1 AS tool_calls", "10 AS prompt_tokens", "1 AS completion_tokens")
    line = reports.summary_line(reports.backend_summary(rows_)).first()["line"]
    assert line == "b        n=3   precision=  50% recall=  50%  TP=1   FP=1   miss=1  "
    values = spark.createDataFrame([(k % 2, v) for k, v in enumerate([5, 1, 9, 1, 7, None, 3])], "g int, v int")
    assert {r["g"]: r["quantile"] for r in runs.quantile(values, ["g"], "v", 0.5).collect()} == {0: 7, 1: 1}
    with pytest.raises(Exception, match="identity"):
        ids = spark.createDataFrame([(None, None)], "id string, repo string")
        ids.select(splits.record_ids(ids)).collect()
    with pytest.raises(Exception, match="not a time"):
        spark.range(1).select(splits.timestamp_of(F.lit("soon"))).collect()
    with pytest.raises(Exception, match="two independent"):
        one = spark.createDataFrame([("k", "ann", "h1")], "key string, annotator string, record_id string")
        corpus.adjudication(one, ["key"], spark.createDataFrame([("k",)], "key string")).collect()
