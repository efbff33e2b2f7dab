"""Queries of the state tables over the shared tables, beside their SQL: users as commits, their events as writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.operators import graph, state
from prospector.plans.catalog import DECISIONS, C, decisions, load, query


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], state.TABLES[name].schema)


def writes(spark, d) -> DataFrame:
    e = decisions(spark, d).withColumn("created_at", C("ts").cast("timestamp"))
    return e.withColumn("sha", C("item").cast("string"))


def padded(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with the columns of a table that it lacks, as nulls."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in df.columns})


@query(f"""WITH {DECISIONS} SELECT 's' || repository AS canonical_source, min_by(run, seq) FILTER (seq % 2 = 0) AS first_source, arg_max(run, seq) FILTER (seq % 2 = 1) AS source, CAST(arg_max(ts, seq) FILTER (seq % 2 = 0) AS TIMESTAMP) AS created_at FROM dec GROUP BY repository""".replace("min_by(run, seq) FILTER (seq % 2 = 0) AS first_source, ", ""))
def repositories_upsert(spark, d):
    """Two writes: all but the time of creation is replaced."""
    e = writes(spark, d).select("seq", F.concat(F.lit("s"), "repository").alias("canonical_source"), "repository", C("run").alias("source"), "created_at")
    old = state.written("repositories", empty(spark, "repositories"), padded(e.where("seq % 2 = 0"), empty(spark, "repositories")))
    out = state.written("repositories", old, padded(e.where("seq % 2 = 1"), old))
    return out.select("canonical_source", "source", C("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"""WITH {DECISIONS}, a AS (SELECT repository, item, arg_max(truth, seq) AS message, arg_max(CASE WHEN value > 50 THEN run ELSE '' END, seq) AS patch FROM dec WHERE seq % 2 = 0 GROUP BY ALL),
  b AS (SELECT repository, item, arg_max(truth, seq) AS message, arg_max(CASE WHEN value > 50 THEN run ELSE '' END, seq) AS patch FROM dec WHERE seq % 2 = 1 GROUP BY ALL)
  SELECT repository, CAST(item AS VARCHAR) AS sha, coalesce(b.message, a.message) AS message, coalesce(nullif(a.patch, ''), nullif(b.patch, '')) AS patch_id FROM a FULL JOIN b USING (repository, item)""")
def commits_upsert(spark, d):
    """Metadata is replaced; a patch id stays once it is known."""
    e = writes(spark, d).select("seq", "repository", "sha", C("truth").alias("message"), F.when(C("value") > 50, C("run")).alias("patch_id"))
    none = empty(spark, "commits")
    old = state.written("commits", none, padded(e.where("seq % 2 = 0"), none))
    return state.written("commits", old, padded(e.where("seq % 2 = 1"), none)).select("repository", "sha", "message", "patch_id")


@query(f"""WITH {DECISIONS}, a AS (SELECT run, item, arg_max(prediction, seq) AS status, arg_max(CASE WHEN value > 50 THEN truth ELSE '' END, seq) AS t, max(seq) AS position FROM dec WHERE seq % 2 = 0 GROUP BY ALL),
  b AS (SELECT run, item, arg_max(prediction, seq) AS status, arg_max(CASE WHEN value > 50 THEN truth ELSE '' END, seq) AS t, max(seq) AS position FROM dec WHERE seq % 2 = 1 GROUP BY ALL)
  SELECT run, CAST(item AS VARCHAR) AS sha, coalesce(b.status, a.status) AS status, coalesce(b.position, a.position) AS position, coalesce(nullif(b.t, ''), nullif(a.t, '')) AS triage_status FROM a FULL JOIN b USING (run, item)""")
def checkpoints(spark, d):
    """Status and place are replaced; a stage's status stays where the new one is null."""
    e = writes(spark, d).select("seq", "run", F.lit("r").alias("repository"), "sha", C("seq").alias("position"), C("prediction").alias("status"), F.when(C("value") > 50, C("truth")).alias("triage_status"))
    none = empty(spark, "run_commits")
    old = state.written("run_commits", none, padded(e.where("seq % 2 = 0"), none))
    return state.written("run_commits", old, padded(e.where("seq % 2 = 1"), none)).select("run", "sha", "status", "position", "triage_status")


@query(f"WITH {DECISIONS}, k AS (SELECT repository, item, run, min(seq) AS seq, arg_min(prediction, seq) AS verdict FROM dec GROUP BY ALL) SELECT repository, CAST(item AS VARCHAR) AS sha, run AS config_hash, verdict, seq % 3 = 0 AND verdict = 'YES' AS finding FROM k")
def adjudication_saves(spark, d):
    """The first result of each key stays; only a YES with a finding leaves one."""
    finding = F.when(C("seq") % 3 == 0, F.concat(F.lit("f"), "seq"))
    e = writes(spark, d).select("seq", "repository", "sha", C("run").alias("config_hash"), C("prediction").alias("verdict"), finding.alias("finding"), "created_at")
    none = empty(spark, "adjudication_results")
    first = state.logs.earliest(e, ["repository", "sha", "config_hash"])
    results = state.written("adjudication_results", none, padded(e, none))
    found = state.written("findings", empty(spark, "findings"), state.finding_rows(first)).select("repository", "sha", "config_hash", F.lit(True).alias("finding"))
    return results.join(found, ["repository", "sha", "config_hash"], "left").select("repository", "sha", "config_hash", "verdict", F.coalesce("finding", F.lit(False)).alias("finding"))


@query(f"""WITH {DECISIONS}, k AS (SELECT item, run, min(seq) AS seq, arg_min(CAST(floor(value) AS BIGINT), seq) AS v FROM dec GROUP BY ALL)
  SELECT run AS stage, CAST(item AS VARCHAR) AS sha, CASE WHEN seq % 3 = 2 THEN NULL ELSE v END AS input_tokens, CASE WHEN seq % 3 = 1 THEN v + 1 END AS output_tokens, CASE seq % 3 WHEN 0 THEN v + 7 WHEN 1 THEN v + v + 1 END AS total_tokens, CASE WHEN seq % 3 = 0 THEN 0.25 WHEN seq % 3 = 1 THEN 0.5 END AS estimated_cost FROM k""")
def usage_records(spark, d):
    """Usage under the names of several services: a missing total is that of its parts, a cost that is not finite is null."""
    v = F.floor("value")
    usage = F.when(C("seq") % 3 == 0, F.to_json(F.struct(v.alias("input_tokens"), (v + 7).alias("total_tokens"), F.lit(0.25).alias("cost")))).when(C("seq") % 3 == 1, F.to_json(F.struct(v.alias("prompt_tokens"), (v + 1).alias("completion_tokens"), F.lit(0.5).alias("estimated_cost_usd")))).otherwise('{"cost":"NaN"}')
    e = writes(spark, d).select("seq", C("run").alias("stage"), F.lit("r").alias("repository"), "sha", F.lit("c").alias("config_hash"), F.lit("x").alias("run"), "created_at", usage.alias("usage"))
    none = empty(spark, "usage_records")
    return state.written("usage_records", none, state.usage_rows(e)).select("stage", "sha", "input_tokens", "output_tokens", "total_tokens", "estimated_cost")


@query(f"WITH {DECISIONS}, e AS (SELECT seq, run AS kind, CASE WHEN seq % 5 > 0 THEN CAST(item AS VARCHAR) END AS sha FROM dec) SELECT kind, sha, min(seq) AS message FROM e WHERE sha IS NOT NULL GROUP BY ALL UNION ALL SELECT kind, sha, seq FROM e WHERE sha IS NULL")
def error_records(spark, d):
    """An error is kept once for each key; without a commit each one is kept."""
    e = writes(spark, d).select("seq", F.lit("triage").alias("stage"), C("run").alias("kind"), C("seq").cast("string").alias("message"), F.lit("r").alias("repository"), F.when(C("seq") % 5 > 0, C("sha")).alias("sha"), F.lit("x").alias("run"), F.lit("c").alias("config_hash"))
    none = empty(spark, "errors")
    return state.written("errors", none, padded(e, none)).select("kind", "sha", C("message").cast("long").alias("message"))


def run_tables(spark, d) -> dict[str, DataFrame]:
    """Runs r0 to r6 over the customers of a nation; every commit is walked by two of them."""
    c = load(spark, d, "customer")
    k = C("c_custkey")
    repository = F.concat(F.lit("n"), C("c_nationkey"))
    asked = c.select(repository.alias("repository")).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("v"), "repository")
    asked = asked.select(F.col("v").alias("seq"), "repository", F.lit("head").alias("snapshot"), F.lit("cfg").alias("config_hash"), F.concat(F.lit("q"), "v").alias("request_hash"), F.lit(False).alias("dry_run"), F.lit("{}").alias("config"), F.lit("{}").alias("limits"), F.lit("2024-01-01").cast("timestamp").alias("started_at"))
    runs, answers = state.create_runs(empty(spark, "runs"), asked)
    walk = c.select(repository.alias("repository"), k.cast("string").alias("sha"), k.alias("position")).join(runs.select("run", "repository"), "repository")
    results = c.select(repository.alias("repository"), k.cast("string").alias("sha"), F.lit("cfg").alias("config_hash"), F.when(C("c_acctbal") > 5000, "YES").otherwise("NO").alias("verdict"), F.lit("2024-02-01").cast("timestamp").alias("created_at"), k)
    fill = lambda df, t: padded(df, empty(spark, t)).select(*empty(spark, t).columns)
    return {
        "runs": runs, "answers": answers, "snapshots": fill(asked.select("repository", F.lit("head").alias("head_sha"), F.lit("main").alias("default_branch")).distinct(), "snapshots"),
        "commits": fill(c.select(repository.alias("repository"), k.cast("string").alias("sha"), C("c_name").alias("message")), "commits"),
        "run_commits": fill(walk.select("run", "repository", "sha", "position", F.when(C("position") % 4 == 0, "failed").otherwise("done").alias("status"), F.when(C("position") % 3 == 0, "YES").alias("triage_status")), "run_commits"),
        "triage": fill(results.where(k % 2 == 0), "triage_results"), "adjudication": fill(results, "adjudication_results"), "findings": fill(results.where("verdict = 'YES'").withColumn("finding", F.lit("{}")), "findings"),
    }


@query("SELECT 'n' || c_nationkey AS repository, CAST(c_custkey AS VARCHAR) AS sha, c_custkey AS position, c_name AS message, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_acctbal > 5000 THEN 'YES' ELSE 'NO' END END AS verdict FROM customer")
def state_triage_export(spark, d):
    """Commits of all runs with their results, once though two runs walk over each."""
    t = run_tables(spark, d)
    return state.triage_export(t["run_commits"], t["runs"], t["commits"], t["triage"]).select("repository", "sha", "position", "message", "verdict")


@query("SELECT 'n' || c_nationkey AS repository, CAST(c_custkey AS VARCHAR) AS sha, c_name AS message, '{}' AS finding FROM customer WHERE c_acctbal > 5000")
def state_findings_export(spark, d):
    t = run_tables(spark, d)
    return state.findings_export(t["run_commits"], t["runs"], t["commits"], t["adjudication"], t["findings"]).select("repository", "sha", "message", "finding")


@query("SELECT 'n' || c_nationkey AS repository, 'main' AS default_branch, unnest([1, 2]) * 0 + count(*) FILTER (c_custkey % 4 = 0) AS failed, count(*) FILTER (c_custkey % 4 > 0) AS done, count(*) FILTER (c_custkey % 3 = 0) AS triaged, 0 AS adjudicated FROM customer GROUP BY c_nationkey")
def run_manifests(spark, d):
    """Headers of runs with their commits by status."""
    t = run_tables(spark, d)
    m = state.manifests(t["runs"], t["snapshots"], t["run_commits"])
    at = lambda s: F.coalesce(F.try_element_at("commit_statuses", F.lit(s)), F.lit(0)).alias(s)
    return m.select("repository", "default_branch", at("failed"), at("done"), "triaged", "adjudicated")


@query("WITH n AS (SELECT DISTINCT c_nationkey FROM customer) SELECT 'n' || c_nationkey AS repository, 2 AS runs, 2 AS created, 0 AS resumed FROM n")
def created_runs(spark, d):
    """One run for each five-part key; asking again resumes it."""
    t = run_tables(spark, d)
    again = t["runs"].select(F.lit(9).alias("seq"), "repository", "snapshot", "config_hash", "request_hash", "dry_run", "config", "limits", "started_at")
    runs, answers = state.create_runs(t["runs"], again)
    both = t["answers"].unionByName(answers).join(runs.select("run", "repository"), "run")
    return both.groupBy("repository").agg(F.count_distinct("run").cast("int").alias("runs"), F.count_if("created").cast("int").alias("created"), (F.count_if(~C("created")) - F.count_distinct("run")).cast("int").alias("resumed"))


# --- the commit log: all events in four transactions over three tables


def committed(spark, d) -> state.Store:
    """A store that all events went into by four commits of three tables each, put together once in between."""
    store = state.Store(spark, f"{graph.shared_dir(spark)}/store-{uuid.uuid4().hex}")
    e = writes(spark, d)
    for k in range(4):
        own = e.where(C("seq") % 4 == k)
        walked = own.select("seq", "run", "repository", "sha", C("seq").alias("position"), C("prediction").alias("status"), F.when(C("value") > 50, C("truth")).alias("triage_status"))
        metadata = own.select("seq", "repository", "sha", C("truth").alias("message"), F.when(C("value") > 50, C("run")).alias("patch_id"))
        failed = own.select("seq", C("prediction").alias("stage"), C("truth").alias("kind"), C("seq").cast("string").alias("message"), "repository", F.when(C("item") % 6 > 0, C("sha")).alias("sha"), "run", F.lit("h").alias("config_hash"), "created_at")

        def work(w, walked=walked, metadata=metadata, failed=failed):
            for name, rows in (("run_commits", walked), ("commits", metadata), ("errors", failed)):
                w.write(name, padded(rows, empty(spark, name)))

        store.transact(work)
        if k == 1:
            store.ledger.compact("run_commits")
            store.ledger.compact("errors")
    return store


@query(f"""WITH {DECISIONS}, v AS (SELECT run, repository, item, seq % 4 AS v, arg_max(prediction, seq) AS status, max(seq) AS position, arg_max(CASE WHEN value > 50 THEN truth ELSE '' END, seq) AS t FROM dec GROUP BY ALL)
  SELECT run, repository, CAST(item AS VARCHAR) AS sha, arg_max(status, v) AS status, arg_max(position, v) AS position, arg_max(t, v) FILTER (t <> '') AS triage_status FROM v GROUP BY ALL""")
def ledger_checkpoints(spark, d):
    """Later commits win; a stage's status stays where later ones have none."""
    return committed(spark, d).read("run_commits").select("run", "repository", "sha", "status", "position", "triage_status")


@query(f"""WITH {DECISIONS}, v AS (SELECT repository, item, seq % 4 AS v, arg_max(truth, seq) AS message, arg_max(CASE WHEN value > 50 THEN run ELSE '' END, seq) AS p FROM dec WHERE seq % 4 < 3 GROUP BY ALL)
  SELECT repository, CAST(item AS VARCHAR) AS sha, arg_max(message, v) AS message, arg_min(p, v) FILTER (p <> '') AS patch_id FROM v GROUP BY ALL""")
def ledger_as_of(spark, d):
    """The commits as of the commit before the last of all: its readers don't see the last one."""
    store = committed(spark, d)
    return store.read("commits", store.ledger.version() - 1).select("repository", "sha", "message", "patch_id")


@query(f"""WITH {DECISIONS}, s AS (SELECT prediction AS stage, truth AS kind, repository, CASE WHEN item % 6 > 0 THEN CAST(item AS VARCHAR) END AS sha, run, seq FROM dec)
  SELECT stage, kind, repository, sha, run, CAST(arg_min(seq, (seq % 4, seq)) AS VARCHAR) AS message FROM s WHERE sha IS NOT NULL GROUP BY ALL
  UNION ALL SELECT stage, kind, repository, sha, run, CAST(seq AS VARCHAR) FROM s WHERE sha IS NULL""")
def ledger_inserts(spark, d):
    """The first row of a key stays over all commits; a null in a key equals nothing."""
    return committed(spark, d).read("errors").select("stage", "kind", "repository", "sha", "run", "message")
