"""python -m prospector: list and run queries, read a repository, show and export runs."""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.operators import context, corpus, evaluation, logs, profiled, reports, runs, stages, state
from prospector.operators.importing import Import, score_table
from prospector.plans import catalog, contexts, histories, states, streams  # noqa: F401  they add their queries to the catalog
from prospector.plans import corpus as corpus_queries  # noqa: F401
from prospector.plans import reports as report_queries  # noqa: F401
from prospector.plans import reviews as review_queries  # noqa: F401
from prospector.plans import runs as run_queries  # noqa: F401
from prospector.sources import git, records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prospector")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    q = sub.add_parser("query", help="run a query over a folder of tables")
    q.add_argument("name"), q.add_argument("--data", required=True), q.add_argument("--out")
    i = sub.add_parser("import", help="read a repository and run a stage over its commits; go on where an earlier run stopped")
    i.add_argument("--repo", required=True), i.add_argument("--store", required=True), i.add_argument("--stage", required=True, help="MODULE:FUNCTION, from a row to verdict, tokens and cost")
    i.add_argument("--config", default="default"), i.add_argument("--last", type=int), i.add_argument("--since"), i.add_argument("--range", dest="range")
    i.add_argument("--max-calls", type=int), i.add_argument("--max-tokens", type=int), i.add_argument("--max-cost", type=float), i.add_argument("--dry-run", action="store_true")
    r = sub.add_parser("review", help="import a repository with both stages into a store; asked for again, go on with the run")
    r.add_argument("--repo", required=True), r.add_argument("--store", required=True), r.add_argument("--mirrors", default="mirrors"), r.add_argument("--triage", required=True, help="MODULE:FUNCTION"), r.add_argument("--adjudicate", required=True, help="MODULE:FUNCTION")
    r.add_argument("--config", default="{}", help="JSON that tells configurations apart"), r.add_argument("--last", type=int), r.add_argument("--since"), r.add_argument("--range", dest="range"), r.add_argument("--workers", type=int, default=8)
    r.add_argument("--max-calls", type=int), r.add_argument("--max-tokens", type=int), r.add_argument("--max-cost", type=float), r.add_argument("--max-seconds", type=float), r.add_argument("--dry-run", action="store_true")
    for name, what in (("runs", "runs of a store, or one with its commits by status"), ("write", "triage, findings or manifests of a store as canonical JSON lines")):
        x = sub.add_parser(name, help=what)
        x.add_argument("--store", required=True), x.add_argument("--run")
        if name == "write":
            x.add_argument("--kind", choices=("triage", "findings", "manifests"), required=True), x.add_argument("--out", required=True)
    w = sub.add_parser("scan", help="scan a repository with both stages and write its context as a JSON document")
    w.add_argument("--repo", required=True), w.add_argument("--mirrors", default="mirrors"), w.add_argument("--triage", required=True, help="MODULE:FUNCTION"), w.add_argument("--adjudicate", required=True, help="MODULE:FUNCTION"), w.add_argument("--out", required=True)
    w.add_argument("--last", type=int), w.add_argument("--since"), w.add_argument("--range", dest="range"), w.add_argument("--candidates", type=int, help="most candidates that go on to review")
    e = sub.add_parser("score", help="contexts against a truth file: hits, false alarms and misses of each repository")
    e.add_argument("--contexts", required=True), e.add_argument("--truth", required=True), e.add_argument("--json", action="store_true")
    b = sub.add_parser("ablate", help="run profiles over the labelled commits of a corpus, with a cache of decisions, and select one")
    b.add_argument("--corpus", required=True), b.add_argument("--backend", required=True, help="MODULE:FUNCTION, from a text to an answer"), b.add_argument("--cache", required=True), b.add_argument("--profiles", default="D0,D1,D2,D3"), b.add_argument("--prevalence", type=float, default=0.015), b.add_argument("--out")
    for name, what in (("status", "figures of a run"), ("export", "results as canonical JSON lines")):
        s = sub.add_parser(name, help=what)
        s.add_argument("--store", required=True), s.add_argument("--config", default="default")
        if name == "export":
            s.add_argument("--out", required=True)
    return p


def commits(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    git.register(spark)
    read = spark.read.format("git_commits").option("path", a.repo)
    for option in ("last", "since", "range"):
        if getattr(a, option) is not None:
            read = read.option(option, getattr(a, option))
    return read.load().select(F.col("sha").alias("key"), "message", F.decode("patch", "UTF-8").alias("patch"))


def loaded(name: str):
    """What MODULE:NAME stands for."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"not MODULE:NAME: {name}")
    return getattr(import_module(module), attribute)


def store_command(spark: SparkSession, a: argparse.Namespace) -> int:
    store = state.Store(spark, a.store)
    if a.command == "review":
        limits = runs.Limits(calls=a.max_calls, tokens=a.max_tokens, cost=a.max_cost, seconds=a.max_seconds)
        told = Import(store, a.repo, a.mirrors, loaded(a.triage), loaded(a.adjudicate), json.loads(a.config), limits, a.workers).go(a.dry_run, 100 if a.last is None and a.since is None and a.range is None else a.last, a.since, a.range)
        print(json.dumps(told))
        return 0 if told["status"] in ("completed", "dry_run") else 3
    if a.command == "runs":
        for row in store.manifest_rows(a.run).select(F.to_json(F.struct("run", "status", "counters", "error", "commit_statuses", "triaged", "adjudicated")).alias("j")).collect():  # a row for each run
            print(row["j"])
        return 0
    print(json.dumps({"kind": a.kind, "rows": store.export(a.kind, a.out, a.run)}))
    return 0


def scan_command(spark: SparkSession, a: argparse.Namespace) -> int:
    """The context as one JSON document, and the funnel on the terminal."""
    pinned = git.snapshot(a.repo, a.mirrors)
    git.register(spark)
    read = spark.read.format("git_commits").option("path", pinned["path"]).option("patch_ids", "true")
    chosen = {k: getattr(a, k) for k in ("last", "since", "range") if getattr(a, k) is not None} or {"last": 100}
    commits = stages.runs_cut(read.options(**chosen, **({} if a.range else {"revision": pinned["head_sha"]})).load())
    touched = commits.select("sha", F.explode("changed_paths").alias("p")).select("sha", F.col("p.path").alias("path")).distinct()
    head = spark.read.format("git_files").option("path", pinned["path"]).option("revision", pinned["head_sha"]).load().select("path", F.decode("content", "UTF-8").alias("content"))
    repo = context.repository_reference(a.repo, pinned["head_sha"], pinned["default_branch"])
    compiled, funnel = stages.scan(commits, git.blobs_at(touched, pinned["path"]), loaded(a.triage), loaded(a.adjudicate), repo, head, most_candidates=a.candidates)
    compiled.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(a.out)
    print(json.dumps({"out": a.out, "funnel": {f"{r['stage']}.{r['outcome']}": r["n"] for r in funnel.collect()}}))  # a row for each outcome
    return 0


def score_command(spark: SparkSession, a: argparse.Namespace) -> int:
    scores = evaluation.score_truth(records.read_emitted(spark, a.contexts), records.read_truth(spark, a.truth).select("repository", "sha", "role"))
    print("\n".join(scores.toJSON().collect()) if a.json else score_table(scores))  # a row for each repository
    return 0


def ablate_command(spark: SparkSession, a: argparse.Namespace) -> int:
    """Figures of each profile over labelled commits, and the one to take; 4 if none qualifies."""
    _, rows = corpus.load(spark, a.corpus)
    labelled = corpus.labelled(corpus.unique_commits(rows))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.corpus)
    root = F.substring_index("path", "/" + a.corpus.rstrip("/").rpartition("/")[2] + "/", -1)
    shown = corpus.with_diffs(labelled, files.select(root.alias("path"), "content")).withColumn("sha", F.concat_ws("@", "repo", "sha"))
    run = profiled.run_profiles(shown.select("sha", "diff", "subject", "message"), loaded(a.backend), profiled.Decisions(spark, a.cache), a.profiles.split(","), a.backend)
    facts = shown.select("sha", F.col("role").alias("truth"), F.col("msg_class").alias("message_class"))
    none, zero = F.lit(None), F.lit(0).cast("long")
    scored = run.join(facts, "sha").select(
        "profile", F.col("sha").alias("id"), "truth", F.col("verdict").alias("prediction"), "message_class", zero.alias("input_tokens"), zero.alias("output_tokens"), F.col("tokens").alias("total_tokens"), none.cast("double").alias("cost"),
        F.when(F.col("cache_hit"), 0).otherwise(1).cast("long").alias("calls"), zero.alias("retries"),
    )
    summary = stages.runs_cut(reports.profile_summary(scored))
    if a.out:
        summary.coalesce(1).write.mode("overwrite").json(a.out)
    for row in summary.select("profile", "recall", "fpr", "precision", "coverage", "quiet_recall", "qualifies").orderBy("profile").collect():  # four profiles at most
        print(json.dumps(row.asDict()))
    chosen = reports.selected_profile(summary, a.prevalence).first().asDict()
    print(json.dumps(chosen))
    return 0 if chosen["selected"] else 4


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "queries":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    if a.command == "query" and a.name not in catalog.QUERIES:
        print(f"no query {a.name}")
        return 2
    spark = SparkSession.builder.getOrCreate()
    if a.command == "query":
        out = catalog.QUERIES[a.name](spark, a.data)
        out.write.mode("overwrite").parquet(a.out) if a.out else out.show(50, truncate=80)
        return 0
    if a.command in COMMANDS:
        return COMMANDS[a.command](spark, a)
    if a.command in ("review", "runs", "write"):
        return store_command(spark, a)
    if a.command == "import":
        items = commits(spark, a)
        if a.dry_run:
            print(json.dumps({"status": "dry_run", "planned": items.select("key").count()}))
            return 0
        limits = runs.Limits(calls=a.max_calls, tokens=a.max_tokens, cost=a.max_cost)
        told = runs.run_stage(items, loaded(a.stage), a.store, a.config, limits)
        print(json.dumps(told))
        return 0 if told["status"] == "completed" else 3
    done = runs.stored(spark, a.store).where(F.col("config") == a.config)
    if a.command == "status":
        print(json.dumps(runs.counters(done).first().asDict()))
    else:
        logs.export(done, a.out, ["key"])
    return 0


COMMANDS = {"scan": scan_command, "score": score_command, "ablate": ablate_command}


if __name__ == "__main__":
    raise SystemExit(main())
