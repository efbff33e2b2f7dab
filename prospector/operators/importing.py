"""Import a repository into a store: read, triage, review of candidates, all resumable under budgets; and reports on what came out."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.functions import text
from prospector.functions.calls import CANDIDATES
from prospector.operators import graph, runs, stages, state
from prospector.sources import git

VERSION = 1


def digest(spark: SparkSession, value: Any) -> str:
    canonical = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return spark.range(1).select(text.content_hash(F.lit(canonical))).first()[0]


def identity(function: Any) -> str:
    """What a callable is known by: its module and name, or those of its class."""
    return f"{getattr(function, '__module__', type(function).__module__)}:{getattr(function, '__qualname__', type(function).__qualname__)}"


class Import:
    """One run over one repository. Results are reused by the configuration's hash, so that only what is missing is asked for again.

    The run is known by repository, commit, configuration and request; asking for it again goes on where it stopped. Commits are read
    once; each stage goes in batches as large as the budgets allow, and every batch is stored before the next one starts.
    """

    def __init__(self, store: state.Store, source: str, mirrors: str, triage: Any, adjudicate: Any, config: dict | None = None, limits: runs.Limits | None = None, workers: int = 8):
        self.store, self.spark, self.limits, self.workers = store, store.spark, limits or runs.Limits(), workers
        self.triage, self.adjudicate, self.pinned = triage, adjudicate, git.snapshot(source, mirrors)
        self.config = digest(self.spark, {"version": VERSION, "triage": identity(triage), "adjudicate": identity(adjudicate), "config": config or {}})
        self.source, self.began = source, time.monotonic()

    def row(self, name: str, **values: Any) -> DataFrame:
        schema = state.TABLES[name].schema
        table = self.spark.createDataFrame([], schema)
        known = self.spark.createDataFrame([(1,)], "seq long").withColumns({f.name: F.lit(values[f.name]).cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType) for f in table.schema.fields})
        return known.withColumns({f.name: F.current_timestamp() for f in table.schema.fields if f.name in ("created_at", "updated_at", "started_at")})

    def start(self, dry_run: bool, **selection: Any) -> tuple[str, bool]:
        p = self.pinned
        asked = self.row("runs", repository=p["repository"], snapshot=p["head_sha"], config_hash=self.config, request_hash=digest(self.spark, selection), dry_run=dry_run, config="{}", limits=json.dumps(vars(self.limits))).drop("run", "status")

        def work(w: state.Writes) -> tuple[str, bool]:
            w.write("repositories", self.row("repositories", repository=p["repository"], source=self.source, canonical_source=p["canonical_source"], mirror_path=p["path"]))
            w.write("snapshots", self.row("snapshots", repository=p["repository"], head_sha=p["head_sha"], default_branch=p["default_branch"]))
            made, answers = state.create_runs(w.read("runs"), asked)
            told = answers.first()
            if told["created"]:
                w.replace("runs", made)
            return told["run"], told["created"]

        return self.store.transact(work)

    def read(self, run: str, **selection: Any) -> None:
        """Commits of the run and their places; those that are there stay."""
        if self.store.read("run_commits").where(F.col("run") == run).limit(1).count():
            return
        git.register(self.spark)
        options = {k: v for k, v in selection.items() if v is not None}
        if "range" not in options:
            options["revision"] = self.pinned["head_sha"]
        log = graph.cut(self.spark.read.format("git_commits").option("path", self.pinned["path"]).options(**options).load().withColumn("repository", F.lit(self.pinned["repository"])))
        names = [f.name for f in self.spark.createDataFrame([], state.TABLES["commits"].schema).schema.fields]
        kept = log.withColumn("patch_blob_hash", F.lit(None).cast("string"))
        none = F.lit(None).cast("string")
        walk = log.select(F.col("place").alias("seq"), F.lit(run).alias("run"), "repository", "sha", F.col("place").alias("position"), F.lit("pending").alias("status"), none.alias("triage_status"), none.alias("adjudication_status"), none.alias("error"))
        log.select("sha", F.decode("patch", "UTF-8").alias("diff")).write.mode("overwrite").parquet(f"{self.store.root}/patches/{run}")

        def work(w: state.Writes) -> None:
            w.write("commits", kept.withColumn("seq", F.col("place")).select("seq", *names))
            w.write("run_commits", walk)

        self.store.transact(work)

    def spent(self, run: str) -> dict[str, float]:
        own = self.store.read("usage_records").where(F.col("run") == run)
        row = own.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("estimated_cost"), F.lit(0.0)).alias("cost")).first()
        return row.asDict() | {"seconds": time.monotonic() - self.began}

    def stop(self, run: str) -> tuple[str | None, int]:
        """(the cap that is reached, if any, and the calls that may start now)."""
        used = {k: F.lit(v) for k, v in self.spent(run).items()}
        row = self.spark.range(1).select(runs.exhausted(self.limits, used["calls"], used["tokens"], used["cost"], used["seconds"]).alias("cap"), runs.call_slots(self.limits, self.workers, used["calls"], used["tokens"], used["cost"]).alias("n")).first()
        return row["cap"], row["n"]

    def stage(self, run: str, name: str, function: Any, items: DataFrame) -> str | None:
        """Ask a stage's function of all items without a result; the cap that stopped it, if one did."""
        table = f"{name}_results"
        unbounded = all(v is None for v in vars(self.limits).values())
        while True:
            done = self.store.read(table).where(F.col("config_hash") == self.config).select("repository", "sha")
            todo = items.join(done, ["repository", "sha"], "left_anti")
            cap, slots = self.stop(run)
            if not todo.limit(1).count():
                return None
            if cap or slots < 1:
                return cap or "calls"
            batch = todo if unbounded else todo.orderBy("position").limit(slots)
            said = stages.run_stage(batch.repartition(self.workers), function, name, self.source)
            rows = graph.cut(said.select(F.col("position").alias("seq"), "repository", "sha", F.lit(self.config).alias("config_hash"), F.lit(run).alias("run"), "verdict", "result", "usage", F.lit(None).cast("string").alias("input_blob_hash"), "error", F.current_timestamp().alias("created_at")))
            usage = state.usage_rows(rows.withColumn("stage", F.lit(name)).withColumn("usage", F.coalesce("usage", F.lit("{}"))))
            failed = rows.where("verdict = 'ERROR'").select("seq", F.lit(name).alias("stage"), F.coalesce(F.get_json_object("error", "$.kind"), F.lit("error")).alias("kind"), F.get_json_object("error", "$.message").alias("message"), "repository", "sha", "run", "config_hash", F.col("error").alias("details"), "created_at")
            none = F.lit(None).cast("string")
            told = [F.col("verdict").alias(c) if c == f"{name}_status" else none.alias(c) for c in ("triage_status", "adjudication_status")]
            walked = rows.select("seq", "run", "repository", "sha", F.col("seq").alias("position"), F.lit(name).alias("status"), *told, F.get_json_object("error", "$.message").alias("error"))

            def work(w: state.Writes, rows=rows, usage=usage, failed=failed, walked=walked) -> None:
                if name == "triage":
                    w.write(table, rows)
                else:
                    w.save_adjudications(rows.withColumn("finding", F.when(F.col("verdict") == "YES", F.col("result"))))
                for t, new in (("usage_records", usage), ("errors", failed), ("run_commits", walked)):
                    w.write(t, new)

            self.store.transact(work)  # a batch is stored whole or asked again

    def go(self, dry_run: bool = False, last: int | None = 100, since: str | None = None, range_: str | None = None) -> dict[str, Any]:
        """Run, or go on with, the whole import; its run, status and counters."""
        selection = {"last": last, "since": since, "range": range_}
        run, created = self.start(dry_run, **selection)
        self.read(run, **selection)
        own = self.store.read("run_commits").where(F.col("run") == run).select("repository", "sha", "position")
        if dry_run:
            return self.end(run, "dry_run", created, own.count())
        shown = own.join(self.store.read("commits").select("repository", "sha", "message"), ["repository", "sha"]).join(self.spark.read.parquet(f"{self.store.root}/patches/{run}"), "sha")
        cap = self.stage(run, "triage", self.triage, shown)
        if cap is None:
            yes = self.store.read("triage_results").where(F.col("config_hash") == self.config).where(F.col("verdict").isin(*CANDIDATES)).select("repository", "sha")
            cap = self.stage(run, "adjudication", self.adjudicate, shown.join(yes, ["repository", "sha"], "left_semi"))
        failed = self.store.read("errors").where(F.col("run") == run).limit(1).count()
        return self.end(run, "budget_exhausted" if cap else "completed_with_errors" if failed else "completed", created, own.count(), cap)

    def end(self, run: str, status: str, created: bool, planned: int, cap: str | None = None) -> dict[str, Any]:
        counters = self.spent(run) | {"planned": planned}
        before = json.loads(self.store.read("runs").where(F.col("run") == run).first()["counters"] or "{}")
        counters["seconds"] = round(counters["seconds"] + before.get("seconds", 0.0), 3)  # over all times it was gone on with
        at, closed = F.current_timestamp(), status.startswith("completed")
        self.store.transact(lambda w: w.replace("runs", state.update_run(w.read("runs"), run, at, status=status, counters=json.dumps(counters), error=cap, completed=closed)))
        return {"run": run, "status": status, "created": created, "stopped_by": cap, **counters}


# --- reports


def debug_report(judged: DataFrame, triage_errors: DataFrame, seconds: float = 0.0) -> dict[str, Any]:
    """What counts drop: each commit's verdict and reason, odd reasons as they are, and failures. judged: (sha, subject, verdict, reason,
    validation_errors, raw_output, cost, traceback); triage_errors: (sha, error)."""
    rows = [r.asDict(recursive=True) for r in judged.withColumn("suspect", F.coalesce(text.suspect_reason(F.coalesce("reason", F.lit(""))), F.lit(False))).orderBy("sha").collect()]  # a run's candidates
    of = lambda v: [r for r in rows if r["verdict"] == v]
    counted: dict[str, int] = {}
    for r in of("ABSTAIN"):
        counted[r["reason"] or ""] = counted.get(r["reason"] or "", 0) + 1
    short = lambda rs: [{"sha": r["sha"], "subject": r["subject"]} for r in rs]
    failed = [r for r in rows if r["traceback"]]
    early = [r.asDict() for r in triage_errors.select("sha", "error").orderBy("sha").collect()]
    return {
        "summary": {
            "adjudicated": len(rows), "findings": len(of("YES")), "rejected": len(of("NO")), "abstained": len(of("ABSTAIN")), "errors": len(failed), "triage_errors": len(early), "suspect_reasons": sum(r["suspect"] for r in of("ABSTAIN")),
            "abstain_reasons": dict(sorted(counted.items(), key=lambda x: -x[1])), "estimated_cost_usd": round(sum(r["cost"] or 0.0 for r in rows), 4), "wall_clock_s": round(seconds, 1),
        },
        "findings": short(of("YES")), "abstained": [{k: r[k] for k in ("sha", "subject", "reason", "suspect", "validation_errors", "raw_output")} for r in of("ABSTAIN")], "rejected": short(of("NO")),
        "errors": [{"sha": r["sha"], "traceback": r["traceback"]} for r in failed], "triage_errors": early,
    }


def debug_markdown(report: dict[str, Any]) -> str:
    """The report as text."""
    s = report["summary"]
    lines = ["# Debug report", "", *(f"- {k.replace('_', ' ')}: {v}" for k, v in s.items() if not isinstance(v, dict))]
    lines += ["", "## Reasons to abstain", *(f"- {n} x {r or '(none)'}" for r, n in s["abstain_reasons"].items())]
    for name in ("findings", "abstained", "rejected"):
        lines += ["", f"## {name.title()}", *(f"- `{r['sha'][:12]}` {r['subject']}" + (f": {r['reason']}" + " (suspect)" * r["suspect"] if name == "abstained" else "") for r in report[name])]
    return "\n".join([*lines, "", "## Errors", *(f"- `{r['sha'][:12]}` {(r['traceback'].strip().splitlines() or [''])[-1]}" for r in report["errors"])]) + "\n"


def score_table(scores: DataFrame) -> str:
    """evaluation.score_truth() rows (repository, tp, fp, unscored, missed, recall, precision) as a table of text, the total last."""
    share = lambda x, none: none if x is None else f"{x:.0%}"
    rows = sorted((r.asDict() for r in scores.collect()), key=lambda r: (r["repository"] == "total", r["repository"]))  # one row a repository
    out = [f"{'repo':22} {'emit':>5} {'TP':>4} {'FP':>4} {'miss':>5} {'unsc':>5} {'prec':>6} {'recall':>7}", "-" * 68]
    for r in rows:
        last = r["repository"] == "total"
        out += ["-" * 68] if last else []
        emitted = "" if last else r["tp"] + r["fp"] + r["unscored"]
        none = "-" if last else "  -"
        out.append(f"{'TOTAL' if last else r['repository']:22} {emitted:>5} {r['tp']:>4} {r['fp']:>4} {r['missed']:>5} {r['unscored']:>5} {share(r['precision'], none):>6} {share(r['recall'], none):>7}")
    return "\n".join(out)


