"""State tables of runs: what each write does to rows that are there, where they are kept, and what is exported from them.

Ids are natural: a repository is its canonical source's hash, a commit (repository, sha), a run the hash of its five-part key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.functions.text import canonical_json, content_hash
from prospector.operators import logs
from prospector.sources.ledger import ORDER, Ledger, Transaction
from prospector.sources.stores import existing

SCHEMA_VERSION = 3
#: Folders that a table is folded from, at most, before they are put together.
FOLDERS = 32
STATUSES = ("running", "completed", "completed_with_errors", "budget_exhausted", "interrupted", "dry_run")
COUNTED = ("repositories", "snapshots", "commits", "runs", "triage_results", "adjudication_results", "findings", "usage_records", "errors")


@dataclass(frozen=True)
class Table:
    """keys name a row. replace: a later write wins; first: the first value that is not null stays; keep: a null leaves what is there.

    insert: rows that are there stay whole, and of new rows of one key the first by seq comes in.
    """

    schema: str
    keys: tuple[str, ...]
    replace: tuple[str, ...] = ()
    first: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    insert: bool = False


META = "message string, parents array<string>, changed_paths array<struct<status:string,path:string,old_path:string>>, author_name string, author_time string, committer_name string, committer_time string"
NAMES = tuple(part.strip().split(" ")[0] for part in "message, parents, changed_paths, author_name, author_time, committer_name, committer_time".split(","))
RESULT = "repository string, sha string, config_hash string, run string, verdict string, result string, usage string, input_blob_hash string, error string, created_at timestamp"
TABLES = {
    "repositories": Table("repository string, source string, canonical_source string, mirror_path string, created_at timestamp, updated_at timestamp", ("canonical_source",), ("repository", "source", "mirror_path", "updated_at"), ("created_at",)),
    "snapshots": Table("repository string, head_sha string, default_branch string, created_at timestamp", ("repository", "head_sha", "default_branch"), insert=True),
    "runs": Table("run string, repository string, snapshot string, config_hash string, request_hash string, dry_run boolean, config string, limits string, status string, counters string, error string, started_at timestamp, updated_at timestamp, completed_at timestamp", ("repository", "snapshot", "config_hash", "request_hash", "dry_run"), insert=True),
    "commits": Table(f"repository string, sha string, {META}, patch_blob_hash string, patch_id string", ("repository", "sha"), NAMES, ("patch_blob_hash", "patch_id")),
    "run_commits": Table("run string, repository string, sha string, position long, status string, triage_status string, adjudication_status string, error string", ("run", "repository", "sha"), ("position", "status", "error"), keep=("triage_status", "adjudication_status")),
    "triage_results": Table(RESULT, ("repository", "sha", "config_hash"), insert=True),
    "adjudication_results": Table(RESULT, ("repository", "sha", "config_hash"), insert=True),
    "findings": Table("repository string, sha string, config_hash string, finding string, created_at timestamp", ("repository", "sha", "config_hash"), insert=True),
    "usage_records": Table("stage string, repository string, sha string, config_hash string, run string, calls long, input_tokens long, output_tokens long, total_tokens long, estimated_cost double, created_at timestamp", ("stage", "repository", "sha", "config_hash"), insert=True),
    "errors": Table("stage string, kind string, message string, repository string, sha string, run string, config_hash string, details string, created_at timestamp", ("stage", "kind", "repository", "sha", "run", "config_hash"), insert=True),
}


def written(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """The table after new rows are written to it. Inserts take the first new row of a key by seq, merges the last one; a null in the key
    of an insert equals nothing, so such rows always come in."""
    t = TABLES[name]
    if t.insert:
        return logs.insert_new(old, new, list(t.keys), "seq")
    last = logs.latest(new, list(t.keys)) if "seq" in new.columns else new
    return logs.merge(old, last.select(*old.columns), list(t.keys), list(t.replace), list(t.first), list(t.keep)).select(*old.columns)


def one_write(name: str, rows: DataFrame) -> DataFrame:
    """What a single write brings of rows (seq and the table's columns): a row a key, the first by seq for an insert, else the last."""
    t = TABLES[name]
    if not t.insert:
        return logs.latest(rows, list(t.keys)) if "seq" in rows.columns else rows
    whole = F.lit(True)
    for k in t.keys:
        whole &= F.col(k).isNotNull()
    return logs.pick(rows.where(whole), list(t.keys), "seq").unionByName(rows.where(~whole))


def folded(name: str, rows: DataFrame) -> DataFrame:
    """The table from all rows of all writes, one a key in each, ordered by ORDER: what written() gives write by write, in one shuffle
    however many writes there were."""
    t, out = TABLES[name], [c for c in rows.columns if c != ORDER]
    rest = [c for c in out if c not in t.keys]
    if t.insert:
        whole = F.lit(True)
        for k in t.keys:
            whole &= F.col(k).isNotNull()
        first = rows.where(whole).groupBy(*t.keys).agg(F.min_by(F.struct(*rest), ORDER).alias("_r")).select(*t.keys, "_r.*")
        return first.select(*out).unionByName(rows.where(~whole).select(*out))
    known = lambda pick, c: pick(c, F.when(F.col(c).isNotNull(), F.col(ORDER))).alias(c)
    last = F.max_by(F.struct(*t.replace), ORDER).alias("_last")
    found = rows.groupBy(*t.keys).agg(last, *[known(F.min_by, c) for c in t.first], *[known(F.max_by, c) for c in t.keep])
    return found.select(*t.keys, "_last.*", *t.first, *t.keep).select(*out)


# --- rows to write


def run_id(repository: Column, snapshot: Column, config_hash: Column, request_hash: Column, dry_run: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", repository, snapshot, config_hash, F.coalesce(request_hash, F.lit("")), dry_run.cast("string")).cast("binary"), 256), 1, 32)


def create_runs(old: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, answers) of asked (seq, repository, snapshot, config_hash, request_hash, dry_run, config, limits, started_at): one run for each
    five-part key, and whether it was made now (seq, run, created)."""
    keys = list(TABLES["runs"].keys)
    full = asked.withColumn("request_hash", F.coalesce("request_hash", F.lit("")))
    full = full.withColumn("run", run_id(*[F.col(k) for k in keys])).withColumn("status", F.lit("running"))
    for c, kind in [(f.name, f.dataType) for f in old.schema.fields if f.name not in full.columns]:
        full = full.withColumn(c, F.lit(None).cast(kind))
    there = old.select(F.col("run").alias("_r")).distinct()
    answers = full.join(there, F.col("run") == F.col("_r"), "left").withColumn("_k", F.row_number().over(logs.Window.partitionBy("run").orderBy("seq")))
    return written("runs", old, full), answers.select("seq", "run", (F.col("_r").isNull() & (F.col("_k") == 1)).alias("created"))


def update_run(runs: DataFrame, run: str, at: Column, status: str | None = None, counters: str | None = None, error: str | None = None, completed: bool = False) -> DataFrame:
    """runs with what is given set on one run; completing without an error clears the error. An unknown run raises."""
    if not runs.where(F.col("run") == run).limit(1).count():
        raise KeyError(f"unknown run: {run}")
    here = F.col("run") == run
    given = {"status": status, "counters": counters, "error": error}
    out = runs.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in given.items() if v is not None} | {"updated_at": F.when(here, at).otherwise(F.col("updated_at"))})
    if completed:
        out = out.withColumn("completed_at", F.when(here, at).otherwise(F.col("completed_at")))
        out = out if error is not None else out.withColumn("error", F.when(~here, F.col("error")))
    return out


def usage_rows(rows: DataFrame) -> DataFrame:
    """Usage records of rows (stage, repository, sha, config_hash, run, created_at, seq and usage, JSON): names of several services are
    known, the total is that of its parts where it is missing, and a cost that is not finite is null."""
    u = lambda *names: F.coalesce(*[F.get_json_object("usage", f"$.{n}") for n in names])
    whole = lambda *names: u(*names).try_cast("long")
    i, o, t = whole("input_tokens", "prompt_tokens"), whole("output_tokens", "completion_tokens"), whole("total_tokens")
    cost = u("estimated_cost", "estimated_cost_usd", "cost_usd", "cost").try_cast("double")
    total = F.coalesce(t, F.when(i.isNotNull() | o.isNotNull(), F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0))))
    finite = F.when(~F.isnan(cost) & (F.abs(cost) < float("inf")), cost)
    return rows.select("seq", "stage", "repository", "sha", "config_hash", "run", F.lit(1).cast("long").alias("calls"), i.alias("input_tokens"), o.alias("output_tokens"), total.cast("long").alias("total_tokens"), finite.alias("estimated_cost"), "created_at")


def finding_rows(results: DataFrame) -> DataFrame:
    """Findings of adjudication results (seq and their columns, finding): those of a YES that have one."""
    return results.where("verdict = 'YES' AND finding IS NOT NULL").select("seq", "repository", "sha", "config_hash", "finding", "created_at")


# --- storage


class Writes:
    """What a transaction reads of the tables and writes to them."""

    def __init__(self, t: Transaction):
        self.t = t

    def read(self, name: str) -> DataFrame:
        return self.t.read(name)

    def write(self, name: str, rows: DataFrame) -> None:
        self.t.append(name, one_write(name, rows))

    def replace(self, name: str, rows: DataFrame) -> None:
        self.t.put(name, rows)

    def save_adjudications(self, results: DataFrame) -> None:
        """Results, and the findings of those that are new."""
        keys = list(TABLES["findings"].keys)
        self.write("findings", finding_rows(results).join(self.read("adjudication_results").select(*keys), keys, "left_anti"))
        self.write("adjudication_results", results.drop("finding"))


class Store:
    """The tables under a folder, as a ledger: each write appends, several tables change together or not at all, and readers keep to the
    commit that they began with. A folder of another schema, newer or of a layout before ledgers, is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.ledger = Ledger(spark, f"{self.root}/tables", {n: t.schema for n, t in TABLES.items()}, folded)
        known = existing(spark, f"{self.root}/schema", "version int").agg(F.max("version")).first()[0]
        if known is not None and known != SCHEMA_VERSION:
            raise ValueError(f"the store is of schema {known}, {'newer' if known > SCHEMA_VERSION else 'older'} than {SCHEMA_VERSION}")
        if known is None:
            spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.root}/schema")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table now, or as of a commit."""
        return self.ledger.at(name, version)

    def transact(self, work: Callable[[Writes], Any]) -> Any:
        """Do work(writes) in one transaction, again on newer tables if another writer has changed what it relies on."""
        out = self.ledger.transact(lambda t: work(Writes(t)))
        last = self.ledger.commit(self.ledger.version())
        for name, known in last["tables"].items():
            if len(known["parts"]) > FOLDERS:
                self.ledger.compact(name)
        return out

    def replace(self, name: str, rows: DataFrame) -> None:
        self.transact(lambda w: w.replace(name, rows))

    def write(self, name: str, rows: DataFrame) -> None:
        self.transact(lambda w: w.write(name, rows))

    def save_adjudications(self, results: DataFrame) -> None:
        self.transact(lambda w: w.save_adjudications(results))

    def export(self, kind: str, path: str, run: str | None = None) -> int:
        """Write triage, findings or manifests as canonical JSON lines in order; the number of rows."""
        rows = {"triage": self.triage_rows, "findings": self.finding_rows, "manifest": self.manifest_rows, "manifests": self.manifest_rows}[kind](run)
        logs.export(rows, path, {"triage": ["run", "position", "sha"], "findings": ["run", "position", "sha"]}.get(kind, ["started_at", "run"]))
        return rows.count()

    def triage_rows(self, run: str | None = None) -> DataFrame:
        return triage_export(self.read("run_commits"), self.read("runs"), self.read("commits"), self.read("triage_results"), run)

    def finding_rows(self, run: str | None = None) -> DataFrame:
        return findings_export(self.read("run_commits"), self.read("runs"), self.read("commits"), self.read("adjudication_results"), self.read("findings"), run)

    def manifest_rows(self, run: str | None = None) -> DataFrame:
        return manifests(self.read("runs"), self.read("snapshots"), self.read("run_commits"), run)

    def status(self) -> DataFrame:
        """(table, n) of all tables."""
        counts = [self.read(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in COUNTED]
        out = counts[0]
        for c in counts[1:]:
            out = out.unionByName(c)
        return out


# --- exports


def walked(run_commits: DataFrame, runs: DataFrame, commits: DataFrame, run: str | None) -> DataFrame:
    own = run_commits if run is None else run_commits.where(F.col("run") == run)
    own = own.select("run", "position", "repository", "sha").join(runs.select("run", "config_hash"), "run")
    return own.join(commits.select("repository", "sha", "parents", "message", "changed_paths", "patch_blob_hash", "patch_id"), ["repository", "sha"])


def triage_export(run_commits: DataFrame, runs: DataFrame, commits: DataFrame, results: DataFrame, run: str | None = None) -> DataFrame:
    """Commits of runs with their results, if any; of equal (repository, sha, created_at), null like any time, the first run stays."""
    side = results.select("repository", "sha", "config_hash", "verdict", "result", "usage", "input_blob_hash", "error", "created_at")
    rows = walked(run_commits, runs, commits, run).join(side, ["repository", "sha", "config_hash"], "left").drop("config_hash")
    return logs.pick(rows, ["repository", "sha", "created_at"], "run", "position")


def findings_export(run_commits: DataFrame, runs: DataFrame, commits: DataFrame, results: DataFrame, findings: DataFrame, run: str | None = None) -> DataFrame:
    """Findings with their commits and decisions, each once, with the first run that walked over it."""
    key = ["repository", "sha", "config_hash"]
    rows = walked(run_commits, runs, commits, run).drop("patch_blob_hash", "patch_id").join(results.select(*key, "verdict", "result", "usage"), key).join(findings, key).drop("config_hash")
    return logs.pick(rows, ["repository", "sha", "created_at"], "run", "position")


def run_headers(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Runs with their snapshot's head and branch."""
    side = snapshots.select(F.col("repository").alias("_r"), F.col("head_sha").alias("_h"), "default_branch")
    return runs.join(side, (F.col("repository") == F.col("_r")) & (F.col("snapshot") == F.col("_h"))).drop("_r", "_h")


def manifests(runs: DataFrame, snapshots: DataFrame, run_commits: DataFrame, run: str | None = None) -> DataFrame:
    """A run's header, its commits by status, and how many were triaged and adjudicated."""
    own = runs if run is None else runs.where(F.col("run") == run)
    by = run_commits.groupBy("run", "status").agg(F.count("*").alias("n"), F.count("triage_status").alias("t"), F.count("adjudication_status").alias("a"))
    facts = by.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("commit_statuses"), F.sum("t").alias("triaged"), F.sum("a").alias("adjudicated"))
    out = run_headers(own, snapshots).join(facts, "run", "left")
    return out.withColumn("triaged", F.coalesce("triaged", F.lit(0))).withColumn("adjudicated", F.coalesce("adjudicated", F.lit(0)))


def config_hash(*columns: str) -> Column:
    return content_hash(canonical_json(*columns))
