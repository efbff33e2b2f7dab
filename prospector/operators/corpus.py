"""A corpus of advisories and the commits they cite: rows, layers, labels, queues and worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospector.functions import text
from prospector.operators import logs
from prospector.sources.records import read_lines

# The roles of a commit, and what a worklist tells its reader.
ROLES = ("fix", "context", "backport", "introduce", "other")
RUBRIC = "Revert test: if this commit were reverted, would a vulnerability come back? yes -> fix, no -> context. When still undecidable, use other."
GUIDANCE = {
    "relabel-audit": "Decide this commit on its own merits. Its earlier label and the classifier's verdict are both withheld on purpose. " + RUBRIC,
    "negative-audit": "This commit is currently labelled non-fix and the classifier agreed. Nobody has re-checked that agreement. If it is really a fix, both recall and FPR are wrong. " + RUBRIC,
    "holdout": "Reserved holdout. Do not tune prompts against these commits after labelling them. " + RUBRIC,
}
INSTRUCTIONS = "Set `role` to one of " + "/".join(ROLES) + " and `annotator_id` on every row, then save. Leave rows you cannot decide as `other` with a note rather than guessing."
CONTENT = ["host", "repo", "sha"]

RAW = (
    "ghsa_id string, host string, repo string, sha string, source string, role string, msg_class string, message_class string, subject string, message string, "
    "diff_path string, diff_bytes long, is_merge boolean, parent_count int, resolved boolean, resolved_sha string, lag_days int, parents array<string>"
)


def text_of(c: str, default: str = "") -> Column:
    """A text column, the default where it is null or empty."""
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", default).otherwise(F.col(c))


def commit_rows(raw: DataFrame, reclassify: bool = True) -> DataFrame:
    """One row for each pairing of an advisory and a commit, from raw rows (seq and the columns of RAW) with all defaults filled in.

    ordinal and n_in_advisory count the rows of an advisory by seq; the class is that of the message, or the stored one.
    """
    first = F.split(F.coalesce("message", F.lit("")), "\r\n|\n|\r")[0]
    rows = raw.withColumns({
        "ghsa_id": text_of("ghsa_id"), "host": text_of("host", "github.com"), "repo": text_of("repo"), "sha": F.lower(text_of("sha")), "source": text_of("source", "ghsa"), "stored_class": text_of("msg_class"),
        "message": F.coalesce("message", F.lit("")), "subject": F.when(text_of("subject") != "", F.col("subject")).otherwise(first), "diff_bytes": F.coalesce("diff_bytes", F.lit(0)),
        "is_merge": F.coalesce("is_merge", F.lit(False)), "parent_count": F.coalesce("parent_count", F.lit(1)), "resolved": F.coalesce("resolved", F.lit(False)),
    })
    said = F.when(F.col("message") != "", F.col("message")).otherwise(F.col("subject"))
    rows = rows.withColumn("said", said).withColumn("terms", text.matched_terms(F.col("said")))
    now = text.message_class(F.col("said"), F.col("is_merge"), F.col("terms")) if reclassify else text_of("msg_class", "quiet")
    rows = rows.withColumn("msg_class", now).withColumn("announcement_strength", text.announcement_strength(F.col("said"), F.col("terms")))
    return logs.ordinals(rows, "ghsa_id", "seq").withColumnRenamed("n_in_key", "n_in_advisory")


def load(spark: SparkSession, root: str, reclassify: bool = True) -> tuple[DataFrame, DataFrame]:
    """(advisories, commit rows) of a folder with advisories.jsonl and commits.jsonl; a missing file is an empty one."""
    return read_lines(spark, f"{root}/advisories.jsonl", "ghsa_id string, id string, details string, summary string"), commit_rows(read_lines(spark, f"{root}/commits.jsonl", RAW), reclassify)


def advisory_ids(advisories: DataFrame) -> DataFrame:
    """Distinct ids: ghsa_id, else id, without empty ones."""
    own = F.when(F.coalesce("ghsa_id", F.lit("")) != "", F.col("ghsa_id")).otherwise(F.col("id"))
    return advisories.select(own.alias("ghsa_id")).where("ghsa_id <> ''").distinct()


def without_commits(advisories: DataFrame, rows: DataFrame) -> DataFrame:
    return advisory_ids(advisories).join(rows, "ghsa_id", "left_anti")


def labelled(rows: DataFrame) -> DataFrame:
    return rows.where("role <> ''")


def by_role(rows: DataFrame, *roles: str) -> DataFrame:
    return rows.where(F.col("role").isin(*roles))


def unique_commits(rows: DataFrame) -> DataFrame:
    """The first pairing of each commit."""
    return logs.earliest(rows, CONTENT)


def stratum_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("msg_class").agg(F.count("*").alias("n"))


def reclassified(rows: DataFrame) -> DataFrame:
    """Rows whose stored class is another than the one of their message, and the terms to blame."""
    changed = rows.where((F.col("stored_class") != "") & (F.col("stored_class") != F.col("msg_class")))
    return changed.select("ghsa_id", "repo", "sha", F.substring("subject", 1, 100).alias("subject"), F.col("stored_class").alias("was"), F.col("msg_class").alias("now"), F.col("terms").alias("keywords"), F.col("said").rlike(text.ADVISORY_ID).alias("has_identifier"))


def applied_roles(log: DataFrame) -> DataFrame:
    """(host, repo, sha, role): the last role in a log (seq, host, repo, sha, role) that is not empty."""
    own = log.where("role <> ''").select("seq", "role", text_of("host", "github.com").alias("host"), text_of("repo").alias("repo"), F.lower(text_of("sha")).alias("sha"))
    return own.groupBy(*CONTENT).agg(F.max_by("role", "seq").alias("role"))


def with_diffs(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with the text of the file (path, content) that diff_path names; empty where there is none."""
    side = files.select(F.col("path").alias("_p"), F.col("content").cast("string").alias("_c"))
    return rows.join(side, F.col("diff_path") == F.col("_p"), "left").withColumn("diff", F.coalesce("_c", F.lit(""))).drop("_p", "_c")


def development_rows(raw: DataFrame, labels: DataFrame) -> DataFrame:
    """Each commit of raw rows (seq and RAW) once, with its latest label (seq, host, repo, sha, role), else its own role; those without a
    role go. Of a commit's rows the first that is resolved stands for it, else the first."""
    rows = raw.where("host <> '' AND repo <> '' AND sha <> ''").withColumn("sha", F.lower("sha"))
    one = logs.pick(rows, CONTENT, F.when(F.coalesce("resolved_sha", F.lit("")) != "", 0).otherwise(1), "seq")
    last = logs.latest(labels.withColumn("sha", F.lower("sha")), CONTENT).select(*CONTENT, F.col("role").alias("_label"))
    out = one.join(last, CONTENT, "left")
    role = F.lower(F.when(F.coalesce("_label", F.lit("")) != "", F.col("_label")).otherwise(F.coalesce("role", F.lit(""))))
    repository = F.concat_ws("/", "host", "repo")
    message = F.coalesce("message", F.lit(""))
    subject = F.when(text_of("subject") != "", F.col("subject")).otherwise(F.split(message, "\r\n|\n|\r")[0])
    kind = F.when(text_of("message_class") != "", F.col("message_class")).when(text_of("msg_class") != "", F.col("msg_class")).otherwise("unknown")
    return out.select(
        F.concat_ws("@", repository, "sha").alias("id"), repository.alias("repository"), *CONTENT[:2], F.col("sha").alias("commit_sha"), F.lower(F.try_element_at("parents", F.lit(1))).alias("parent_sha"),
        subject.alias("subject"), message.alias("message"), kind.alias("message_class"), role.alias("role"), "diff_path",
    ).where("role <> ''")


# --- worklists


def item_id(task: str) -> Column:
    return F.concat(F.lit(task + "-"), F.substring(F.sha2(F.concat_ws("|", F.lit(task), "repo", "sha").cast("binary"), 256), 1, 10))


def worklist(rows: DataFrame, task: str, advisories: DataFrame) -> DataFrame:
    """What a labeller may see of rows, with empty columns for the answer: no verdict and no earlier label. advisories: (seq, ghsa_id,
    id, ...); the last one of an id is shown as JSON."""
    key = F.when(F.coalesce("ghsa_id", F.lit("")) != "", F.col("ghsa_id")).otherwise(F.col("id"))
    index = logs.latest(advisories.withColumn("_g", key).where("_g <> ''"), ["_g"])
    shown = F.to_json(F.struct(*[c for c in advisories.columns if c != "seq"]))
    none = F.lit(None).cast("string")
    out = rows.join(index.select("_g", shown.alias("advisory")), F.col("ghsa_id") == F.col("_g"), "left")
    answers = [none.alias(c) for c in ("role", "notes", "annotator_id", "decided_at")]
    return out.select(F.lit(task).alias("task"), item_id(task).alias("item_id"), "repo", "sha", "subject", "diff_path", "diff_bytes", "advisory", "message", F.lit(GUIDANCE[task]).alias("guidance"), *answers)


def relabel_audit(rows: DataFrame, prefixes: DataFrame, advisories: DataFrame) -> DataFrame:
    """The first row of each commit whose id begins with one of prefixes (prefix); each length of prefix joins by equality."""
    own = prefixes.where("prefix <> ''").select(F.lower("prefix").alias("prefix")).distinct()
    lengths = sorted(r[0] for r in own.select(F.length("prefix")).distinct().collect())  # at most as many as an id has characters
    starts = F.array(*[F.struct(F.lit(n).alias("n"), F.substring(F.lower("sha"), 1, n).alias("p")) for n in lengths]) if lengths else F.array().cast("array<struct<n:int,p:string>>")
    hit = rows.select("sha", F.explode(starts).alias("s")).join(own, (F.col("s.p") == F.col("prefix")) & (F.col("s.n") == F.length("prefix"))).select("sha").distinct()
    low = rows.join(hit, "sha", "left_semi").withColumn("_low", F.lower("sha"))
    return worklist(logs.earliest(low, ["_low"]).drop("_low"), "relabel-audit", advisories)


def negative_audit(rows: DataFrame, negatives: DataFrame, advisories: DataFrame, size: int = 40, seed: str = "negative-audit-v1") -> DataFrame:
    """The `size` rows of least hash among those labelled other or context whose id is in negatives (sha)."""
    own = negatives.select(F.lower("sha").alias("_n")).distinct()
    eligible = by_role(rows, "other", "context").join(own, F.lower("sha") == F.col("_n"), "left_semi")
    return worklist(logs.sample_by_hash(eligible, F.col("sha"), size, seed), "negative-audit", advisories)


def holdout_worklist(rows: DataFrame, advisories: DataFrame) -> DataFrame:
    return worklist(logs.earliest(rows, ["sha"]), "holdout", advisories)


def write_worklist(items: DataFrame, path: str, task: str, minutes: int | None = None) -> dict:
    """Write items as JSON lines in order of their id; the manifest's row, which goes beside them as JSON."""
    lines = items.orderBy("item_id").select(text.canonical_json(*items.columns).alias("value"))
    lines.write.mode("overwrite").text(path)
    hashes = items.select(F.xxhash64(text.canonical_json(*items.columns)).alias("h"), F.sha2(text.canonical_json(*items.columns), 256).alias("s"), "diff_bytes")
    facts = hashes.agg(F.count("*").alias("items"), F.coalesce(F.sum("diff_bytes"), F.lit(0)).alias("b"), F.sha2(F.array_join(F.array_sort(F.collect_list("s")), "\n"), 256).alias("digest")).first()  # a worklist is for people to read
    manifest = {
        "task": task, "items": facts["items"], "roles": list(ROLES), "blind": True, "model_verdict_withheld": True, "prior_label_withheld": task == "relabel-audit", "estimated_minutes": minutes,
        "total_diff_bytes": facts["b"], "worklist_sha256": "sha256:" + facts["digest"], "instructions": INSTRUCTIONS,
    }
    spark = items.sparkSession
    spark.createDataFrame([manifest], "task string, items long, roles array<string>, blind boolean, model_verdict_withheld boolean, prior_label_withheld boolean, estimated_minutes int, total_diff_bytes long, worklist_sha256 string, instructions string").coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "-manifest")
    return manifest


# --- queues


def candidate(verdict: Column, error: Column, flagged: Column, marked: Column, include_errors: bool = True) -> Column:
    """A triage row is a candidate: it failed, or is flagged, or its verdict is not NO; a row without any mark is one too."""
    own = F.upper(verdict).isin("YES", "ABSTAIN", "CANDIDATE", "ERROR")
    return F.when(F.lit(include_errors) & (F.coalesce(error, F.lit("")) != ""), True).when(F.coalesce(flagged, F.lit(False)), True).when(verdict.isNotNull(), own).otherwise(~marked)


def candidate_queue(commits: DataFrame, triage: DataFrame, labels: DataFrame, annotators: list[str], include_errors: bool = True, include_covered: bool = False, limit: int | None = None) -> DataFrame:
    """Candidates of triage (repository, sha, verdict, error) with their commits' columns and the annotators that they have and lack.

    labels: (seq, repository, sha, annotator, record_type), of which the latest count; fully covered candidates go unless asked for.
    """
    key = ["repository", "sha"]
    last = logs.latest(labels, [*key, "annotator"]).where("coalesce(record_type, 'annotation') = 'annotation'")
    have = last.groupBy(*key).agg(F.array_sort(F.collect_set("annotator")).alias("annotators_present"))
    none = F.array().cast("array<string>")
    rows = triage.where(candidate(F.col("verdict"), F.col("error"), F.lit(False), F.lit(True), include_errors))
    out = rows.join(commits, key, "left").join(have, key, "left").withColumn("annotators_present", F.coalesce("annotators_present", none))
    wanted = F.array(*[F.lit(a) for a in annotators]) if annotators else none
    out = out.withColumn("annotators_missing", F.array_except(wanted, "annotators_present"))
    out = out.withColumn("reason", F.when(F.coalesce("error", F.lit("")) != "", "triage_error").otherwise("triage_candidate"))
    if annotators and not include_covered:
        out = out.where(F.size("annotators_missing") > 0)
    return out if limit is None else out.orderBy(*key).limit(limit)


def pilot_stratum(role: Column, roles: Column, verdicts: Column) -> Column:
    """positive, hard_negative or unknown: by the row's role or those of its annotations, else by verdicts that all agree."""
    one_of = lambda names: F.lower(F.coalesce(role, F.lit(""))).isin(*names) | F.arrays_overlap(F.coalesce(roles, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    sure = lambda v: F.coalesce(F.array_distinct(verdicts) == F.array(F.lit(v)), F.lit(False))
    return F.when(one_of(("fix", "backport")), "positive").when(one_of(("context", "introduce", "other")), "hard_negative").when(sure("YES"), "positive").when(sure("NO"), "hard_negative").otherwise("unknown")


def pilot_queue(candidates: DataFrame, size: int = 40, positive_fraction: float = 0.5, seed: str = "rich-pilot-v1") -> DataFrame:
    """`size` of candidates (repository, sha, stratum, has_disagreement): a share of positives, hard negatives for the rest, and what is
    missing from all that is left; disagreements go first, then the hash of the commit decides. Repeated commits count once for the rest.

    Only the first `size` rows of each stratum can get in, so no stratum is ranked whole.
    """
    order = F.sha2(F.concat(F.lit(seed), F.lit("\0"), "repository", F.lit("\0"), "sha").cast("binary"), 256)
    rows = candidates.withColumn("_late", (~F.col("has_disagreement")).cast("int")).withColumn("_h", order)
    positive = round(size * positive_fraction)
    parts = [rows.where(F.col("stratum") == s).orderBy("_late", "_h").limit(size).withColumn("_k", F.monotonically_increasing_id()) for s in ("positive", "hard_negative", "unknown")]
    places = [p.orderBy("_late", "_h").collect() for p in parts]  # 3 * size rows at most
    chosen = places[0][:positive] + places[1][: size - positive]
    taken = {(r["repository"], r["sha"]) for r in chosen}
    rest = sorted((r for p in places for r in p if (r["repository"], r["sha"]) not in taken), key=lambda r: (r["_late"], r["_h"]))
    chosen += rest[: max(0, size - len(chosen))]
    rank = {"positive": 0, "hard_negative": 1, "unknown": 2}
    chosen = sorted(chosen, key=lambda r: (rank[r["stratum"]], r["_h"]))[:size]
    schema = candidates.schema
    return candidates.sparkSession.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in chosen], schema)


# --- annotations

def annotations(log: DataFrame, keys: list[str], record_type: str | None = None) -> DataFrame:
    """(keys, records): the latest record of each annotator, sorted by annotator; of one record type if asked for."""
    last = logs.latest(log, [*keys, "annotator"])
    if record_type:
        last = last.where(F.coalesce("record_type", F.lit("annotation")) == record_type)
    rest = [c for c in log.columns if c not in (*keys, "annotator")]
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("annotator", *rest))).alias("records"))


def unresolved(log: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys whose annotators disagree and that no later adjudication has settled."""
    own = log.withColumn("record_type", F.coalesce("record_type", F.lit("annotation")))
    differ = logs.disagreements(own.where("record_type = 'annotation'"), keys, "annotator", fields).where("disagrees")
    return differ.join(logs.adjudicated(own, keys, "record_type").where("settled"), keys, "left_anti")


def adjudication(sources: DataFrame, keys: list[str], decisions: DataFrame) -> DataFrame:
    """Records that settle keys: decisions (keys, annotator, ...) with the hashes and annotators of sources (keys, annotator, record_id).

    A decision on fewer than two annotators raises.
    """
    facts = sources.groupBy(*keys).agg(F.array_sort(F.collect_list("record_id")).alias("source_record_hashes"), F.array_sort(F.collect_set("annotator")).alias("source_annotators"))
    out = decisions.join(facts, keys, "left")
    few = F.coalesce(F.size("source_annotators"), F.lit(0)) < 2
    status = F.when(few, F.raise_error(F.lit("adjudication requires two independent annotators"))).otherwise(F.lit("frozen"))
    return out.withColumn("status", status).withColumn("record_type", F.lit("adjudication"))
