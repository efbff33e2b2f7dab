"""What is wrong with a row: each function gives an array of short problem texts, empty for a sound row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and limits of the records that are exchanged.
LEVELS = ("low", "medium", "high", "critical", "unknown")
SEVERITY_SOURCES = ("cvss", "advisory", "repository", "human", "model_estimate")
REVISIONS = ("parent", "commit", "head")
CHUNK_STATUSES = ("valid", "malformed", "backend_error", "input_error")
CORE_FIELDS = ("root_cause", "attacker_preconditions", "impact", "fix_effect", "l0_class", "severity", "fix_completeness")
QUOTE_CHARS = 500
SHA = r"^(?:[0-9a-f]{40}|[0-9a-f]{64})$"
PREFIXED_HASH = r"^sha256:[0-9a-f]{64}$"


def problems(*rules: tuple[str, Column]) -> Column:
    """Texts of the rules whose condition holds; an unknown condition counts as broken only if the rule says so itself."""
    return F.filter(F.array(*[F.when(broken, F.lit(text)) for text, broken in rules]), lambda x: x.isNotNull())


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def outside(c: Column, allowed) -> Column:
    return c.isNull() | ~c.isin(*allowed)


def infinite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def usage_problems(tokens_in: Column, tokens_out: Column, total: Column, cost: Column) -> Column:
    return problems(
        ("negative tokens", F.least(tokens_in, tokens_out, total) < 0),
        ("total below its parts", total < tokens_in + tokens_out),
        ("cost not a finite amount", (cost < 0) | infinite(cost)),
    )


def severity_problems(level: Column, source: Column, score: Column, vector: Column) -> Column:
    return problems(
        ("unknown level", outside(level, LEVELS)),
        ("unknown source", outside(source, SEVERITY_SOURCES)),
        ("score outside 0 to 10", (score < 0) | (score > 10) | infinite(score)),
        ("empty vector", F.trim(vector) == ""),
        ("vector without cvss", vector.isNotNull() & F.coalesce(source != "cvss", F.lit(True))),
    )


def path_problem(path: Column) -> Column:
    """A path must be relative, POSIX, free of NUL and must not go up."""
    return blank(path) | path.startswith("/") | path.contains("\\") | path.contains("\0") | F.array_contains(F.split(path, "/"), "..")


def anchor_problems(anchor: Column) -> Column:
    """anchor: struct of revision, revision_sha, path, start_line, end_line, quoted_span, supports."""
    a = anchor.getField
    return problems(
        ("unknown revision", outside(a("revision"), REVISIONS)),
        ("not a full sha", F.coalesce(~a("revision_sha").rlike(SHA), F.lit(True))),
        ("bad path", path_problem(a("path"))),
        ("bad line range", F.coalesce((a("start_line") < 1) | (a("end_line") < a("start_line")), F.lit(True))),
        ("empty quote", blank(a("quoted_span"))),
        ("long quote", F.length(a("quoted_span")) > QUOTE_CHARS),
        ("no claim", F.coalesce(F.size(a("supports")) < 1, F.lit(True))),
        ("repeated claim", F.size(F.array_distinct(a("supports"))) < F.size(a("supports"))),
    )


def chunk_problems(status: Column, verdict: Column, error: Column) -> Column:
    """Valid exactly if there is a verdict and no error."""
    sound = verdict.isNotNull() & error.isNull()
    failed = verdict.isNull() & error.isNotNull()
    return problems(
        ("unknown status", outside(status, CHUNK_STATUSES)),
        ("valid needs a verdict and no error", (status == "valid") & ~sound),
        ("failure needs an error and no verdict", (status != "valid") & ~failed),
    )


def decision_problems(status: Column, verdict: Column, error: Column, chunks: Column) -> Column:
    """A decision against its chunks, an array of structs of index, status and verdict, in order."""
    ok = lambda c: c["status"] == "valid"
    n, valid = F.size(chunks), F.size(F.filter(chunks, ok))
    yes = F.exists(chunks, lambda c: ok(c) & (c["verdict"] == "YES"))
    places = F.transform(chunks, lambda c, k: c["index"] == k)
    return problems(
        ("chunks out of order", F.exists(places, lambda x: ~x)),
        ("valid needs a verdict and no error", (status == "valid") & (verdict.isNull() | error.isNotNull())),
        ("valid needs valid chunks only", (status == "valid") & ((n < 1) | (valid < n))),
        ("verdict against chunks", (status == "valid") & verdict.isNotNull() & (verdict != F.when(yes, "YES").otherwise("NO"))),
        ("partial needs YES and an error", (status == "partial") & (F.coalesce(verdict != "YES", F.lit(True)) | error.isNull())),
        ("partial needs a YES and a failed chunk", (status == "partial") & (~yes | (valid == n))),
        ("failure needs an error and no verdict", ~status.isin("valid", "partial") & (verdict.isNotNull() | error.isNull())),
    )


def missing_claims(anchors: Column, cwe: Column, invariant: Column) -> Column:
    """Claims of a positive finding that no anchor supports, sorted."""
    always = F.array(*[F.lit(x) for x in (*CORE_FIELDS, "affected_paths")])
    wanted = F.concat(always, F.filter(F.array(F.when(cwe.isNotNull(), F.lit("cwe_id")), F.when(invariant.isNotNull(), F.lit("invariant"))), lambda x: x.isNotNull()))
    return F.array_sort(F.array_except(wanted, F.flatten(F.transform(anchors, lambda a: a["supports"]))))


def uncited_paths(paths: Column, anchors: Column) -> Column:
    return F.array_sort(F.array_except(paths, F.transform(anchors, lambda a: a["path"])))


def finding_problems(f) -> Column:
    """f(name) gives the finding's columns: verdict, the core fields, cwe_id, invariant, affected_paths, evidence, commit_sha, parent_sha."""
    yes = F.coalesce(f("verdict") == "YES", F.lit(False))
    paths, anchors = f("affected_paths"), f("evidence")
    filled = [f(c).isNotNull() for c in (*CORE_FIELDS, "cwe_id", "invariant")]
    some = F.array_contains(F.array(*filled), True) | (F.size(paths) > 0) | (F.size(anchors) > 0)
    wrong = lambda revision, sha: F.exists(anchors, lambda a: (a["revision"] == revision) & ~a["revision_sha"].eqNullSafe(sha))
    return problems(
        ("positive fields without YES", ~yes & some),
        ("YES lacks fields", yes & F.array_contains(F.array(*[f(c).isNull() for c in CORE_FIELDS]), True)),
        ("YES lacks paths", yes & (F.size(paths) < 1)),
        ("YES lacks evidence", yes & (F.size(anchors) < 1)),
        ("claims without anchor", yes & (F.size(missing_claims(anchors, f("cwe_id"), f("invariant"))) > 0)),
        ("paths without anchor", yes & (F.size(uncited_paths(paths, anchors)) > 0)),
        ("anchor of another commit", yes & (wrong("commit", f("commit_sha")) | wrong("parent", f("parent_sha")))),
    )


def label_problems(f, frozen_only: bool = False) -> Column:
    """f(name) gives a label's columns; drafts need sound identities only."""
    frozen, verdict, kind, role = f("status") == "frozen", f("verdict"), f("record_type"), f("role")
    filled = F.array_contains(F.array(*[f(c).isNotNull() for c in (*CORE_FIELDS, "cwe_id", "invariant")]), True)
    cites = (F.size(f("source_record_hashes")) > 0) | (F.size(f("source_annotators")) > 0)
    few = (F.size(f("source_record_hashes")) < 2) | (F.size(f("source_annotators")) < 2)
    no = verdict.isin("NO", "ABSTAIN")
    return problems(
        ("unknown record type", outside(kind, ("annotation", "adjudication"))),
        ("unknown status", outside(f("status"), ("draft", "frozen"))),
        ("not frozen", F.lit(frozen_only) & F.coalesce(~frozen, F.lit(True))),
        ("not a full sha", F.coalesce(~f("commit_sha").rlike(SHA), F.lit(True))),
        ("bad source hash", F.exists(f("source_record_hashes"), lambda h: ~h.rlike(PREFIXED_HASH))),
        ("annotation not independent", (kind == "annotation") & ~f("independent").eqNullSafe(True)),
        ("annotation cites others", (kind == "annotation") & cites),
        ("adjudication must be frozen and dependent", (kind == "adjudication") & (~frozen | ~f("independent").eqNullSafe(False))),
        ("adjudication needs two sources", (kind == "adjudication") & few),
        ("frozen needs role and rationale", frozen & (role.isNull() | blank(f("rationale")))),
        ("unknown verdict", frozen & outside(verdict, ("YES", "NO", "ABSTAIN"))),
        ("YES of another role", frozen & (verdict == "YES") & ~role.isin("fix", "backport")),
        ("NO of another role", frozen & (verdict == "NO") & ~role.isin("context", "introduce", "other")),
        ("YES lacks fields", frozen & (verdict == "YES") & F.array_contains(F.array(*[f(c).isNull() for c in CORE_FIELDS]), True)),
        ("YES lacks paths or evidence", frozen & (verdict == "YES") & ((F.size(f("affected_paths")) < 1) | (F.size(f("evidence")) < 1))),
        ("positive fields without YES", frozen & no & (filled | (F.size(f("affected_paths")) > 0))),
        ("ABSTAIN needs a reason", frozen & (verdict == "ABSTAIN") & blank(f("abstain_reason"))),
    )
