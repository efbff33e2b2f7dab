"""A reviewer's decision as JSON against its vocabulary: every problem it has, and what is kept of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospector.functions.calls import quote_in
from prospector.functions.contracts import LEVELS, SEVERITY_SOURCES, problems
from prospector.functions.text import squeeze

# The vocabularies of a decision, the names its fields go by, and its limits in characters.
CLASSES = (
    "memory_safety", "input_validation", "injection", "path_traversal", "access_control", "authentication", "cryptography", "resource_exhaustion", "concurrency_toctou", "deserialization",
    "information_disclosure", "logic_flaw", "supply_chain", "other",
)
VERDICTS, CONFIDENCE, COMPLETENESS = ("YES", "NO", "ABSTAIN"), ("low", "medium", "high"), ("complete", "multi", "partial", "unknown")
DELTAS, CONTAINMENTS = ("narrows", "widens", "unchanged"), ("unrecoverable", "contained", "n/a")
POSITIVE = (
    "reachability_delta", "failure_containment", "root_cause", "mechanism", "attacker_preconditions", "impact", "fix_effect", "class", "l0_class", "category", "cwe_id", "severity", "affected_paths", "affected_symbols",
    "evidence", "fix_completeness", "invariant",
)
ALLOWED = ("verdict", "decision", "is_security_fix", "confidence", "rationale", "decision_reason", "abstain_reason", *POSITIVE)
PROHIBITED = ("analysis", "chain_of_thought", "thinking", "exploitability_reasoning")
REQUIRED = {"root_cause": ("root_cause", "mechanism"), "attacker_preconditions": ("attacker_preconditions",), "impact": ("impact",), "fix_effect": ("fix_effect",)}
CLAIMED = ("root_cause", "attacker_preconditions", "impact", "fix_effect", "l0_class", "severity", "affected_paths", "fix_completeness")
RATIONALE, TEXT, SIDE, REASON, READ_LINES = 1_200, 2_000, 400, 500, 400
#: Problems of a decision that is in order but for what it says of the change itself.
GATES = ("does not narrow what can be reached", "the failure is contained")
EVIDENCE = "array<struct<revision:string,revision_sha:string,path:string,start_line:int,end_line:int,quoted_span:string,supports:array<string>>>"


class Answer:
    """Fields of a JSON object, by any of several names."""

    def __init__(self, answer: Column):
        self.json, self.value = answer, F.try_parse_json(answer)

    def at(self, *names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(self.value, f"$.{n}", "variant") for n in names])

    def kind(self, *names: str) -> Column:
        return F.coalesce(F.schema_of_variant(self.at(*names)), F.lit("VOID"))

    def text(self, *names: str) -> Column:
        """The field if it is a text that is not blank."""
        said = F.coalesce(*[F.try_variant_get(self.value, f"$.{n}", "string") for n in names])
        return F.when((self.kind(*names) == "STRING") & said.rlike(r"\S"), squeeze(said))

    def raw(self, *names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(self.value, f"$.{n}", "string") for n in names])

    def given(self, name: str) -> Column:
        """The field says something: it is no null, blank text, or empty array or object."""
        shown = F.to_json(F.struct(self.at(name).alias("x")))
        return (self.kind(name) != "VOID") & ~shown.rlike(r'^\{"x":(?:""|"\s*"|\[\]|\{\})?\}$')


def verified_evidence(decisions: DataFrame, key: str, answer: str, blobs: DataFrame, commit: str, parent: str) -> DataFrame:
    """(key, evidence, evidence_problems): the anchors of each decision that stand in blobs (sha, path, content), and what is wrong with
    the others. An anchor is at the commit, its parent or the head; ids that it gives must be those (commit, parent: columns)."""
    rows = decisions.select(key, F.col(commit).alias("_commit"), F.col(parent).alias("_parent"), F.posexplode(F.from_json(F.get_json_object(answer, "$.evidence"), EVIDENCE)).alias("_n", "e"))
    kind = F.lower(F.coalesce("e.revision", F.lit("commit")))
    sha = F.when(kind == "commit", F.col("_commit")).when(kind == "parent", F.col("_parent")).otherwise(F.col("e.revision_sha"))
    rows = rows.withColumn("_kind", kind).withColumn("_at", sha)
    files = blobs.select(F.col("sha").alias("_s"), F.col("path").alias("_f"), F.col("content").cast("string").alias("_c"))
    rows = rows.join(files, (F.col("_at") == F.col("_s")) & (F.col("e.path") == F.col("_f")), "left")
    first, last = F.col("e.start_line"), F.col("e.end_line")
    read = F.array_join(F.slice(F.split("_c", "\n"), F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n")
    lines = (first >= 1) & (last >= first) & (last - first < READ_LINES)
    other = F.col("e.revision_sha").isNotNull() & ~F.startswith(F.lower(F.col("_at")), F.lower(F.col("e.revision_sha")))
    wrong = problems(
        ("evidence of an unknown revision", ~kind.isin("commit", "parent", "head") | F.col("_at").isNull()), ("evidence of another revision", F.coalesce(other, F.lit(False))),
        ("evidence without lines", ~F.coalesce(lines, F.lit(False))), ("evidence without a quote", ~F.coalesce(F.col("e.quoted_span").rlike(r"\S"), F.lit(False))), ("evidence without claims", F.coalesce(F.size("e.supports"), F.lit(0)) < 1),
        ("evidence of an unknown file", F.col("_c").isNull()), ("a quote that is not in the lines", F.col("_c").isNotNull() & F.coalesce(lines, F.lit(False)) & ~F.coalesce(quote_in(F.col("e.quoted_span"), read), F.lit(False))),
    )
    rows = rows.withColumn("_w", wrong)
    good = F.transform(F.array_sort(F.collect_list(F.when(F.size("_w") == 0, F.struct("_n", F.col("e").withField("revision_sha", F.col("_at")).withField("revision", F.col("_kind")).alias("e"))))), lambda x: x["e"])
    return rows.groupBy(key).agg(good.alias("evidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_w")))).alias("evidence_problems"))


def validated(decisions: DataFrame, key: str, answer: str, evidence: DataFrame, catalogue: list[str], profile: str = "A0") -> DataFrame:
    """decisions with verdict, problems and gate_rejected: all that is wrong with each answer (a JSON object), and whether only what it says
    of the change is. evidence is of verified_evidence(); catalogue holds the known weaknesses, a few thousand at most.

    A NO or ABSTAIN may carry fields of a YES; they don't count. A YES needs every field, evidence of every claim and path, a change
    that narrows what an attacker reaches, and a failure that nothing contains.
    """
    a = Answer(F.col(answer))
    e = evidence.select(F.col(key).alias("_k"), "evidence", "evidence_problems")
    out = decisions.join(e, F.col(key) == F.col("_k"), "left").drop("_k")
    none = F.array().cast("array<string>")
    anchors = F.coalesce("evidence", F.array().cast(EVIDENCE))
    keys = F.coalesce(F.json_object_keys(F.col(answer)), none)
    verdict = F.upper(F.coalesce(a.raw("verdict", "decision"), F.when(a.raw("is_security_fix") == "true", "YES").when(a.raw("is_security_fix") == "false", "NO").when(F.array_contains(keys, "is_security_fix"), "ABSTAIN"), F.lit("")))
    rationale, reason = a.text("rationale", "decision_reason"), a.text("abstain_reason")
    yes, no, abstain = verdict == "YES", verdict == "NO", verdict == "ABSTAIN"
    lit = lambda names: F.array(*[F.lit(n) for n in names])
    outside = lambda value, names: ~F.coalesce(value.isin(*names), F.lit(False))
    level, source = F.lower(a.raw("severity.level", "severity.value")), F.lower(a.raw("severity.source"))
    score, vector = a.raw("severity.score"), a.text("severity.vector")
    cwe, delta, contained = F.upper(a.raw("cwe_id")), F.lower(F.trim(a.raw("reachability_delta.verdict"))), F.lower(F.trim(a.raw("failure_containment")))
    paths = F.coalesce(F.from_json(F.get_json_object(answer, "$.affected_paths"), "array<string>"), none)
    bad_path = F.exists(paths, lambda p: p.isNull() | ~p.rlike(r"\S") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)"))
    claims = F.array_distinct(F.flatten(F.transform(anchors, lambda x: F.coalesce(x["supports"], none))))
    needed = F.concat(lit(CLAIMED), F.when(cwe.isNotNull(), lit(("cwe_id",))).otherwise(none), F.when(a.text("invariant").isNotNull(), lit(("invariant",))).otherwise(none))
    cited = F.transform(anchors, lambda x: x["path"])
    said = a.kind("severity").startswith("OBJECT")
    rules = [
        ("not a JSON object", F.json_object_keys(F.col(answer)).isNull()), ("unknown fields", F.size(F.array_except(keys, lit((*ALLOWED, *PROHIBITED)))) > 0), ("reasoning is prohibited", F.arrays_overlap(keys, lit(PROHIBITED))),
        ("unknown verdict", outside(verdict, VERDICTS)), ("unknown confidence", outside(F.lower(a.raw("confidence")), CONFIDENCE)), ("no rationale", rationale.isNull()), ("rationale too long", F.coalesce(F.length(rationale) > RATIONALE, F.lit(False))),
        ("ABSTAIN without a reason", abstain & reason.isNull()), ("NO with a reason to abstain", no & a.given("abstain_reason")),
        *[(f"YES without {n}", yes & a.text(*names).isNull()) for n, names in REQUIRED.items()],
        ("unknown class", yes & outside(a.raw("l0_class", "class", "category"), CLASSES)),
        ("weakness not as CWE-N", yes & cwe.isNotNull() & ~F.coalesce(cwe.rlike(r"^CWE-\d+$"), F.lit(False))), ("weakness not in the catalogue", yes & F.coalesce(cwe.rlike(r"^CWE-\d+$") & ~F.array_contains(lit(catalogue), cwe), F.lit(False))),
        ("YES without severity", yes & ~said), ("unknown severity", yes & said & outside(level, LEVELS)), ("unknown source of severity", yes & said & outside(source, SEVERITY_SOURCES)), ("severity of an advisory in A0", yes & said & F.lit(profile == "A0") & (source == "advisory")),
        ("score not 0 to 10", yes & score.isNotNull() & ~F.coalesce(~a.kind("severity.score").isin("STRING", "BOOLEAN") & score.try_cast("double").between(0, 10), F.lit(False))),
        ("vector without cvss", yes & (a.kind("severity.vector") != "VOID") & ~F.coalesce(vector.isNotNull() & (source == "cvss"), F.lit(False))),
        ("unknown completeness", yes & outside(F.when(a.raw("fix_completeness") == "single", "complete").otherwise(a.raw("fix_completeness")), COMPLETENESS)),
        ("no change of what can be reached", yes & outside(delta, DELTAS)), (GATES[0], yes & delta.isin("widens", "unchanged")), ("no before and after", yes & (a.text("reachability_delta.before").isNull() | a.text("reachability_delta.after").isNull())),
        ("no containment", yes & outside(contained, CONTAINMENTS)), (GATES[1], yes & (contained == "contained")), ("no affected paths", yes & (F.size(paths) == 0)), ("path not relative", yes & F.coalesce(bad_path, F.lit(False))),
        ("no verified evidence", yes & (F.size(anchors) == 0)), ("a path without evidence", yes & (F.size(F.array_except(paths, cited)) > 0)), ("a claim without evidence", yes & (F.size(F.array_except(needed, claims)) > 0)),
    ]
    found = problems(*[(text, F.coalesce(broken, F.lit(False))) for text, broken in rules])
    every = F.concat(found, F.when(yes, F.coalesce("evidence_problems", none)).otherwise(none))
    out = out.withColumn("verdict", verdict).withColumn("problems", every)
    only = F.size(F.array_except("problems", lit(GATES))) == 0
    return out.withColumn("gate_rejected", (F.size("problems") > 0) & only).drop("evidence_problems")
