"""Message, path and answer classification as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that mark a message as about security, in table order.
SECURITY_TERMS = (
    "security", "insecure", "vulnerability", "vulnerabilities", "vulnerable", "exploit", "exploitable", "advisory", "attacker", "malicious",
    "cwe",
    "xss", "csrf", "ssrf", "xxe", "clickjacking", "open redirect", "session fixation",
    "injection", "sql injection", "command injection", "code injection", "sanitize", "sanitise", "sanitization", "sanitisation", "escaping",
    "overflow", "underflow", "use after free", "double free", "out of bounds", "denial of service",
    "auth bypass", "authentication bypass", "authorization bypass", "authorisation bypass", "privilege escalation", "unauthenticated", "unauthorized", "unauthorised", "access control",
    "path traversal", "directory traversal", "zip slip", "zipslip",
    "remote code execution", "arbitrary code", "arbitrary file",
    "timing attack", "constant time", "hardcoded credential", "credential leak", "secret leak",
)
# Terms that announce on their own in a subject line.
SUBJECT_TERMS = (
    "vulnerability", "vulnerabilities", "exploit", "xss", "csrf", "ssrf", "xxe", "path traversal", "directory traversal", "zip slip", "zipslip", "open redirect",
    "privilege escalation", "auth bypass", "authentication bypass", "authorization bypass", "remote code execution", "arbitrary code", "arbitrary file", "denial of service", "use after free",
)
# Formats of identifiers and of a conventional security subject.
ADVISORY_ID = r"(?i)\b(?:CVE-\d{4}-\d{4,}|GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4})\b"
CWE_ID, GO_ID, OSV_ID = r"(?i)\bCWE[-\s]?\d{1,5}\b", r"(?i)\bGO-\d{4}-\d{3,}\b", r"(?i)\bOSV-\d{4}-\d{3,}\b"
SECURITY_SUBJECT = r"(?i)^\s*(?:security|sec|vuln)\s*(?:\([^)]*\))?\s*!?\s*:"
# Addresses of advisories, subjects of merges, links to commits, and what stands for a message that is not shown.
ADVISORY_URL = r"(?i)https?://\S*(?:security|advisor|cve|ghsa|vuln|snyk|nvd\.nist)\S*"
MERGE_SUBJECT = r"(?i)^(?:Merge (?:pull request|branch|remote-tracking branch|tag)\b|Merge commit from fork)\b"
COMMIT_URL = r"(?i)https?://(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)/(?:commit|pull/\d+/commits)/([0-9a-fA-F]{7,40})(?:[/?#][^\s\"'<>)\]}>]*)?"
PLACEHOLDER, NEUTRAL_STUB = "[redacted]", "Update implementation."
# Path rules of the change kinds.
VENDOR_DIRS = ("vendor", "vendors", "node_modules", "third_party", "third-party", "vendored", "external")
GENERATED_DIRS, TEST_DIRS, DOC_DIRS = ("generated", "dist"), ("test", "tests", "__tests__", "spec", "specs"), ("docs", "doc")
GENERATED_SUFFIXES = (".min.js", ".min.css", ".js.map", ".css.map", ".pb.go", ".pb.cc", ".pb.h", ".designer.cs", ".g.dart")
TEST_SUFFIXES = ("_test.go", "_test.py", ".test.js", ".test.ts", ".spec.js", ".spec.ts")
DEPENDENCY_NAMES = (
    "go.mod", "go.sum", "cargo.toml", "cargo.lock", "package.json", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "pyproject.toml",
    "poetry.lock", "pdm.lock", "pipfile", "pipfile.lock", "gemfile", "gemfile.lock", "composer.json", "composer.lock", "mix.exs", "mix.lock", "pom.xml",
    "build.gradle", "build.gradle.kts", "gradle.lockfile", "packages.config", "deps.edn", "flake.lock",
)
DOC_NAMES = ("readme", "changelog", "changes", "news", "license", "contributing", "security", "authors")
MARKED_SUFFIXES, MARKER = (".go", ".rs", ".java", ".kt", ".cs", ".js", ".ts"), r"(?i)code generated .* do not edit|@generated\b|automatically generated"
DOC_SUFFIXES = (".md", ".mdx", ".rst", ".adoc", ".asciidoc")
SOURCE_SUFFIXES = (
    ".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".go", ".rs", ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".kts",
    ".rb", ".php", ".cs", ".swift", ".scala", ".sh", ".bash", ".zsh", ".sql", ".lua", ".ex", ".exs", ".erl", ".hrl",
)

EDGE = r"[^\p{L}\p{N}_-]"


def term_regex(term: str) -> str:
    """The term between characters that no word or hyphen continues; blanks inside match runs of blanks, hyphens, underscores."""
    return r"[\s\-_]+".join(term.split())


def has_term(text: Column, term: str) -> Column:
    # a plain search for the first word spares most rows the regular expression
    return F.lower(text).contains(term.split()[0]) & text.rlike(f"(?i)(?:^|{EDGE}){term_regex(term)}(?:$|{EDGE})")


def longer_terms(term: str, terms: tuple[str, ...]) -> list[str]:
    own = f" {term} "
    return [t for t in terms if t != term and own in f" {t} "]


def matched_terms(text: Column, terms: tuple[str, ...] = SECURITY_TERMS) -> Column:
    """Distinct terms in table order that occur outside of longer terms: those are blanked before a term inside them is sought."""
    found = []
    for term in terms:
        rest = text
        for longer in longer_terms(term, terms):
            rest = F.regexp_replace(rest, f"(?i)(^|{EDGE}){term_regex(longer)}(?=$|{EDGE})", "$1#")
        found.append(F.when(has_term(rest, term), F.lit(term)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r", "\n")


def subject(message: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+", ""), "\n", 1)


def message_class(message: Column, is_merge: Column, terms: Column) -> Column:
    """empty, merge_noise, announced or quiet; terms are matched_terms() of the message."""
    text = F.coalesce(message, F.lit(""))
    merge = subject(text).rlike(MERGE_SUBJECT)
    return F.when(~text.rlike(r"\S"), "empty").when(is_merge & merge, "merge_noise").when(text.rlike(ADVISORY_ID) | (F.size(terms) >= 2), "announced").otherwise("quiet")


def announcement_strength(message: Column, terms: Column) -> Column:
    first = subject(message)
    signal = first.rlike(SECURITY_SUBJECT) | reduce(lambda a, b: a | b, [has_term(first, t) for t in SUBJECT_TERMS])
    return (
        F.when(message.isNull() | ~message.rlike(r"\S"), "none").when(message.rlike(ADVISORY_ID), "identifier").when(F.size(terms) >= 2, "multi_keyword")
        .when(signal, "subject_signal").when(F.size(terms) >= 1, "single_keyword").otherwise("none")
    )


def redaction(message: Column, terms: tuple[str, ...] = SECURITY_TERMS) -> Column:
    """(text, removed_identifiers, removed_keywords): identifiers and addresses first, then the terms in table order, each on what the
    ones before have left; what is removed is listed once, in the order of removal. Null: empty."""
    out, found, gone = F.coalesce(message, F.lit("")), [], []
    for pattern in (ADVISORY_ID, GO_ID, OSV_ID, CWE_ID, ADVISORY_URL):
        found.append(F.regexp_extract_all(out, F.lit(pattern), 0))
        out = F.regexp_replace(out, pattern, PLACEHOLDER)
    for term in terms:
        gone.append(F.when(has_term(out, term), F.lit(term)))
        out = F.regexp_replace(out, f"(?i)(^|{EDGE}){term_regex(term)}(?=$|{EDGE})", f"$1{PLACEHOLDER}")
    keywords = F.filter(F.array(*gone), lambda x: x.isNotNull())
    return F.struct(out.alias("text"), F.array_distinct(F.flatten(F.array(*found))).alias("removed_identifiers"), keywords.alias("removed_keywords"))


def redact(message: Column, terms: tuple[str, ...] = SECURITY_TERMS) -> Column:
    """The text of redaction()."""
    out = F.coalesce(message, F.lit(""))
    for pattern in (ADVISORY_ID, GO_ID, OSV_ID, CWE_ID, ADVISORY_URL):
        out = F.regexp_replace(out, pattern, PLACEHOLDER)
    for term in terms:
        out = F.regexp_replace(out, f"(?i)(^|{EDGE}){term_regex(term)}(?=$|{EDGE})", f"$1{PLACEHOLDER}")
    return out


def under_condition(message: Column, condition: str) -> Column:
    """The message as a reviewer sees it: M0 whole, M1 redacted, M2 a stub."""
    shown = {"M0": lambda: F.coalesce(message, F.lit("")), "M1": lambda: redact(message), "M2": lambda: F.lit(NEUTRAL_STUB)}
    return shown[condition]()


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """Lower-case components of a path, the last of them, and the folders before it."""
    low = F.lower(path)
    parts = F.filter(F.split(low, "/"), lambda x: x != "")
    return parts, F.coalesce(F.try_element_at(parts, F.lit(-1)), low), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def ends_with(name: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [name.endswith(s) for s in suffixes])


def holds_any(where: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(where, F.array(*[F.lit(n) for n in names]))


def generated_reason(path: Column, patch: Column) -> Column:
    """Why a file counts as generated or vendored; null if it does not."""
    parts, name, folders = path_parts(path)
    marked = ends_with(name, MARKED_SUFFIXES) & F.substring(patch, 1, 4096).rlike(MARKER)
    return F.when(holds_any(parts, VENDOR_DIRS), "vendor_directory").when(holds_any(folders, GENERATED_DIRS), "generated_directory").when(ends_with(name, GENERATED_SUFFIXES), "generated_filename").when(marked, "generated_marker")


def change_kind(path: Column, patch: Column) -> Column:
    """The first rule that holds: merge, submodule, binary, generated or vendored, test, docs, dependency, source, other."""
    parts, name, _ = path_parts(path)
    requirements = name.rlike(r"^(requirements|constraints).*\.(txt|in)$")
    return (
        F.when(patch.rlike(r"^diff --(cc|combined) "), "merge_resolution")
        .when(patch.contains("Subproject commit ") | patch.rlike(r"(?m)^(?:new |deleted )?file mode 160000$"), "submodule")
        .when(patch.contains("GIT binary patch") | patch.rlike(r"(?m)^Binary files .+ differ$"), "binary")
        .when(generated_reason(path, patch).isNotNull(), "generated_vendor")
        .when(holds_any(parts, TEST_DIRS) | name.startswith("test_") | ends_with(name, TEST_SUFFIXES), "test")
        .when(holds_any(parts, DOC_DIRS) | ends_with(name, DOC_SUFFIXES) | name.isin(*DOC_NAMES), "docs")
        .when(name.isin(*DEPENDENCY_NAMES) | requirements | ends_with(name, (".lock", ".sum")), "dependency")
        .when(ends_with(name, SOURCE_SUFFIXES), "source")
        .otherwise("other")
    )


def admission(kinds: Column, bytes_: Column, most: int | None = None) -> Column:
    """Why a change is let in or kept out, from the kinds of its paths."""
    distinct = F.array_distinct(kinds)
    first_party = F.exists(kinds, lambda k: k.isin("source", "merge_resolution", "other"))
    over = F.lit(False) if most is None else bytes_ > most
    return F.when(F.size(kinds) == 0, "empty").when(over, "oversize").when(first_party, "admitted").when(F.size(distinct) == 1, F.concat(distinct[0], F.lit("_only"))).otherwise("no_first_party_source")


def normalise_component(value: Column) -> Column:
    """Strip a/, b/ and ./ in this order, each once; slashes forward; lower case."""
    out = F.replace(F.trim(value), F.lit("\\"), F.lit("/"))
    for start in ("^a/", "^b/", r"^\./"):
        out = F.regexp_replace(out, start, "")
    return F.lower(out)


def strict_answer(text: Column) -> Column:
    """true for YES, false for NO, both trimmed and exact; anything else is null."""
    word = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(word == "YES", True).when(word == "NO", False)


def suspect_reason(reason: Column) -> Column:
    tag = reason.rlike(r"^[a-z0-9_:.-]{1,80}$")
    return ~tag & ((F.length(reason) > 80) | reason.contains("\n") | reason.rlike(r"[^\x00-\x7F]"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truth_literal(value: Column) -> Column:
    """Positive, negative, or null for excluded; other literals raise."""
    v = F.lower(F.trim(value))
    bad = F.raise_error(F.concat(F.lit("unsupported truth: "), v)).cast("boolean")
    return F.when(v.isin("yes", "positive", "fix", "true", "1"), True).when(v.isin("no", "negative", "context", "introduce", "other", "false", "0"), False).when(v.isin("backport", "abstain", "unknown", "excluded"), F.lit(None).cast("boolean")).otherwise(F.when(v.isNotNull(), bad))


def prediction_literal(value: Column) -> Column:
    """YES, NO, or null for uncovered; other literals raise."""
    v = F.upper(F.trim(value))
    bad = F.raise_error(F.concat(F.lit("unsupported prediction: "), v)).cast("boolean")
    return F.when(v == "YES", True).when(v == "NO", False).when(v.isNull() | v.isin("ABSTAIN", "ERROR", "MALFORMED", "SKIPPED"), F.lit(None).cast("boolean")).otherwise(bad)


def canonical_json(*columns: str) -> Column:
    """Keys in order, nulls kept, compact."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def stable_score(seed: str, value: Column) -> Column:
    """A number in [0, 1) from 52 bits of sha256(seed, NUL, value)."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\0"), value).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / 2.0**52


def commit_refs(text: Column) -> Column:
    """(host, repo, sha, url) of each commit that the text links to, in order; of several links to one commit the first."""
    links = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COMMIT_URL), 0)
    part = lambda x, k: F.lower(F.regexp_extract(x, COMMIT_URL, k))
    refs = F.transform(links, lambda x: F.struct(F.lit("github.com").alias("host"), F.concat_ws("/", part(x, 1), part(x, 2)).alias("repo"), part(x, 3).alias("sha"), x.alias("url")))
    named = F.transform(refs, lambda r: F.concat_ws("@", r["repo"], r["sha"]))
    return F.filter(refs, lambda r, k: F.array_position(named, F.concat_ws("@", r["repo"], r["sha"])) == k + 1)


def advisory_refs(details: Column, references: Column) -> Column:
    """commit_refs() of an advisory's details and then its references, an array of addresses."""
    return commit_refs(F.concat_ws("\n", F.coalesce(details, F.lit("")), references))


def file_sections(diff: Column) -> Column:
    """A diff's file sections; what stands before the first header is dropped."""
    pieces = F.split(normalize_newlines(diff), r"(?m)(?=^diff --(?:git|cc|combined) )")
    return F.filter(pieces, lambda s: s.rlike(r"^diff --(?:git|cc|combined) "))


def leaks_disclosure(diff: Column) -> Column:
    """An added line names an advisory."""
    return F.exists(F.split(normalize_newlines(diff), "\n"), lambda s: s.startswith("+") & ~s.startswith("+++") & s.rlike(ADVISORY_ID))
