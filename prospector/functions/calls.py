"""Answers, limits and errors of model services as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospector.functions.text import squeeze

# Phrases by which services tell terminal refusals from passing ones, and forms of secrets.
OVERSIZE = r"(?i)request too large|maximum context length|reduce the length of the messages"
QUOTA = r"(?i)insufficient[_ ]quota|exceeded your current quota|billing"
DURATION = r"^(?:([0-9.]+)h)?(?:([0-9.]+)m(?!s))?(?:([0-9.]+)s)?(?:([0-9.]+)ms)?$"
SECRETS = ((r"sk-[A-Za-z0-9_-]{8,}", "sk-<redacted>"), (r"org-[A-Za-z0-9]{8,}", "org-<redacted>"))
FENCE = r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$"


def rate_limit_kind(detail: Column) -> Column:
    """oversize and quota are final; retry is not."""
    return F.when(detail.rlike(OVERSIZE), "oversize").when(detail.rlike(QUOTA), "quota").otherwise("retry")


def reset_seconds(text: Column) -> Column:
    """Seconds of 1h2m3s4ms or of a plain number, at least 0; null for anything else."""
    t = F.trim(text)
    part = lambda k, per: F.coalesce(F.regexp_extract(t, DURATION, k).try_cast("double"), F.lit(0.0)) * per
    spelled = part(1, 3600.0) + part(2, 60.0) + part(3, 1.0) + part(4, 0.001)
    plain = t.try_cast("double")
    return F.when(plain.isNotNull(), F.greatest(plain, F.lit(0.0))).when((t != "") & t.rlike(DURATION), spelled)


def redact_secrets(text: Column, key: str = "") -> Column:
    out = F.replace(text, F.lit(key), F.lit("<redacted>")) if key else text
    for form, instead in SECRETS:
        out = F.regexp_replace(out, form, instead)
    return out


def json_answer(text: Column, schema: str) -> Column:
    """The object of an answer, code fences stripped; null if it is no object."""
    inner = F.trim(F.coalesce(F.nullif(F.regexp_extract(text, FENCE, 1), F.lit("")), text))
    return F.when(inner.startswith("{"), F.from_json(inner, schema))


def usage_tokens(total: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """total, else the sum of its parts, at least 0."""
    return F.greatest(F.coalesce(total, F.coalesce(tokens_in, F.lit(0)) + F.coalesce(tokens_out, F.lit(0))), F.lit(0))


def usage_cost(cost: Column) -> Column:
    """Unknown, negative and not finite amounts are 0."""
    return F.when((cost > 0) & (cost < float("inf")), cost).otherwise(0.0)


def estimated_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: float = 1.25, price_cached: float = 0.125, price_out: float = 10.0) -> Column:
    """Dollars at prices a million tokens; cached tokens are part of tokens_in."""
    return ((tokens_in - cached) * price_in + cached * price_cached + tokens_out * price_out) / 1e6


def same_revision(a: Column, b: Column) -> Column:
    """Equal, or one of 7 or more characters begins the other."""
    x, y = F.lower(a), F.lower(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | ((F.length(short) >= 7) & F.startswith(long, short))


def citation_key(sha: Column, path: Column, start: Column, end: Column) -> Column:
    """Identity of a cited range, whatever it is cited for."""
    return F.sha2(F.to_json(F.struct(F.lower(sha).alias("sha"), path.alias("path"), start.alias("start"), end.alias("end")), {"ignoreNullFields": "false"}), 256)


def quote_in(quote: Column, source: Column) -> Column:
    """Whether source holds the quote, white space apart; null where there is no quote."""
    return F.when(squeeze(quote) != "", F.coalesce(F.contains(squeeze(source), squeeze(quote)), F.lit(False)))


def clock(seconds: Column) -> Column:
    """mm:ss, from an hour on h:mm:ss."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def time_left(done: Column, total: Column, seconds: Column) -> Column:
    """Time that the rest takes at the pace so far; null where that says nothing."""
    left = (total - done) * seconds / done
    return F.when((done > 0) & (done < total) & (seconds > 0) & (left >= 1), clock(left))


def throughput(done: Column, seconds: Column) -> Column:
    pace = done / seconds
    return F.when((done > 0) & (seconds > 0), F.when(pace >= 1, F.concat(F.format_string("%.1f", pace), F.lit("/s"))).otherwise(F.concat(F.format_string("%.1f", pace * 60), F.lit("/min"))))


def archetype(components: Column) -> Column:
    """Coarse kind of a repository by the names of its components, the first kind that fits."""
    names = F.lower(F.array_join(components, " "))
    return F.when(names.rlike(r"cmd/|main\.go|cli"), "cli").when(names.rlike(r"server|handler|router|http|context\.go"), "server").when(names.rlike("parser|decode|codec|lexer"), "parser").otherwise("library")


# Other names of verdicts, those a stage accepts, and those that go on to review.
ALIASES = {"TRUE": "YES", "FIX": "YES", "SECURITY_FIX": "YES", "SECURITY-FIX": "YES", "FALSE": "NO", "NOT_A_FIX": "NO", "NOT-A-FIX": "NO", "SKIP": "NO", "FALLBACK": "ERROR"}
ACCEPTED = {"triage": ("YES", "NO", "CANDIDATE", "ABSTAIN", "ERROR"), "adjudication": ("YES", "NO", "ABSTAIN", "ERROR")}
CANDIDATES = ("YES", "CANDIDATE", "ABSTAIN", "ERROR")


def verdict_of(result: Column, stage: str = "triage") -> Column:
    """The verdict in a stage's JSON result: verdict, decision or label, else flagged or candidate; ERROR if it is none of the stage's."""
    said = F.coalesce(*[F.get_json_object(result, f"$.{k}") for k in ("verdict", "decision", "label", "flagged", "candidate")], F.lit(""))
    name = F.upper(F.trim(said))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    name = F.coalesce(F.try_element_at(known, name), name)
    return F.when(name.isin(*ACCEPTED[stage]), name).otherwise("ERROR")


def goes_on(verdict: Column) -> Column:
    return verdict.isin(*CANDIDATES)


def usage_payload(usage: Column) -> Column:
    """The five counters of a service's usage in JSON; what is missing, no number or negative is 0."""
    names = {"prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "total_tokens": "total_tokens", "cached_tokens": "prompt_tokens_details.cached_tokens", "reasoning_tokens": "completion_tokens_details.reasoning_tokens"}
    count = lambda path: F.greatest(F.coalesce(F.get_json_object(usage, f"$.{path}").try_cast("double").try_cast("long"), F.lit(0)), F.lit(0))
    return F.struct(*[count(path).alias(name) for name, path in names.items()])


def backoff(attempt: Column, suggested: Column, jitter: Column, initial: float = 1.0, most: float = 60.0, longest: float = 300.0) -> Column:
    """Seconds until the next attempt: doubling from `initial` up to `most`, half of it by chance, and never less than the service asks."""
    floor = F.least(F.lit(most), initial * F.pow(F.lit(2.0), attempt))
    return F.least(F.lit(longest), F.greatest(F.coalesce(suggested, F.lit(0.0)), floor * (0.5 + jitter / 2)))


def prompt_hash(system: Column, template: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(system, F.lit("\0"), template).cast("binary"), 256))


def prompt(template: Column, text: Column) -> Column:
    """The template with the text in its place."""
    return F.replace(template, F.lit("{diff}"), text)


def token_bound(messages: Column, output_tokens: Column) -> Column:
    """Tokens that an array of messages takes at most: a token is a byte at least, and each message takes four more."""
    size = F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + 4 + F.octet_length(F.coalesce(m, F.lit(""))))
    return size + F.greatest(output_tokens, F.lit(0))


def without_nulls(answer: Column, schema: str) -> Column:
    """A JSON object of a schema again as JSON, without the fields that are null, at any depth; null if it is none."""
    return F.to_json(F.from_json(answer, schema))


def revision_label(revision: Column, commit: Column, parent: Column, head: Column) -> Column:
    """commit, parent or head, by name or by id; null for any other revision."""
    name = F.lower(F.trim(revision))
    return F.when(name.isin("commit", "parent", "head"), name).when(same_revision(name, commit), "commit").when(same_revision(name, parent), "parent").when(same_revision(name, head), "head")


def abstained(reason: Column, rationale: Column) -> Column:
    """A decision that says no more than why there is none."""
    return F.struct(F.lit("ABSTAIN").alias("verdict"), F.lit("low").alias("confidence"), F.substring(squeeze(rationale), 1, 1200).alias("rationale"), F.substring(reason, 1, 500).alias("abstain_reason"))
