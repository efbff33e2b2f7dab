"""Queries of contracts, budgets, splits and run figures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospector.functions import calls, contracts
from prospector.functions.stats import rate
from prospector.operators import runs, splits
from prospector.plans.catalog import DECISIONS, C, choose, choose_sql, decisions, load, query, rounded

joined = lambda c: F.array_join(c, "; ").alias("problems")


def rules_sql(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {when} THEN '{text}' END" for text, when in rules) + "], lambda x: x IS NOT NULL), '; ') AS problems"


# --- contracts

USAGE_SQL = rules_sql(("negative tokens", "i < 0"), ("total below its parts", "t < i + o"), ("cost not a finite amount", "c < 0"))


@query(f"WITH u AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) - 3 AS i, l_linenumber * 5 AS o, CASE WHEN l_partkey % 7 > 0 THEN l_suppkey % 60 END AS t, CASE WHEN l_discount > 0.02 THEN l_tax - 0.01 END AS c FROM lineitem) SELECT l_orderkey, l_linenumber, {USAGE_SQL} FROM u")
def usage_problems(spark, d):
    x = load(spark, d, "lineitem")
    total = F.when(C("l_partkey") % 7 > 0, C("l_suppkey") % 60)
    cost = F.when(C("l_discount") > 0.02, C("l_tax") - 0.01)
    return x.select("l_orderkey", "l_linenumber", joined(contracts.usage_problems(C("l_quantity").cast("long") - 3, C("l_linenumber").cast("long") * 5, total, cost)))


GRADES, ORIGINS = ("low", "high", "severe", "critical", "unknown"), ("cvss", "human", "rumour", "advisory")
SEVERITY_SQL = rules_sql(
    ("unknown level", "lv NOT IN ('low', 'medium', 'high', 'critical', 'unknown')"), ("unknown source", "so NOT IN ('cvss', 'advisory', 'repository', 'human', 'model_estimate')"),
    ("score outside 0 to 10", "sc < 0 OR sc > 10"), ("empty vector", "trim(ve) = ''"), ("vector without cvss", "ve IS NOT NULL AND so <> 'cvss'"),
)


@query(f"WITH s AS (SELECT event_id, {choose_sql(GRADES, 'event_id')} AS lv, {choose_sql(ORIGINS, 'user_id')} AS so, value / 10 - 1 AS sc, CASE event_id % 3 WHEN 0 THEN 'AV:N' WHEN 1 THEN ' ' END AS ve FROM events) SELECT event_id, {SEVERITY_SQL} FROM s")
def severity_problems(spark, d):
    vector = F.when(C("event_id") % 3 == 0, "AV:N").when(C("event_id") % 3 == 1, " ")
    return load(spark, d, "events").select("event_id", joined(contracts.severity_problems(choose(GRADES, C("event_id")), choose(ORIGINS, C("user_id")), C("value") / 10 - 1, vector)))


PLACES = ("src/a.c", "/etc/x", "a/../b", "", "b\\c", "lib/..x/d.go")
ANCHOR_SQL = rules_sql(
    ("unknown revision", "rev IS NULL OR rev NOT IN ('parent', 'commit', 'head')"), ("not a full sha", "NOT regexp_full_match(sha, '[0-9a-f]{40}|[0-9a-f]{64}')"),
    ("bad path", "trim(p) = '' OR starts_with(p, '/') OR contains(p, chr(92)) OR list_contains(string_split(p, '/'), '..')"), ("bad line range", "a < 1 OR b < a"),
    ("empty quote", "trim(q) = ''"), ("long quote", "length(q) > 500"), ("no claim", "len(s) < 1"), ("repeated claim", "len(list_distinct(s)) < len(s)"),
)


@query(f"""WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'parent' WHEN 1 THEN 'commit' WHEN 2 THEN 'head' WHEN 3 THEN 'tip' END AS rev, left(sha256(text), CASE WHEN doc_id % 4 > 0 THEN 40 ELSE 39 END) AS sha, {choose_sql(PLACES, 'doc_id')} AS p, doc_id % 4 AS a, n_chars % 9 AS b,
  CASE WHEN doc_id % 11 > 0 THEN text ELSE ' ' END AS q, CASE doc_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [lang, 'en'] ELSE ['impact'] END AS s FROM documents) SELECT doc_id, {ANCHOR_SQL} FROM a""")
def anchor_problems(spark, d):
    k = C("doc_id")
    revision = F.when(k % 5 == 0, "parent").when(k % 5 == 1, "commit").when(k % 5 == 2, "head").when(k % 5 == 3, "tip")
    sha = F.left(F.sha2("text", 256), F.when(k % 4 > 0, 40).otherwise(39))
    claims = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array("lang", F.lit("en"))).otherwise(F.array(F.lit("impact")))
    anchor = F.struct(
        revision.alias("revision"), sha.alias("revision_sha"), choose(PLACES, k).alias("path"), (k % 4).alias("start_line"), (C("n_chars") % 9).alias("end_line"),
        F.when(k % 11 > 0, C("text")).otherwise(" ").alias("quoted_span"), claims.alias("supports"),
    )
    return load(spark, d, "documents").select("doc_id", anchor.alias("a")).select("doc_id", joined(contracts.anchor_problems(C("a"))))


# --- model answers, budgets and runs

REFUSALS = ("Request too large for model", "You exceeded your current quota", "Rate limit reached, try again in 20ms", "see BILLING page", "key sk-abcdefgh12345 of org-ABCDEFGH99 failed")
SPANS = ("1h2m3s4ms", "250ms", "6m0s", "17.5", "-3", "soon", "")


@query(f"""WITH e AS (SELECT event_id, {choose_sql(REFUSALS, 'event_id')} AS r, {choose_sql(SPANS, 'event_id')} AS t FROM events)
  SELECT event_id, CASE WHEN regexp_matches(r, '(?i)too large') THEN 'oversize' WHEN regexp_matches(r, '(?i)quota|billing') THEN 'quota' ELSE 'retry' END AS kind,
  CASE t WHEN '1h2m3s4ms' THEN 3723.004 WHEN '250ms' THEN 0.25 WHEN '6m0s' THEN 360 WHEN '17.5' THEN 17.5 WHEN '-3' THEN 0 END::DOUBLE AS seconds, regexp_replace(regexp_replace(r, 'sk-[A-Za-z0-9_-]{{8,}}', 'sk-<redacted>'), 'org-[A-Za-z0-9]{{8,}}', 'org-<redacted>') AS safe FROM e""")
def refusals(spark, d):
    """What a service's refusal means, how long it lasts, and its text without secrets."""
    e = load(spark, d, "events").select("event_id", choose(REFUSALS, C("event_id")).alias("r"), choose(SPANS, C("event_id")).alias("t"))
    return e.select("event_id", calls.rate_limit_kind(C("r")).alias("kind"), F.round(calls.reset_seconds(C("t")), 6).alias("seconds"), calls.redact_secrets(C("r")).alias("safe"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_answers(spark, d):
    """Answers bare, fenced, or no object."""
    kind = C("event_id") % 3
    text = F.when(kind == 0, C("props")).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return load(spark, d, "events").select("event_id", calls.json_answer(text, "k bigint")["k"].alias("k"))


@query("""WITH c AS (SELECT l_orderkey AS item, l_linenumber AS i, CASE WHEN l_discount > 0.09 THEN 'backend_error' WHEN l_discount > 0.07 THEN 'malformed' ELSE 'valid' END AS status, l_returnflag = 'R' AS yes, l_tax > 0.04 AS again, l_partkey AS ms, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS tokens FROM lineitem),
  f AS (SELECT item, count(*) AS n, count(*) FILTER (status = 'valid') AS v, count(*) FILTER (status = 'valid' AND yes) AS y, count(*) FILTER (status = 'backend_error') AS b, coalesce(bool_or(status <> 'valid' AND again), false) AS retryable, sum(ms) AS latency_ms, sum(tokens) AS tokens,
    array_to_string(list_sort(list(i) FILTER (status <> 'valid')), ', ') AS failed FROM c GROUP BY item)
  SELECT item, CASE WHEN y > 0 THEN 'YES' WHEN v = n THEN 'NO' END AS verdict, CASE WHEN v = n THEN 'valid' WHEN y > 0 THEN 'partial' WHEN b > 0 THEN 'backend_error' ELSE 'malformed' END AS status,
    CASE WHEN v = n THEN NULL WHEN b > 0 THEN 'backend_error' ELSE 'malformed' END AS error, CASE WHEN v < n THEN failed END AS failed, retryable, latency_ms::BIGINT AS latency_ms, tokens::BIGINT AS tokens FROM f""")
def chunk_fold(spark, d):
    x = load(spark, d, "lineitem")
    status = F.when(C("l_discount") > 0.09, "backend_error").when(C("l_discount") > 0.07, "malformed").otherwise("valid")
    c = x.select(
        C("l_orderkey").alias("item"), C("l_linenumber").alias("index"), status.alias("status"), F.when(C("l_returnflag") == "R", "YES").otherwise("NO").alias("verdict"), (C("l_tax") > 0.04).alias("retryable"),
        C("l_partkey").alias("latency_ms"), F.when(C("l_suppkey") % 3 > 0, C("l_suppkey")).alias("tokens"), F.lit(False).alias("cache_hit"),
    )
    return runs.fold_chunks(c, "item").drop("cache_hit")


CAPS = runs.Limits(calls=400, tokens=9000, cost=60.0)


@query("""WITH r AS (SELECT user_id, count(*) - 20 AS calls, sum(CAST(floor(value) AS BIGINT)) AS tokens, count(*) FILTER (event_type = 'error') * 1.5 AS cost FROM events GROUP BY user_id), k AS (SELECT *, greatest(calls, 0) AS n FROM r),
  s AS (SELECT *, CASE WHEN tokens >= 9000 THEN 0 WHEN n = 0 THEN 1 WHEN tokens = 0 THEN 8 ELSE greatest(floor((9000 - tokens) / (tokens / n)), 1) END AS a, CASE WHEN cost >= 60 THEN 0 WHEN n = 0 THEN 1 WHEN cost = 0 THEN 8 ELSE greatest(floor((60 - cost) / (cost / n)), 1) END AS b FROM k)
  SELECT user_id, CAST(greatest(least(8, 400 - n, a, b), 0) AS BIGINT) AS slots, CASE WHEN n >= 400 THEN 'calls' WHEN tokens >= 9000 THEN 'tokens' WHEN cost >= 60 THEN 'cost' END AS reason FROM s""")
def call_slots(spark, d):
    r = load(spark, d, "events").groupBy("user_id").agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("calls"), F.sum(F.floor("value")).alias("tokens"), (F.count_if(C("event_type") == "error") * 1.5).alias("cost"))
    figures = (C("calls"), C("tokens"), C("cost"))
    return r.select("user_id", runs.call_slots(CAPS, 8, *figures).alias("slots"), runs.exhausted(CAPS, *figures).alias("reason"))


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def pending(spark, d):
    """What a resumed run still has to do under its configuration."""
    done = load(spark, d, "orders").select(C("o_custkey").alias("key"), C("o_orderstatus").alias("config"))
    return runs.pending(load(spark, d, "customer").select(C("c_custkey").alias("key")), done, "F")


@query(f"WITH {DECISIONS} SELECT repository, count(*) AS calls, sum(CASE WHEN value > 10 THEN CAST(floor(value) AS BIGINT) ELSE 0 END)::BIGINT AS tokens, round(sum(CASE WHEN value > 10 THEN value ELSE 0 END), 6) AS cost, count(*) FILTER (prediction = 'YES') AS yes, count(*) FILTER (prediction = 'NO') AS no, count(*) FILTER (prediction = 'ABSTAIN') AS abstain, count(*) FILTER (prediction = 'ERROR') AS errors  FROM dec GROUP BY repository")
def run_counters(spark, d):
    value = F.when(C("value") > 10, C("value"))
    x = decisions(spark, d).select("repository", C("prediction").alias("verdict"), F.floor(value).alias("tokens"), value.alias("cost"))
    return runs.counters(x, "repository").select("repository", "calls", "tokens", F.round("cost", 6).alias("cost"), "yes", "no", "abstain", "errors")


@query("SELECT p_partkey, p_retailprice >= 1000 AND p_size % 9 = 0 AS a, p_size AS done, CASE WHEN p_size >= 40 OR p_size * 3 < 1 THEN NULL ELSE printf('%02d:%02d', ((40 - p_size) * 90 // p_size) // 60 % 60, (40 - p_size) * 90 // p_size % 60) END AS time_left FROM part")
def time_left(spark, d):
    x = load(spark, d, "part")
    return x.select("p_partkey", ((C("p_retailprice") >= 1000) & (C("p_size") % 9 == 0)).alias("a"), C("p_size").alias("done"), calls.time_left(C("p_size"), F.lit(40), F.lit(90)).alias("time_left"))


@query("SELECT p_type, count(*) AS seen, count(*) FILTER (p_size > 20) AS admitted, count(*) FILTER (p_size <= 20) AS rejected, round(count(*) FILTER (p_size <= 20) / count(*), 4) AS reduction_rate FROM part GROUP BY p_type")
def prefilter_stats(spark, d):
    return runs.prefilter_stats(load(spark, d, "part").select("p_type", (C("p_size") > 20).alias("admit")), "p_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counted(spark, d):
    return runs.counted(load(spark, d, "events"), "event_type", "event_id")


@query(f"""WITH {DECISIONS} SELECT 'prefilter' AS stage, CASE WHEN p_size > 20 THEN 'admitted' ELSE 'rejected' END AS outcome, count(*) AS n FROM part GROUP BY ALL
  UNION ALL SELECT 'triage', CASE WHEN prediction IN ('YES', 'NO') THEN lower(prediction) ELSE 'error' END AS outcome, count(*) FROM dec GROUP BY outcome
  UNION ALL SELECT 'review', CASE WHEN prediction IN ('YES', 'NO') THEN lower(prediction) ELSE 'abstain' END AS outcome, count(*) FROM dec WHERE truth = 'fix' GROUP BY outcome""")
def funnel(spark, d):
    x = decisions(spark, d).withColumnRenamed("prediction", "verdict")
    return runs.funnel(load(spark, d, "part").select((C("p_size") > 20).alias("admit")), x, x.where("truth = 'fix'"))


@query("""WITH b AS (SELECT c_custkey AS sha, c_mktsegment AS repo, 'fix' AS role, CASE WHEN c_nationkey > 9 THEN 'high' END AS confidence FROM customer), p AS (SELECT s_suppkey * 3 AS sha, CASE WHEN s_nationkey % 2 = 0 THEN 'other' END AS role, CASE WHEN s_nationkey > 12 THEN 'low' END AS confidence FROM supplier)
  SELECT sha, coalesce(b.repo, 'main') AS repo, CASE WHEN p.sha IS NULL THEN b.role ELSE p.role END AS role, coalesce(CASE WHEN p.sha IS NULL THEN b.confidence ELSE p.confidence END, 'medium') AS confidence, CASE WHEN p.sha IS NULL THEN 'matrix' ELSE 'panel' END AS source FROM b FULL JOIN p USING (sha)""")
def truth_merge(spark, d):
    b = load(spark, d, "customer").select(C("c_custkey").alias("sha"), C("c_mktsegment").alias("repo"), F.lit("fix").alias("role"), F.when(C("c_nationkey") > 9, "high").alias("confidence"))
    p = load(spark, d, "supplier").select((C("s_suppkey") * 3).alias("sha"), F.when(C("s_nationkey") % 2 == 0, "other").alias("role"), F.when(C("s_nationkey") > 12, "low").alias("confidence"))
    return runs.merge_truth(b, p, "main")


OUTCOME = "CASE WHEN truth = 'fix' AND prediction = 'YES' THEN 'TP' WHEN prediction = 'YES' THEN 'FP' ELSE 'FN' END"


@query(f"""WITH {DECISIONS}, s AS (SELECT DISTINCT item AS sha, {OUTCOME} AS outcome, seq % 2 AS half FROM dec), n AS (SELECT sha, outcome FROM s WHERE half = 0 AND outcome <> 'FN'), o AS (SELECT sha, outcome FROM s WHERE half = 1 AND outcome <> 'FN')
  SELECT CASE outcome WHEN 'TP' THEN 'gained' ELSE 'added' END AS change, sha FROM (FROM n EXCEPT FROM o) UNION ALL SELECT CASE outcome WHEN 'TP' THEN 'lost' ELSE 'fixed' END, sha FROM (FROM o EXCEPT FROM n)""")
def report_diff(spark, d):
    x = decisions(spark, d).select(C("item").alias("sha"), F.expr(OUTCOME).alias("outcome"), (C("seq") % 2).alias("half"))
    return runs.report_diff(x.where("half = 0").drop("half"), x.where("half = 1").drop("half"))


SQUEEZE = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id % 97 AS finding, CAST(doc_id + doc_id % 2 AS VARCHAR) AS path, CASE WHEN doc_id % 5 > 0 THEN substr(text, 10, 30) ELSE '' END AS q FROM documents), b AS (SELECT CAST(doc_id AS VARCHAR) AS path, text FROM documents WHERE doc_id % 3 > 0)
  SELECT finding, bool_or(CASE WHEN {SQUEEZE('q')} <> '' THEN coalesce(contains({SQUEEZE('text')}, {SQUEEZE('q')}), false) END) AS applies FROM f LEFT JOIN b USING (path) GROUP BY finding""")
def still_applies(spark, d):
    x, k = load(spark, d, "documents"), C("doc_id")
    f = x.select((k % 97).alias("finding"), (k + k % 2).cast("string").alias("path"), F.when(k % 5 > 0, F.substring("text", 10, 30)).otherwise("").alias("quoted_span"))
    return runs.still_applies(f, x.where("doc_id % 3 > 0").select(k.cast("string").alias("path"), "text"))


@query("""WITH f AS (SELECT page_id, unnest(string_split(replace(html, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(html, chr(13) || chr(10), chr(10)), chr(10)), 1) AS k FROM pages),
  c AS (SELECT page_id, k, unnest(list_distinct(regexp_extract_all(line, '([A-Za-z_$][\\w$]*)\\s*\\(', 1))) AS name FROM f WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(def|func|function) '))
  SELECT page_id AS path, k::INT AS line, name FROM c WHERE name IN ('get', 'push', 'function', 'track', 'url', 'rgba', 'log') ORDER BY path, line, name LIMIT 100""")
def similar_call_sites(spark, d):
    """The first 100 lines that call one of some names."""
    names = spark.createDataFrame([(n,) for n in ("get", "push", "function", "track", "url", "rgba", "log")], "name string")
    return runs.similar_call_sites(names, load(spark, d, "pages").select(C("page_id").alias("path"), C("html").alias("text"))).select("path", "line", "name")


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type, user_id % 5) AS n FROM events) SELECT event_type, user_id % 5 AS part, value AS quantile FROM l WHERE k = round_even((n - 1) * 0.95, 0)")
def quantiles(spark, d):
    return runs.quantile(load(spark, d, "events").select("event_type", (C("user_id") % 5).alias("part"), "value"), ["event_type", "part"], "value", 0.95)


@query(f"""WITH {DECISIONS}, s AS (SELECT run, count(*) FILTER (truth = 'fix' AND prediction = 'YES') / nullif(count(*) FILTER (truth = 'fix' AND prediction IN ('YES', 'NO')), 0) AS recall, count(*) FILTER (truth = 'fix' AND value > 90 AND prediction = 'YES') / nullif(count(*) FILTER (truth = 'fix' AND value > 90), 0) AS quiet_recall, count(*) FILTER (prediction NOT IN ('YES', 'NO')) AS uncovered FROM dec GROUP BY run)
  SELECT run, round(recall, 9) AS recall, round(quiet_recall, 9) AS quiet_recall, uncovered, coalesce(recall >= 0.95, false) AS recall_met, coalesce(quiet_recall >= 0.9, false) AS quiet_recall_met, uncovered = 0 AS all_evaluated, coalesce(recall >= 0.95, false) AND coalesce(quiet_recall >= 0.9, false) AND uncovered = 0 AS qualifies FROM s""")
def gates(spark, d):
    fix, yes, sure = C("truth") == "fix", C("prediction") == "YES", C("prediction").isin("YES", "NO")
    n = F.count_if
    s = decisions(spark, d).groupBy("run").agg(rate(n(fix & yes), n(fix & sure)).alias("recall"), rate(n(fix & yes & (C("value") > 90)), n(fix & (C("value") > 90))).alias("quiet_recall"), n(~sure).alias("uncovered"))
    return rounded(runs.gates(s))


# --- splits


def assignments(spark, d):
    """Every seventh group lies in two splits, and some records occur twice."""
    k = C("o_orderkey")
    split = F.when((C("o_custkey") % 5 == 0) | ((C("o_custkey") % 7 == 0) & (k % 2 == 0)), "holdout").when(k % 501 == 0, "both").otherwise("development")
    return load(spark, d, "orders").select((k - F.when(k % 400 == 1, 1).otherwise(0)).alias("record"), C("o_custkey").alias("group"), split.alias("split"))


ASSIGNED = "a AS (SELECT o_orderkey - CASE WHEN o_orderkey % 400 = 1 THEN 1 ELSE 0 END AS record, o_custkey AS grp, CASE WHEN o_custkey % 5 = 0 OR (o_custkey % 7 = 0 AND o_orderkey % 2 = 0) THEN 'holdout' WHEN o_orderkey % 501 = 0 THEN 'both' ELSE 'development' END AS split FROM orders)"


@query(f"WITH {ASSIGNED} SELECT split, count(*) AS records, count(DISTINCT grp) AS groups FROM a GROUP BY split")
def split_counts(spark, d):
    return splits.split_counts(assignments(spark, d))


@query(f"""WITH {ASSIGNED} SELECT 'repeated record' AS problem, CAST(record AS VARCHAR) AS subject FROM a GROUP BY record HAVING count(*) > 1
  UNION ALL SELECT 'group in several splits', CAST(grp AS VARCHAR) FROM a GROUP BY grp HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'unknown split', CAST(record AS VARCHAR) FROM a WHERE split = 'both'""")
def manifest_problems(spark, d):
    return splits.manifest_problems(assignments(spark, d))


WORD = lambda k: f"CAST(sum(CAST(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT) AS DECIMAL(38,0))) AS VARCHAR)"


@query(f"""WITH r AS (SELECT sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}}') AS h FROM events), s AS (SELECT count(*) AS rows, {", ".join(f"{WORD(k)} AS w{k}" for k in range(4))} FROM r)
  SELECT rows, 'sha256:' || sha256(concat_ws('|', rows, w0, w1, w2, w3)) AS dataset_hash FROM s""")
def dataset_hash(spark, d):
    return splits.dataset_hash(load(spark, d, "events").select("event_id", "event_type", "user_id"))
