"""All queries of the engine's own operators over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospector.functions import diffs, stats, text
from prospector.operators import context, evaluation, graph, logs, reach, reports, runs

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def choose(values, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def choose_sql(values, k: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{k} % {len(values)} + 1]"


# --- relations that the queries share: decisions, messages, paths, findings, answers


def decisions(spark, d) -> DataFrame:
    return decided(load(spark, d, "events"))


def decided(e: DataFrame) -> DataFrame:
    verdict = F.when(C("event_type").isin("click", "purchase"), "YES").when(C("event_type") == "view", "NO").when(C("event_type") == "error", "ERROR").otherwise("ABSTAIN")
    truth = F.when(C("value") > 70, "fix").when(C("value") > 30, "context").when(C("value") > 5, "other").otherwise("backport")
    return e.select(C("event_id").alias("seq"), F.concat(F.lit("r"), C("user_id") % 7).alias("repository"), C("user_id").alias("item"), C("event_type").alias("run"), verdict.alias("prediction"), truth.alias("truth"), "value", "ts")


DECISIONS = """dec AS (SELECT event_id AS seq, 'r' || (user_id % 7) AS repository, user_id AS item, event_type AS run,
  CASE WHEN event_type IN ('click', 'purchase') THEN 'YES' WHEN event_type = 'view' THEN 'NO' WHEN event_type = 'error' THEN 'ERROR' ELSE 'ABSTAIN' END AS prediction,
  CASE WHEN value > 70 THEN 'fix' WHEN value > 30 THEN 'context' WHEN value > 5 THEN 'other' ELSE 'backport' END AS truth, value, ts FROM events)"""

TERMS = text.SECURITY_TERMS
MERGES = ("Merge branch", "Merge commit abc", "Merge commit from fork", "Merge remote-tracking", "Merge remote-tracking branch", "merge tag")


def messages(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select(C("o_orderkey").alias("seq"), "o_custkey")
    a, b = choose(TERMS, C("seq")), choose(TERMS, C("o_custkey"))
    n = C("seq") % 9
    body = (
        F.when(n == 0, "").when(n == 1, F.concat(choose(MERGES, C("o_custkey")), F.lit(" topic\n"), a)).when(n == 2, F.concat(F.lit("Fix CVE-2024-"), 10000 + C("seq")))
        .when(n == 3, F.concat(F.lit("security(core): tidy "), b)).when(n == 4, F.concat(F.lit("Tidy up\n\nNo "), a, F.lit(" here"))).when(n == 5, F.concat(F.lit("Refs GO-2024-0001, CWE-79, https://nvd.nist.gov/x/"), C("seq"), F.lit(" and "), a))
        .otherwise(F.concat(F.lit("Fix "), a, F.lit(" in parser\nAlso "), b, F.lit(", see docs")))
    )
    return o.select("seq", body.alias("message"), (C("seq") % 4 == 1).alias("is_merge"))


MESSAGES = f"""msg AS (SELECT o_orderkey AS seq, o_orderkey % 4 = 1 AS is_merge, CASE o_orderkey % 9
  WHEN 0 THEN '' WHEN 1 THEN {choose_sql(MERGES, "o_custkey")} || ' topic' || chr(10) || {choose_sql(TERMS, "o_orderkey")} WHEN 2 THEN 'Fix CVE-2024-' || (10000 + o_orderkey)
  WHEN 3 THEN 'security(core): tidy ' || {choose_sql(TERMS, "o_custkey")} WHEN 4 THEN 'Tidy up' || chr(10) || chr(10) || 'No ' || {choose_sql(TERMS, "o_orderkey")} || ' here'
  WHEN 5 THEN 'Refs GO-2024-0001, CWE-79, https://nvd.nist.gov/x/' || o_orderkey || ' and ' || {choose_sql(TERMS, "o_orderkey")}
  ELSE 'Fix ' || {choose_sql(TERMS, "o_orderkey")} || ' in parser' || chr(10) || 'Also ' || {choose_sql(TERMS, "o_custkey")} || ', see docs' END AS message FROM orders)"""


def has_sql(column: str, term: str) -> str:
    return rf"regexp_matches({column}, '(?i)(?:^|[^\p{{L}}\p{{N}}_-]){text.term_regex(term)}(?:$|[^\p{{L}}\p{{N}}_-])')"


def terms_sql(column: str, terms=TERMS) -> str:
    found = []
    for term in terms:
        rest = column
        for longer in text.longer_terms(term, terms):
            rest = rf"regexp_replace({rest}, '(?i)(^|[^\p{{L}}\p{{N}}_-]){text.term_regex(longer)}($|[^\p{{L}}\p{{N}}_-])', '\1#\2', 'g')"
        found.append(f"CASE WHEN {has_sql(rest, term)} THEN '{term}' END")
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


ADVISORY_SQL = r"regexp_matches(message, '(?i)\b(?:CVE-\d{4}-\d{4,}|GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4})\b')"

DIRS = ("src", "vendor/x", "docs", "tests", "lib/generated", "pkg/core", "third_party", "app")
ENDINGS = (".py", ".go", ".md", ".min.js", ".lock", "_test.go", ".txt", ".c", ".png", ".rs", ".java", ".kt", ".cs", ".ts", ".css")


def paths(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    k = C("p_partkey")
    path = F.concat(choose(DIRS, k), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), choose(ENDINGS, k))
    patch = F.when(k % 29 == 0, "diff --cc x\n").when(k % 31 == 0, "GIT binary patch\n").when(k % 37 == 0, "+Subproject commit abc\n").when(k % 5 == 4, "// Code generated by x; DO NOT EDIT\n").otherwise("+x\n")
    return p.select(k.alias("seq"), path.alias("path"), patch.alias("patch"), "p_brand", C("p_size").cast("long").alias("bytes"))


#: The rules once more, written for SQL and apart from those of the functions.
PATHS = f"""pth AS (SELECT p_partkey AS seq, p_brand, CAST(p_size AS BIGINT) AS bytes, {choose_sql(DIRS, "p_partkey")} || '/' || replace(p_name, ' ', '_') || {choose_sql(ENDINGS, "p_partkey")} AS path,
  CASE WHEN p_partkey % 29 = 0 THEN 'diff --cc x' || chr(10) WHEN p_partkey % 31 = 0 THEN 'GIT binary patch' || chr(10) WHEN p_partkey % 37 = 0 THEN '+Subproject commit abc' || chr(10)
  WHEN p_partkey % 5 = 4 THEN '// Code generated by x; DO NOT EDIT' || chr(10) ELSE '+x' || chr(10) END AS patch FROM part),
nam AS (SELECT *, lower(regexp_extract(path, '[^/]*$')) AS name, '/' || lower(path) AS low FROM pth),
gen AS (SELECT *, CASE WHEN regexp_matches(low, '/(vendors?|node_modules|third[_-]party|vendored|external)(/|$)') THEN 'vendor_directory' WHEN regexp_matches(low, '/(generated|dist)/') THEN 'generated_directory'
  WHEN regexp_matches(name, '(\\.min\\.(js|css)|\\.(js|css)\\.map|\\.pb\\.(go|cc|h)|\\.designer\\.cs|\\.g\\.dart)$') THEN 'generated_filename'
  WHEN regexp_matches(name, '\\.(go|rs|java|kt|cs|js|ts)$') AND contains(patch, 'DO NOT EDIT') THEN 'generated_marker' END AS reason FROM nam),
kin AS (SELECT *, CASE WHEN starts_with(patch, 'diff --cc ') THEN 'merge_resolution' WHEN contains(patch, 'Subproject commit ') THEN 'submodule' WHEN contains(patch, 'GIT binary patch') THEN 'binary' WHEN reason IS NOT NULL THEN 'generated_vendor'
  WHEN regexp_matches(low, '/(tests?|__tests__|specs?)(/|$)') OR regexp_matches(name, '^test_|_test\\.(go|py)$|\\.(test|spec)\\.(js|ts)$') THEN 'test' WHEN regexp_matches(low, '/docs?(/|$)') OR regexp_matches(name, '\\.(mdx?|rst|adoc|asciidoc)$') THEN 'docs'
  WHEN regexp_matches(name, '\\.(lock|sum)$') OR regexp_matches(name, '^(requirements|constraints).*\\.(txt|in)$') THEN 'dependency' WHEN regexp_matches(name, '\\.(c|go|rs|py|js|ts|java|kt|cs)$') THEN 'source' ELSE 'other' END AS kind FROM gen)"""

NOW = "2026-01-01 00:00:00"
LEVELS = ("unknown", "low", "medium", "high", "critical")


def findings(spark, d) -> DataFrame:
    x = load(spark, d, "lineitem")
    weight = stats.recency_weight(C("l_shipdate"), F.lit(NOW).cast("timestamp"))
    return x.select(
        (C("l_orderkey") * 8 + C("l_linenumber")).alias("seq"), F.concat("l_returnflag", "l_linestatus").alias("class"), F.concat(F.lit("c"), C("l_partkey") % 50).alias("component"),
        choose(LEVELS, C("l_linenumber")).alias("severity"), weight.alias("weight"), (C("l_suppkey") % 10).alias("entry"), F.when(C("l_partkey") % 3 > 0, F.lit("i")).alias("invariant"),
        F.when(C("l_suppkey") % 3 > 0, C("l_suppkey") % 3 == 1).alias("still_applies"), (C("l_linenumber") % 2 == 0).alias("guarded"),
    )


FINDINGS = f"""fin AS (SELECT l_orderkey * 8 + l_linenumber AS seq, l_returnflag || l_linestatus AS class, 'c' || (l_partkey % 50) AS component, {choose_sql(LEVELS, "l_linenumber")} AS severity,
  l_linenumber % 5 AS rank, pow(0.5, greatest(0.0, CAST(epoch(TIMESTAMP '{NOW}') - epoch(l_shipdate) AS BIGINT) / 86400.0) / 730.0) AS weight, l_suppkey % 10 AS entry,
  CASE WHEN l_partkey % 3 > 0 THEN 'i' END AS invariant, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 3 = 1 END AS still_applies, l_linenumber % 2 = 0 AS guarded FROM lineitem)"""


# --- summaries

Z = NormalDist().inv_cdf(0.975)
COUNTS = """count(*) FILTER (t AND p = 'YES') AS tp, count(*) FILTER (t AND p = 'NO') AS fn, count(*) FILTER (NOT t AND p = 'YES') AS fp, count(*) FILTER (NOT t AND p = 'NO') AS tn,
  count(*) FILTER (t AND p NOT IN ('YES', 'NO')) AS uncovered_positive, count(*) FILTER (NOT t AND p NOT IN ('YES', 'NO')) AS uncovered_negative, count(*) FILTER (t IS NULL) AS excluded"""
RATES = f"""tp / nullif(pos, 0) AS recall, tp / nullif(tp + fn, 0) AS covered_recall, fp / nullif(neg, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision,
  coalesce((tp + fn + fp + tn) / nullif(pos + neg, 0), 0.0) AS coverage,
  greatest(0.0, (tp / pos + {Z} * {Z} / (2 * pos)) / (1 + {Z} * {Z} / pos) - {Z} * sqrt(tp / pos * (1 - tp / pos) / pos + {Z} * {Z} / (4 * pos * pos)) / (1 + {Z} * {Z} / pos)) AS recall_low,
  least(1.0, (tp / pos + {Z} * {Z} / (2 * pos)) / (1 + {Z} * {Z} / pos) + {Z} * sqrt(tp / pos * (1 - tp / pos) / pos + {Z} * {Z} / (4 * pos * pos)) / (1 + {Z} * {Z} / pos)) AS recall_high"""
MEANING = "m AS (SELECT *, CASE truth WHEN 'fix' THEN true WHEN 'backport' THEN NULL ELSE false END AS t, prediction AS p FROM dec)"


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else C(c) for c, kind in df.dtypes])


def rounded_sql(sql: str, names: str) -> str:
    kept, doubles = (x.split() for x in names.split("|"))
    return f"WITH z AS ({sql}) SELECT {', '.join([*kept, *[f'round({x}, 9) AS {x}' for x in doubles]])} FROM z"


RATE_NAMES = "tp fn fp tn uncovered_positive uncovered_negative excluded | recall covered_recall fpr precision coverage recall_low recall_high"


@query(rounded_sql(f"WITH {DECISIONS}, {MEANING}, c AS (SELECT {COUNTS} FROM m) SELECT c.*, {RATES} FROM (SELECT *, tp + fn + uncovered_positive AS pos, fp + tn + uncovered_negative AS neg FROM c) c", RATE_NAMES))
def binary_summary(spark, d):
    return rounded(evaluation.confusion(decisions(spark, d)))


@query(rounded_sql(f"WITH {DECISIONS}, {MEANING}, c AS (SELECT repository, {COUNTS} FROM m GROUP BY repository) SELECT c.*, {RATES} FROM (SELECT *, tp + fn + uncovered_positive AS pos, fp + tn + uncovered_negative AS neg FROM c) c", "repository " + RATE_NAMES))
def per_stratum_summary(spark, d):
    return rounded(evaluation.confusion(decisions(spark, d), "repository"))


@query(rounded_sql(f"""WITH {DECISIONS}, {MEANING}, c AS (SELECT {COUNTS} FROM m), r AS (SELECT tp / (tp + fn + uncovered_positive) AS a, fp / (fp + tn + uncovered_negative) AS b FROM c)
  SELECT prevalence, prevalence * a + (1 - prevalence) * b AS candidates, prevalence * a / (prevalence * a + (1 - prevalence) * b) AS precision, 1000 * (prevalence * a + (1 - prevalence) * b) AS alerts,
  0.002 + (prevalence * a + (1 - prevalence) * b) * 0.02 AS cost FROM r, (VALUES (0.002::DOUBLE), (0.015::DOUBLE), (0.05::DOUBLE)) v(prevalence)""", "| prevalence candidates precision alerts cost"))
def operating_points(spark, d):
    """Candidate rate, precision, alerts and cost of a cascade at three prevalences."""
    r = evaluation.confusion(decisions(spark, d)).select("recall", "fpr", F.explode(F.array(*[F.lit(p) for p in (0.002, 0.015, 0.05)])).alias("prevalence"))
    args = C("recall"), C("fpr"), C("prevalence")
    rate = stats.candidate_rate(*args)
    return rounded(r.select("prevalence", rate.alias("candidates"), stats.precision_at(*args).alias("precision"), stats.alerts_per_1000(*args).alias("alerts"), stats.cascade_cost(F.lit(0.002), F.lit(0.02), rate).alias("cost")))


@query("SELECT n_regionkey AS trials, round(CASE WHEN n_regionkey > 0 THEN 1 - pow(0.05, 1 / n_regionkey) END, 9) AS bound FROM (SELECT DISTINCT p_size AS n_regionkey FROM part)")
def zero_event_bound(spark, d):
    return load(spark, d, "part").select(C("p_size").alias("trials")).distinct().select("trials", F.round(stats.zero_event_bound(C("trials")), 9).alias("bound"))


def block_bootstrap(spark, d):
    """No SQL: a seeded generator draws the blocks."""
    return evaluation.block_bootstrap(decisions(spark, d))


QUERIES["block_bootstrap"] = block_bootstrap
SHARE = "CAST('0x' || substr(sha256('7' || chr(0) || sample || '|' || {0}), 1, 13) AS BIGINT) / pow(2, 52)"
DRAWS = " + ".join(f"CAST({SHARE.format('item')} >= {sum(math.exp(-1) / math.factorial(j) for j in range(k))!r} AS INT)" for k in range(1, 14))


@query(f"""WITH {DECISIONS}, {MEANING}, c AS (SELECT item, {COUNTS} FROM m GROUP BY item), n AS (SELECT item, tp, tp + fn + uncovered_positive AS pos, fp, fp + tn + uncovered_negative AS neg FROM c),
  w AS (SELECT *, {DRAWS} AS w FROM n, (SELECT unnest(range(1, 201)) AS sample)), s AS (SELECT sample, sum(w * tp) AS tp, sum(w * pos) AS pos, sum(w * fp) AS fp, sum(w * neg) AS neg FROM w GROUP BY sample),
  r AS (SELECT list_sort(list(tp / pos)) AS recall, list_sort(list(fp / neg)) AS fpr, count(*) AS n FROM s)
  SELECT {', '.join(f'round({c}[CAST(round_even((n - 1) * {p}, 0) AS INTEGER) + 1], 9) AS {c}_{end}' for c in ('recall', 'fpr') for end, p in (('low', 0.025), ('high', 0.975)))} FROM r""")
def poisson_bootstrap(spark, d):
    """Intervals over users as blocks, whose draws follow from hashes."""
    return rounded(evaluation.poisson_bootstrap(decisions(spark, d), "item", 200))


JSON_KEY = "CASE seq % 6 WHEN 0 THEN '1' WHEN 1 THEN '\"1\"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN '1.5' ELSE '\"' || run || '\"' END"


@query(f"""WITH {DECISIONS}, {MEANING}, c AS (SELECT {JSON_KEY} AS text, {COUNTS} FROM m GROUP BY ALL), k AS (SELECT *, CASE WHEN text[1] = '"' THEN 'str' WHEN text = 'true' THEN 'bool' WHEN text = 'null' THEN 'NoneType' WHEN text = '1' THEN 'int' ELSE 'float' END AS kind FROM c)
  SELECT CAST(row_number() OVER (ORDER BY kind, text) - 1 AS INTEGER) AS place, kind, text, tp, fn, fp, tn FROM k""")
def summary_by_any_key(spark, d):
    """Groups by a JSON value whose type changes from row to row, in a stable order."""
    k = C("seq") % 6
    key = F.when(k == 0, "1").when(k == 1, '"1"').when(k == 2, "true").when(k == 3, "null").when(k == 4, "1.5").otherwise(F.concat(F.lit('"'), "run", F.lit('"')))
    return evaluation.confusion_by_any(decisions(spark, d), key).select("place", "kind", "text", "tp", "fn", "fp", "tn")


@query(f"""WITH {DECISIONS}, g AS (SELECT item, CASE prediction WHEN 'YES' THEN true WHEN 'NO' THEN false END AS v FROM dec)
  SELECT item, CASE WHEN bool_or(v) THEN true WHEN count(v) = count(*) THEN false END AS verdict, count(*) AS parts FROM g GROUP BY item""")
def verdict_fold(spark, d):
    v = decisions(spark, d).withColumn("v", text.prediction_literal(C("prediction")))
    return v.groupBy("item").agg(evaluation.fold_verdicts(C("v")).alias("verdict"), F.count("*").alias("parts"))


VOTES = f"{DECISIONS}, v AS (SELECT item, seq, prediction, CAST(floor(value) AS BIGINT) AS anchors FROM dec WHERE prediction <> 'ERROR'), c AS (SELECT item, count(*) FILTER (prediction = 'YES') AS y, count(*) FILTER (prediction = 'NO') AS n, count(*) FILTER (prediction = 'ABSTAIN') AS a, count(*) AS k, arg_max(seq, (anchors, -seq)) FILTER (prediction = 'YES') AS best FROM v GROUP BY item)"


@query(f"WITH {VOTES} SELECT item, CASE WHEN y >= 20 THEN 'YES' WHEN n >= 20 THEN 'NO' ELSE 'ABSTAIN' END AS verdict, CASE WHEN y >= 20 THEN best END AS winner, round(greatest(y, n, a) / k, 2) AS agreement, NOT (y >= 20 OR n >= 20 OR a >= 20) AS no_consensus FROM c")
def consensus(spark, d):
    v = decisions(spark, d).where("prediction <> 'ERROR'").select("item", C("seq").alias("round"), C("prediction").alias("verdict"), F.floor("value").alias("anchors"))
    return evaluation.consensus(v, "item", rounds=39)


@query(f"WITH {DECISIONS}, s AS (SELECT DISTINCT run, item FROM dec), l AS (SELECT item FROM s WHERE run = 'click'), r AS (SELECT item FROM s WHERE run = 'signup') SELECT (SELECT count(*) FROM (FROM l INTERSECT FROM r)) AS in_both, (SELECT count(*) FROM (FROM l EXCEPT FROM r)) AS only_left, (SELECT count(*) FROM (FROM r EXCEPT FROM l)) AS only_right")
def candidate_pair(spark, d):
    return evaluation.pair_sizes(decisions(spark, d), "run", "item", "click", "signup")


@query(f"WITH {DECISIONS}, w AS (SELECT DISTINCT run, item FROM dec), k AS (SELECT item, count(*) AS k FROM w GROUP BY item) SELECT run, count(*) AS items, count(*) FILTER (k = 1) AS exclusive, count(*) FILTER (k = (SELECT count(DISTINCT run) FROM w)) AS in_all, (SELECT count(*) FROM k) AS in_any FROM w JOIN k USING (item) GROUP BY run")
def candidate_sets(spark, d):
    return evaluation.set_sizes(decisions(spark, d), "run", "item")


TRUTH = "tru AS (SELECT DISTINCT 'r' || s_nationkey AS repository, 's' || s_suppkey AS sha, CASE s_suppkey % 3 WHEN 0 THEN 'fix' WHEN 1 THEN 'context' ELSE 'introduce' END AS role FROM supplier WHERE s_nationkey < 20), emi AS (SELECT DISTINCT 'r' || s_nationkey AS repository, 's' || (s_suppkey + CASE WHEN s_suppkey % 7 = 0 THEN 100000 ELSE 0 END) AS sha FROM supplier WHERE s_suppkey % 2 = 0)"


def truth_and_emitted(spark, d):
    s = load(spark, d, "supplier")
    r = F.concat(F.lit("r"), "s_nationkey").alias("repository")
    truth = s.where("s_nationkey < 20").select(r, F.concat(F.lit("s"), "s_suppkey").alias("sha"), choose(("fix", "context", "introduce"), C("s_suppkey")).alias("role")).distinct()
    emitted = s.where("s_suppkey % 2 = 0").select(r, F.concat(F.lit("s"), C("s_suppkey") + F.when(C("s_suppkey") % 7 == 0, 100000).otherwise(0)).alias("sha"))
    return truth, emitted


@query(f"""WITH {TRUTH}, j AS (SELECT coalesce(t.repository, e.repository) AS repository, role, e.sha IS NOT NULL AS o FROM tru t FULL JOIN emi e ON t.repository = e.repository AND t.sha = e.sha),
  k AS (SELECT * FROM j WHERE repository IN (SELECT repository FROM tru)),
  a AS (SELECT CASE WHEN grouping(repository) = 1 THEN 'total' ELSE repository END AS repository, count(*) FILTER (o AND role = 'fix') AS tp, count(*) FILTER (o AND role <> 'fix') AS fp, count(*) FILTER (o AND role IS NULL) AS unscored, count(*) FILTER (NOT o AND role = 'fix') AS missed FROM k GROUP BY ROLLUP (repository))
  SELECT *, tp / nullif(tp + missed, 0) AS recall, tp / nullif(tp + fp, 0) AS precision FROM a""")
def truth_scoring(spark, d):
    truth, emitted = truth_and_emitted(spark, d)
    return evaluation.score_truth(emitted, truth)


@query(f"WITH {TRUTH} SELECT t.repository, t.sha FROM tru t ANTI JOIN emi e ON t.repository = e.repository AND t.sha = e.sha WHERE role = 'fix'")
def missed_fixes(spark, d):
    truth, emitted = truth_and_emitted(spark, d)
    return truth.where("role = 'fix'").join(emitted, ["repository", "sha"], "left_anti").select("repository", "sha")


@query(f"""WITH {DECISIONS}, p AS (SELECT item, arg_max(prediction, seq) AS v FROM dec WHERE run <> 'view' GROUP BY item), c AS (SELECT item, arg_max(prediction, seq) AS v FROM dec WHERE run IN ('view', 'click') AND value > 60 GROUP BY item)
  SELECT item, p.v AS proposed, coalesce(c.v, 'ABSTAIN') AS confirmed, coalesce(c.v, 'ABSTAIN') = 'YES' AS strict, coalesce(c.v, 'ABSTAIN') <> 'NO' AS veto FROM p LEFT JOIN c USING (item) WHERE p.v = 'YES'""")
def review_cascade(spark, d):
    """A proposer's YES under a strict and a vetoing confirmer."""
    x = decisions(spark, d)
    last = lambda when: logs.latest(x.where(when), ["item"]).select("item", C("prediction").alias("verdict"))
    return reports.cascade(last("run <> 'view'"), last("run IN ('view', 'click') AND value > 60"), "item")


@query(f"WITH {DECISIONS}, a AS (SELECT item, arg_max(prediction, seq) AS v FROM dec WHERE seq % 2 = 0 GROUP BY item), b AS (SELECT item, arg_max(prediction, seq) AS v FROM dec WHERE seq % 2 = 1 GROUP BY item) SELECT item, a.v AS before, b.v AS after FROM a JOIN b USING (item) WHERE a.v <> b.v")
def verdict_changes(spark, d):
    x = decisions(spark, d)
    side = lambda k: logs.latest(x.where(f"seq % 2 = {k}"), ["item"]).select("item", C("prediction").alias("verdict"))
    return reports.verdict_changes(side(0), side(1), "item")


@query(f"WITH {DECISIONS} SELECT run, count(*) AS n, count(DISTINCT item) AS items, count(*) FILTER (prediction = 'YES') AS candidates, round(sum(value), 4) AS cost FROM dec GROUP BY run")
def run_status(spark, d):
    return decisions(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"), F.count_if(C("prediction") == "YES").alias("candidates"), F.round(F.sum("value"), 4).alias("cost"))


@query(f"WITH {DECISIONS}, s AS (SELECT repository, run, sum(value) AS cost, avg(CASE WHEN prediction = 'YES' THEN 1.0 ELSE 0.0 END) AS r FROM dec GROUP BY ALL) SELECT repository, coalesce(arg_min(run, (cost, run)) FILTER (r >= 0.95), arg_max(run, (r, -cost))) AS profile FROM s GROUP BY repository")
def cheapest_profile(spark, d):
    """The cheapest run that qualifies, else the best one, cheaper ones first."""
    s = decisions(spark, d).groupBy("repository", "run").agg(F.sum("value").alias("cost"), F.avg((C("prediction") == "YES").cast("double")).alias("r"))
    good = F.min_by("run", F.when(C("r") >= 0.95, F.struct("cost", "run")))
    return s.groupBy("repository").agg(F.coalesce(good, F.max_by("run", F.struct("r", -C("cost")))).alias("profile"))


# --- logs and state


@query(f"WITH {DECISIONS} SELECT repository, item, run, max(seq) AS seq, arg_max(prediction, seq) AS prediction FROM dec GROUP BY ALL")
def latest_label(spark, d):
    return logs.latest(decisions(spark, d), ["repository", "item", "run"]).select("repository", "item", "run", "seq", "prediction")


@query(f"WITH {DECISIONS} SELECT item, min(seq) AS seq, arg_min(prediction, seq) AS prediction FROM dec GROUP BY item")
def first_row(spark, d):
    return logs.earliest(decisions(spark, d), ["item"]).select("item", "seq", "prediction")


@query(f"WITH {DECISIONS} SELECT item, seq, row_number() OVER (PARTITION BY item ORDER BY seq) - 1 AS ordinal, count(*) OVER (PARTITION BY item) AS n_in_key FROM dec")
def ordinals(spark, d):
    return logs.ordinals(decisions(spark, d), "item", "seq").select("item", "seq", "ordinal", "n_in_key")


@query(f"""WITH {DECISIONS}, l AS (SELECT repository, item, run, arg_max(prediction, seq) AS prediction, arg_max(truth, seq) AS truth FROM dec GROUP BY ALL),
  g AS (SELECT repository, item, count(*) AS annotators, count(DISTINCT prediction) > 1 AS a, count(DISTINCT truth) > 1 AS b FROM l GROUP BY ALL HAVING count(*) >= 2)
  SELECT repository, item, annotators, array_to_string(list_filter([CASE WHEN a THEN 'prediction' END, CASE WHEN b THEN 'truth' END], lambda x: x IS NOT NULL), ',') AS fields, a OR b AS disagrees FROM g""")
def label_disagreements(spark, d):
    return logs.disagreements(decisions(spark, d), ["repository", "item"], "run", ["prediction", "truth"])


@query(f"WITH {DECISIONS}, g AS (SELECT item, max(seq) FILTER (run = 'signup') AS a, max(seq) FILTER (run <> 'signup') AS n FROM dec GROUP BY item) SELECT item, coalesce(a > n, a IS NOT NULL) AS settled FROM g")
def adjudicated(spark, d):
    x = decisions(spark, d).withColumn("kind", F.when(C("run") == "signup", "adjudication").otherwise("annotation"))
    return logs.adjudicated(x, ["item"])


@query(f"""WITH {DECISIONS}, i AS (SELECT c_custkey AS item FROM customer), p AS (SELECT item, list_sort(list(DISTINCT run)) AS present FROM dec GROUP BY item),
  j AS (SELECT item, coalesce(present, CAST([] AS VARCHAR[])) AS present FROM i LEFT JOIN p USING (item)), k AS (SELECT *, list_filter(['click', 'view', 'error'], lambda x: NOT list_contains(present, x)) AS missing FROM j)
  SELECT item, array_to_string(present, ',') AS present, array_to_string(missing, ',') AS missing FROM k WHERE len(missing) > 0""")
def label_queue(spark, d):
    items = load(spark, d, "customer").select(C("c_custkey").alias("item"))
    return logs.queue(items, decisions(spark, d), ["item"], "run", ["click", "view", "error"])


STATE = f"""{DECISIONS}, o AS (SELECT item, arg_max(prediction, seq) AS status, arg_max(CASE WHEN value > 40 THEN truth END, seq) AS patch, arg_max(run, seq) AS stage FROM dec WHERE seq % 3 = 0 GROUP BY item),
  n AS (SELECT item, arg_max(prediction, seq) AS status, arg_max(truth, seq) AS patch, CASE WHEN item % 2 = 0 THEN arg_max(run, seq) END AS stage FROM dec WHERE seq % 3 > 0 GROUP BY item)"""


@query(f"WITH {STATE.replace('arg_max(CASE WHEN value > 40 THEN truth END, seq)', 'CASE WHEN arg_max(value, seq) > 40 THEN arg_max(truth, seq) END')} SELECT item, CASE WHEN n.item IS NOT NULL THEN n.status ELSE o.status END AS status, coalesce(o.patch, n.patch) AS patch, coalesce(n.stage, o.stage) AS stage FROM o FULL JOIN n USING (item)")
def state_merge(spark, d):
    """Status replaced, patch first known, stage kept where the new one is null."""
    x = decisions(spark, d)
    o = logs.latest(x.where("seq % 3 = 0"), ["item"]).select("item", C("prediction").alias("status"), F.when(C("value") > 40, C("truth")).alias("patch"), C("run").alias("stage"))
    n = logs.latest(x.where("seq % 3 > 0"), ["item"]).select("item", C("prediction").alias("status"), C("truth").alias("patch"), F.when(C("item") % 2 == 0, C("run")).alias("stage"))
    return logs.merge(o, n, ["item"], replace=["status"], keep_first=["patch"], keep_if_null=["stage"])


@query(f"""WITH {DECISIONS}, o AS (SELECT item, min(seq) AS seq FROM dec WHERE seq % 5 = 0 GROUP BY item), n AS (SELECT CASE WHEN item % 6 > 0 THEN item END AS item, seq FROM dec WHERE seq % 5 > 0)
  FROM o UNION ALL SELECT item, min(seq) FROM n WHERE item IS NOT NULL AND item NOT IN (SELECT item FROM o) GROUP BY item UNION ALL SELECT item, seq FROM n WHERE item IS NULL""")
def insert_new(spark, d):
    """Errors: the first of each key; null keys are all kept."""
    x = decisions(spark, d)
    o = logs.earliest(x.where("seq % 5 = 0"), ["item"]).select("item", "seq")
    n = x.where("seq % 5 > 0").select(F.when(C("item") % 6 > 0, C("item")).alias("item"), "seq")
    return logs.insert_new(o, n, ["item"], "seq")


@query("""WITH j AS (SELECT o_orderkey AS run, c.c_custkey AS item, n.n_name AS repository, l.l_linenumber AS position, l.l_shipdate AS created FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
  SELECT repository, item, created, min(run) AS run FROM j GROUP BY repository, item, created""")
def triage_export(spark, d):
    """Runs joined to their results; of equal (repository, item, time), null like any time, the first run stays."""
    o, c, n = load(spark, d, "orders"), load(spark, d, "customer"), load(spark, d, "nation")
    x = load(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_shipdate")
    j = o.join(c, C("o_custkey") == C("c_custkey")).join(n, C("c_nationkey") == C("n_nationkey")).join(x, C("o_orderkey") == C("l_orderkey"), "left")
    rows = j.select(C("n_name").alias("repository"), C("c_custkey").alias("item"), C("l_shipdate").alias("created"), C("o_orderkey").alias("run"), C("l_linenumber").alias("position"))
    return logs.pick(rows, ["repository", "item", "created"], "run", "position").drop("position")


@query(f"WITH {DECISIONS}, s AS (SELECT DISTINCT item FROM dec) SELECT item FROM s ORDER BY sha256('queue|' || item) LIMIT 40")
def audit_sample(spark, d):
    return logs.sample_by_hash(decisions(spark, d).select("item").distinct(), C("item").cast("string"), 40, "queue")


@query(f"""WITH {DECISIONS}, s AS (SELECT item, CASE item % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'hard_negative' ELSE 'unknown' END AS stratum, sha256('pilot' || chr(0) || item) AS h FROM (SELECT DISTINCT item FROM dec)),
  k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) > CASE stratum WHEN 'positive' THEN 20 WHEN 'hard_negative' THEN 12 ELSE 0 END AS late FROM s) SELECT item, stratum FROM k ORDER BY late, h LIMIT 40""")
def pilot_queue(spark, d):
    x = decisions(spark, d).select("item").distinct().withColumn("stratum", choose(("positive", "hard_negative", "unknown"), C("item")))
    return logs.stratified_queue(x, "stratum", {"positive": 20, "hard_negative": 12}, C("item").cast("string"), "pilot", 40)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def without_commits(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "orders").where("o_orderpriority = '5-LOW'"), C("c_custkey") == C("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT c_custkey, c_name FROM customer SEMI JOIN (SELECT 'Customer#00000' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 3, '0') AS prefix FROM supplier) p ON starts_with(c_name, prefix)")
def relabel_audit(spark, d):
    """Rows whose id begins with one of a list of prefixes; prefixes of one length join by equality."""
    p = load(spark, d, "supplier").select(F.concat(F.lit("Customer#00000"), F.lpad((C("s_suppkey") % 100).cast("string"), 3, "0")).alias("prefix")).distinct()
    return load(spark, d, "customer").join(p, F.substring("c_name", 1, 17) == C("prefix"), "left_semi").select("c_custkey", "c_name").distinct()


@query("""WITH r AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS sha, CASE WHEN l_partkey % 9 > 0 THEN l_partkey END AS patch_id, CAST(l_quantity AS BIGINT) AS anchors, l_returnflag = 'R' AS moved FROM lineitem)
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY anchors DESC, moved, sha) AS rn FROM r) WHERE rn = 1 OR patch_id IS NULL""")
def patch_dedup(spark, d):
    x = load(spark, d, "lineitem")
    rows = x.select((C("l_orderkey") * 8 + C("l_linenumber")).alias("sha"), F.when(C("l_partkey") % 9 > 0, C("l_partkey")).alias("patch_id"), C("l_quantity").cast("long").alias("anchors"), (C("l_returnflag") == "R").alias("moved")).distinct()
    return logs.best_per_patch(rows)


@query("SELECT event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS tokens FROM events")
def token_window(spark, d):
    """Tokens that a client has used over the last 60 seconds."""
    e = load(spark, d, "events")
    return reports.spent_over(e, "user_id", C("ts").cast("timestamp"), F.floor("value")).select("event_id", C("spent").alias("tokens"))


@query("SELECT doc_id, 'sha256:' || sha256('{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || ',\"source\":\"' || source || '\"}') AS record_id FROM documents")
def record_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", text.content_hash(text.canonical_json("source", "lang", "n_chars")).alias("record_id"))


# --- text


@query(f"WITH {MESSAGES}, m AS (SELECT *, {terms_sql('message')} AS terms FROM msg) SELECT seq, array_to_string(terms, ',') AS terms, len(terms) AS n FROM m")
def matched_terms(spark, d):
    m = messages(spark, d).withColumn("terms", text.matched_terms(C("message")))
    return m.select("seq", F.array_join("terms", ",").alias("terms"), F.size("terms").cast("long").alias("n"))


@query(rf"""WITH {MESSAGES}, m AS (SELECT *, len({terms_sql('message')}) AS n FROM msg)
  SELECT seq, CASE WHEN message = '' THEN 'empty' WHEN is_merge AND regexp_matches(message, '^(Merge branch|Merge commit from fork|Merge remote-tracking branch|merge tag) ') THEN 'merge_noise' WHEN {ADVISORY_SQL} OR n >= 2 THEN 'announced' ELSE 'quiet' END AS class FROM m""")
def message_class(spark, d):
    m = messages(spark, d).withColumn("terms", text.matched_terms(C("message")))
    return m.select("seq", text.message_class(C("message"), C("is_merge"), C("terms")).alias("class"))


@query(rf"""WITH {MESSAGES}, m AS (SELECT *, len({terms_sql('message')}) AS n, string_split(message, chr(10))[1] AS subj FROM msg)
  SELECT seq, CASE WHEN message = '' THEN 'none' WHEN {ADVISORY_SQL} THEN 'identifier' WHEN n >= 2 THEN 'multi_keyword'
  WHEN regexp_matches(subj, '(?i)^\s*(?:security|sec|vuln)\s*(?:\([^)]*\))?\s*!?\s*:') OR {' OR '.join(has_sql('subj', t) for t in text.SUBJECT_TERMS)} THEN 'subject_signal' WHEN n >= 1 THEN 'single_keyword' ELSE 'none' END AS strength FROM m""")
def announcement_strength(spark, d):
    m = messages(spark, d).withColumn("terms", text.matched_terms(C("message")))
    return m.select("seq", text.announcement_strength(C("message"), C("terms")).alias("strength"))


def redact_sql(column: str) -> str:
    for p in (r"(?i)\b(?:CVE-\d{4}-\d{4,}|GHSA-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4})\b", r"(?i)\bGO-\d{4}-\d{3,}\b", r"(?i)\bOSV-\d{4}-\d{3,}\b", r"(?i)\bCWE[-\s]?\d{1,5}\b", r"https://nvd\.nist\.gov/x/\d+"):
        column = f"regexp_replace({column}, '{p}', '[redacted]', 'g')"
    for t in TERMS:
        column = rf"regexp_replace({column}, '(?i)(^|[^\p{{L}}\p{{N}}_-]){text.term_regex(t)}($|[^\p{{L}}\p{{N}}_-])', '\1[redacted]\2', 'g')"
    return column


@query(f"WITH {MESSAGES} SELECT seq, {redact_sql('message')} AS redacted FROM msg")
def redacted_message(spark, d):
    return messages(spark, d).select("seq", text.redact(C("message")).alias("redacted"))


@query(rf"""WITH {MESSAGES} SELECT seq, CASE seq % 9 WHEN 2 THEN 'CVE-2024-' || (10000 + seq) WHEN 5 THEN 'GO-2024-0001,CWE-79,https://nvd.nist.gov/x/' || seq ELSE '' END AS identifiers,
  CASE seq % 3 WHEN 0 THEN message WHEN 1 THEN {redact_sql('message')} ELSE 'Update implementation.' END AS shown FROM msg""")
def message_conditions(spark, d):
    """What redaction takes out, and messages under the three conditions in turn."""
    m = messages(spark, d)
    shown = F.when(C("seq") % 3 == 0, text.under_condition(C("message"), "M0")).when(C("seq") % 3 == 1, text.under_condition(C("message"), "M1")).otherwise(text.under_condition(C("message"), "M2"))
    return m.select("seq", F.array_join(text.redaction(C("message"))["removed_identifiers"], ",").alias("identifiers"), shown.alias("shown"))


@query(f"WITH {PATHS} SELECT seq, path, kind FROM kin")
def change_kind(spark, d):
    return paths(spark, d).select("seq", "path", text.change_kind(C("path"), C("patch")).alias("kind"))


@query(f"WITH {PATHS} SELECT seq, path, reason FROM gen")
def generated_reason(spark, d):
    return paths(spark, d).select("seq", "path", text.generated_reason(C("path"), C("patch")).alias("reason"))


@query(f"""WITH {PATHS}, g AS (SELECT p_brand, seq % 40 AS part, list_distinct(list(kind)) AS k, sum(bytes) AS b FROM kin GROUP BY ALL)
  SELECT CASE WHEN b > 400 THEN 'oversize' WHEN list_has_any(k, ['source', 'merge_resolution', 'other']) THEN 'admitted' WHEN len(k) = 1 THEN k[1] || '_only' ELSE 'no_first_party_source' END AS reason, count(*) AS n FROM g GROUP BY reason""")
def prefilter(spark, d):
    k = paths(spark, d).withColumn("kind", text.change_kind(C("path"), C("patch")))
    g = k.groupBy("p_brand", (C("seq") % 40).alias("part")).agg(F.collect_set("kind").alias("kinds"), F.sum("bytes").alias("b"))
    return g.groupBy(text.admission(C("kinds"), C("b"), 400).alias("reason")).agg(F.count("*").alias("n"))


LANGUAGE = "CASE regexp_extract(path, '\\.[^./]*$') WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'javascript' END"


@query(f"""WITH {PATHS}, w AS (SELECT p_brand, {LANGUAGE} AS lang, sum(CASE WHEN contains(path, '_test.') OR contains(path, '/test') OR starts_with(path, 'test') THEN 0.25 ELSE 1.0 END) AS w, min(seq) AS f FROM pth WHERE {LANGUAGE} IS NOT NULL GROUP BY ALL)
  SELECT p_brand, arg_max(lang, (w, -f)) AS lang FROM w GROUP BY p_brand""")
def language_vote(spark, d):
    return runs.language_votes(paths(spark, d), ["p_brand"], "path", "seq").withColumnRenamed("language", "lang")


@query(r"WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/./' WHEN 2 THEN './' ELSE '' END || replace(p_name, ' ', '\') AS v FROM part) SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(replace(v, '\', '/'), '^a/', ''), '^b/', ''), '^\./', '')) AS component FROM x")
def component_name(spark, d):
    k = C("p_partkey")
    v = F.concat(F.when(k % 4 == 0, "a/").when(k % 4 == 1, "b/./").when(k % 4 == 2, "./").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("\\")))
    return load(spark, d, "part").select(k, text.normalise_component(v).alias("component"))


ANSWERS = (" YES\n", "NO", "yes", "YES because", "", "NO ", "maybe")


@query(f"WITH a AS (SELECT o_orderkey, {choose_sql(ANSWERS, 'o_orderkey')} AS v FROM orders) SELECT o_orderkey, CASE regexp_replace(v, '^\\s+|\\s+$', '', 'g') WHEN 'YES' THEN true WHEN 'NO' THEN false END AS verdict FROM a")
def strict_answer(spark, d):
    return load(spark, d, "orders").select("o_orderkey", text.strict_answer(choose(ANSWERS, C("o_orderkey"))).alias("verdict"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed, NOT regexp_matches(text, '^[a-z0-9_:.-]{1,80}$') AND (length(text) > 80 OR contains(text, chr(10)) OR regexp_matches(text, '[^\x00-\x7F]')) AS suspect FROM documents")
def quotes(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(text.squeeze(C("text")).cast("binary"), 256).alias("squeezed"), text.suspect_reason(C("text")).alias("suspect"))


@query(r"""WITH x AS (SELECT page_id, substr(md5(url), 1, 12) AS h FROM pages), y AS (SELECT page_id, unnest([('o/n', h, 'https://github.com/O/n/commit/' || upper(h) || '?w=1'), ('o/n', h || 'ab', 'http://www.github.com/o/N/pull/' || page_id || '/commits/' || h || 'ab#x')]) AS r FROM x)
  SELECT page_id, r[1] AS repo, r[2] AS sha, r[3] AS url FROM y""")
def commit_references(spark, d):
    """Commits that an advisory's details and references link to; other hosts and repeated links don't count."""
    h = F.substring(F.md5(C("url").cast("binary")), 1, 12)
    details = F.concat(F.lit("See https://git.example.com/o/n/commit/"), h, F.lit(" and <https://github.com/O/n/commit/"), F.upper(h), F.lit("?w=1> and "), C("html"))
    references = F.array(F.concat(F.lit("http://www.github.com/o/N/pull/"), C("page_id"), F.lit("/commits/"), h, F.lit("ab#x")), F.concat(F.lit("https://github.com/o/n/commit/"), h))
    r = load(spark, d, "pages").select("page_id", F.explode(text.advisory_refs(details, references)).alias("r"))
    return r.select("page_id", "r.repo", "r.sha", "r.url")


DIFF_SQL = r"'note' || chr(10) || 'diff --git a/x b/x' || chr(13) || chr(10) || '+fix ' || CASE WHEN doc_id % 3 = 0 THEN 'CVE-2024-12345' ELSE 'it' END || chr(10) || text || chr(10) || 'diff --git a/y b/y' || chr(10) || '-CVE-2023-99999'"


@query(rf"WITH x AS (SELECT doc_id, replace(replace({DIFF_SQL}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(t, '(?m)^diff --(?:git|cc|combined) ')) AS BIGINT) AS sections, regexp_matches(t, '(?im)^\+(?:[^+\n]|\+[^+\n])[^\n]*\b(?:CVE-\d{{4}}-\d{{4,}}|GHSA-[a-z0-9]{{4}}-[a-z0-9]{{4}}-[a-z0-9]{{4}})\b') AS leaks FROM x")
def diff_sections(spark, d):
    k = C("doc_id")
    t = F.concat(F.lit("note\ndiff --git a/x b/x\r\n+fix "), F.when(k % 3 == 0, "CVE-2024-12345").otherwise("it"), F.lit("\n"), C("text"), F.lit("\ndiff --git a/y b/y\n-CVE-2023-99999"))
    return load(spark, d, "documents").select("doc_id", F.size(text.file_sections(t)).cast("long").alias("sections"), text.leaks_disclosure(t).alias("leaks"))


# --- findings


@query(f"WITH {FINDINGS} SELECT class, component, round(sum(weight), 4) AS score, count(*) AS n, CAST(max(rank) AS INTEGER) AS peak, min(seq) AS first_seen FROM fin GROUP BY class, component ORDER BY score DESC, first_seen LIMIT 5")
def top_risks(spark, d):
    return context.top_risks(findings(spark, d))


@query(f"WITH {FINDINGS} SELECT class, count(DISTINCT entry) AS entries, count(*) AS evidence, min(seq) AS first_seen FROM fin WHERE invariant IS NOT NULL GROUP BY class HAVING count(*) >= 2 OR count(DISTINCT entry) >= 2 ORDER BY entries DESC, evidence DESC, first_seen LIMIT 6")
def shared_surfaces(spark, d):
    return context.shared_surfaces(findings(spark, d))


@query(f"WITH {FINDINGS}, a AS (SELECT count(*) FILTER (coalesce(still_applies, true)) AS measurable, count(*) FILTER (coalesce(still_applies, true) AND guarded) AS guarded FROM fin) SELECT measurable, guarded, round(100.0 * guarded / measurable, 1) AS coverage FROM a")
def remediation(spark, d):
    return context.remediation(findings(spark, d))


@query(f"WITH {FINDINGS} SELECT component, count(*) AS n, bool_or(still_applies) AS still_applies FROM fin GROUP BY component")
def component_counts(spark, d):
    return findings(spark, d).groupBy("component").agg(F.count("*").alias("n"), F.bool_or("still_applies").alias("still_applies"))


# --- groups, splits and graphs

LINKS = "rec AS (SELECT s_suppkey AS id, s_nationkey AS k1, CAST(floor(s_acctbal / 2) AS BIGINT) AS k2 FROM supplier)"
GROUPS = f"{LINKS}, e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM rec a JOIN rec b ON a.k1 = b.k1 OR a.k2 = b.k2), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), grp AS (SELECT a AS id, min(b) AS g FROM r GROUP BY a)"


def groups(spark, d) -> DataFrame:
    s = load(spark, d, "supplier")
    return graph.linked_groups(s.select(C("s_suppkey").alias("id"), C("s_nationkey").alias("k1"), F.floor(C("s_acctbal") / 2).alias("k2")), "id", ["k1", "k2"])


@query(f'WITH RECURSIVE {GROUPS} SELECT id, g AS "group" FROM grp')
def linked_groups(spark, d):
    return groups(spark, d)


@query(f"""WITH RECURSIVE {GROUPS} SELECT id, g AS "group", CASE WHEN CAST('0x' || substr(sha256('v1' || chr(0) || g), 1, 13) AS BIGINT) / pow(2, 52) < 0.2 THEN 'holdout' ELSE 'development' END AS split FROM grp""")
def grouped_holdout(spark, d):
    return graph.grouped_holdout(groups(spark, d), 0.2, "v1")


@query("""WITH g AS (SELECT o_custkey, max(o_orderdate) AS latest, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY latest DESC, o_custkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM g)
  SELECT o_custkey, CASE WHEN taken < ceil((SELECT count(*) FROM orders) * 0.2) THEN 'holdout' ELSE 'development' END AS split FROM r""")
def temporal_holdout(spark, d):
    o = load(spark, d, "orders")
    return graph.temporal_holdout(o, "o_custkey", "o_orderdate", -(-o.count() // 5))


def edges(spark, d) -> DataFrame:
    """A history in tens: 3 and 4 branch off 2, 6 merges them into 5, and all else follows what is before it."""
    k = C("o_orderkey")
    parents = F.when(k % 10 == 5, F.array(k - 3)).when(k % 10 == 6, F.array(k - 1, k - 2)).otherwise(F.array(k - 1))
    return load(spark, d, "orders").select(k.alias("child"), F.explode(parents).alias("parent")).where("parent >= 0")


@query("SELECT o_orderkey AS merge, unnest([o_orderkey - 3, o_orderkey - 2]) AS node FROM orders WHERE o_orderkey % 10 = 6")
def brought_in(spark, d):
    """What each merge brings in: by the way the history is made, the two commits of its branch."""
    o = load(spark, d, "orders")
    m = o.where("o_orderkey % 10 = 6").select(C("o_orderkey").alias("merge"), (C("o_orderkey") - 1).alias("first_parent"))
    return reach.brought_in(edges(spark, d), m, o.select(C("o_orderkey").alias("node"), C("o_orderkey").alias("place"))).select("merge", "node")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def windowed_status(spark, d):
    """Hourly status, as the stream computes it."""
    from prospector.streaming.stages import windowed_status as status

    return status(load(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))).select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT path, line, text FROM l WHERE contains(text, 'idiot') ORDER BY path, line LIMIT 100")
def text_search(spark, d):
    """A fixed string in files, the first hundred hits."""
    from prospector.sources.records import search

    return search(load(spark, d, "documents").select(C("doc_id").alias("path"), C("text").alias("content")), "idiot").withColumn("line", C("line").cast("long"))


def diff_chunks(spark, d):
    """No SQL: greedy packing depends on what came before."""
    t = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")), F.lit("\ndiff --git a/y b/y\n@@ -1 +1 @@\n-a\n+b\n"))
    return load(spark, d, "documents").select("doc_id", F.explode(diffs.chunk(t, 4096, "# change\n")["chunks"]).alias("c")).select("doc_id", "c.number", "c.bytes", "c.sha256")


QUERIES["diff_chunks"] = diff_chunks

TYPES = (".py", ".go", ".md", ".sh")


@query(f"""SELECT doc_id, 3 AS hunks, len(string_split(text, chr(10))) AS added, doc_id % 4 IN (1, 3) AS same_indented, doc_id % 4 <> 2 AS comment_only, doc_id % 4 IN (1, 3) AS change FROM documents""")
def diff_hunks(spark, d):
    """Hunks of a change, the first one's added lines, and which hunks change white space or comments only, by the file's type: an
    indentation counts in Python and in unknown types, a # begins a comment in Python and shell."""
    name = F.concat(F.lit("x"), choose(TYPES, C("doc_id")))
    mark = F.when(C("doc_id") % 4 == 1, "// ").otherwise("# ")
    t = F.concat(
        F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1,2 +1,3 @@\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")),
        F.lit("\n@@ -9 +9 @@ def f\n-  a  b\n+a b\n@@ -20 +20 @@\n-"), mark, F.lit("one\n+"), mark, F.lit("two\n"),
    )
    h = load(spark, d, "documents").select("doc_id", diffs.hunks(t).alias("h"))
    hunk = lambda k: (C("h")[k]["lines"], C("h")[k]["path"])
    added = F.size(F.filter(C("h")[0]["lines"], lambda x: x.startswith("+"))).cast("long")
    last = diffs.cosmetic_change(F.slice("h", 2, 2))
    return h.select("doc_id", F.size("h").alias("hunks"), added.alias("added"), diffs.cosmetic(*hunk(1)).alias("same_indented"), diffs.cosmetic(*hunk(2)).alias("comment_only"), last.alias("change"))


@query("WITH f AS (SELECT o_custkey, o_orderdate AS fixed, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 7 = 0 END AS root, l_shipdate AS introduced FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey), g AS (SELECT *, CAST(floor((epoch(fixed) - epoch(introduced)) / 86400) AS BIGINT) AS d FROM f), h AS (SELECT *, CASE WHEN root IS NULL THEN 'declined_no_commit' WHEN root THEN 'declined_genesis' WHEN d IS NULL THEN 'declined_no_date' WHEN d < 0 THEN 'declined_negative' ELSE 'blame' END AS method FROM g) SELECT method, count(*) AS n, sum(CASE WHEN method = 'blame' THEN d END) AS days FROM h GROUP BY method")
def introduction_spans(spark, d):
    from prospector.operators.attribution import introduction_span

    x = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("timestamp").alias("introduced"))
    k = C("o_orderkey")
    f = load(spark, d, "orders").join(x, k == C("l_orderkey"), "left").select(C("o_orderdate").cast("timestamp").alias("fixed"), "introduced", F.when(k % 11 > 0, k % 7 == 0).alias("root"))
    return f.select(*introduction_span("fixed", "introduced", "root")).groupBy("method").agg(F.count("*").alias("n"), F.sum("days").alias("days"))
