"""Queries of reports, service answers and record identities, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.functions import calls, stats
from prospector.operators import reports, splits
from prospector.plans.catalog import COUNTS, DECISIONS, MEANING, C, Z, choose, choose_sql, decisions, load, query, rounded


def profile_rows(spark, d) -> DataFrame:
    x = decisions(spark, d)
    kind = F.when(C("seq") % 3 == 0, "quiet").otherwise("announced")
    return x.select(C("run").alias("profile"), C("seq").alias("id"), "truth", "prediction", kind.alias("message_class"), F.floor("value").alias("input_tokens"), F.lit(3).alias("output_tokens"), (F.floor("value") + 3).alias("total_tokens"), F.when((C("run") != "view") | (C("seq") % 50 > 0), 0.25).alias("cost"), F.lit(2).alias("calls"), (C("seq") % 2).alias("retries"))


def interval(k: str, n: str, sign: str) -> str:
    bound = f"({k} / {n} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n}) {sign} {Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {Z} * {Z} / (4 * {n} * {n})) / (1 + {Z} * {Z} / {n})"
    return f"greatest(0.0, {bound})" if sign == "-" else f"least(1.0, {bound})"


PROFILES = f"""{DECISIONS}, {MEANING}, c AS (SELECT run AS profile, {COUNTS}, count(*) FILTER (t AND seq % 3 = 0) AS qpos, count(*) FILTER (t AND p = 'YES' AND seq % 3 = 0) AS qtp, sum(CAST(floor(value) AS BIGINT) + 3) AS total_tokens, CASE WHEN run <> 'view' OR count(*) FILTER (seq % 50 = 0) = 0 THEN 0.25 * count(*) END AS total_cost, sum(seq % 2) AS retries, 2 * count(*) AS calls FROM m GROUP BY run),
  s AS (SELECT *, tp + fn + fp + tn AS evaluated, tp / nullif(tp + fn + uncovered_positive, 0) AS recall, qtp / nullif(qpos, 0) AS quiet_recall, fp / nullif(fp + tn, 0) AS fprc, tp + fn + uncovered_positive AS pos, (tp + fn + fp + tn) / nullif(tp + fn + fp + tn + uncovered_positive + uncovered_negative, 0) AS coverage FROM c)"""


@query(f"""WITH {PROFILES} SELECT profile, tp, fn, fp, tn, evaluated, round(recall, 9) AS recall, round(quiet_recall, 9) AS quiet_recall, round(fprc, 9) AS fpr_covered, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(calls AS BIGINT) AS calls, CAST(retries AS BIGINT) AS retries, round(CAST(total_cost AS DOUBLE), 9) AS total_cost,
  round(CASE WHEN evaluated > 0 THEN total_tokens / evaluated ELSE 0 END, 9) AS mean_tokens, coalesce(recall >= 0.95, false) AND coalesce(quiet_recall >= 0.9, false) AND uncovered_positive + uncovered_negative = 0 AS qualifies FROM s""")
def profile_summary(spark, d):
    s = reports.profile_summary(profile_rows(spark, d), 0.02)
    return rounded(s.select("profile", "tp", "fn", "fp", "tn", "evaluated", "recall", "quiet_recall", "fpr_covered", "total_tokens", C("calls").cast("long").alias("calls"), C("retries").cast("long").alias("retries"), "total_cost", "mean_tokens", "qualifies"))


@query(f"""WITH {PROFILES}, o AS (SELECT *, unnest([0.002::DOUBLE, 0.015::DOUBLE, 0.05::DOUBLE]) AS prevalence FROM s WHERE recall IS NOT NULL AND fprc IS NOT NULL), r AS (SELECT *, prevalence * recall + (1 - prevalence) * fprc AS rate, {interval('tp', 'pos', '-')} AS rl, {interval('tp', 'pos', '+')} AS rh, {interval('fp', '(fp + tn)', '-')} AS fl, {interval('fp', '(fp + tn)', '+')} AS fh FROM o)
  SELECT profile, prevalence, round(CASE WHEN rate > 0 THEN prevalence * recall / rate END, 9) AS precision, round(CASE WHEN prevalence * rl + (1 - prevalence) * fh > 0 THEN prevalence * rl / (prevalence * rl + (1 - prevalence) * fh) END, 9) AS precision_low,
  round(CASE WHEN prevalence * rh + (1 - prevalence) * fl > 0 THEN prevalence * rh / (prevalence * rh + (1 - prevalence) * fl) END, 9) AS precision_high, round(1000 * rate, 9) AS alerts_per_1000, round(total_tokens / evaluated + rate * 20000, 6) AS token_cost, round(CAST(total_cost AS DOUBLE) / evaluated + rate * 0.02, 9) AS cost_usd FROM r""")
def operational_figures(spark, d):
    """Precision with its envelope, alerts and costs of each profile at three prevalences."""
    o = reports.profile_summary(profile_rows(spark, d), 0.02).select("profile", F.explode("operational").alias("o")).select("profile", "o.*")
    return rounded(o.select("profile", "prevalence", "precision", "precision_low", "precision_high", "alerts_per_1000", F.round("token_cost", 6).alias("token_cost"), "cost_usd"))


@query(f"""WITH {PROFILES}, k AS (SELECT *, CASE WHEN recall IS NOT NULL AND fprc IS NOT NULL THEN total_tokens / evaluated + (0.015 * recall + 0.985 * fprc) * 20000 ELSE 'inf'::DOUBLE END AS cost, coalesce(recall >= 0.95, false) AND coalesce(quiet_recall >= 0.9, false) AND uncovered_positive + uncovered_negative = 0 AS q FROM s)
  SELECT (SELECT profile FROM k WHERE q ORDER BY cost, profile LIMIT 1) AS selected, (SELECT profile FROM k ORDER BY coalesce(nullif(recall, 0), -1) DESC, coalesce(nullif(quiet_recall, 0), -1) DESC, coverage DESC, cost LIMIT 1) AS fallback, (SELECT bool_or(q) FROM k) AS freeze_allowed""")
def selected_profile(spark, d):
    return reports.selected_profile(reports.profile_summary(profile_rows(spark, d)))


def backend_rows(spark, d) -> DataFrame:
    x = decisions(spark, d)
    return x.select(C("run").alias("backend"), F.md5(C("seq").cast("string").cast("binary")).alias("sha"), C("prediction").alias("verdict"), (C("truth") == "fix").alias("truth_is_fix"), F.when(C("seq") % 2 == 0, 0.5).alias("agreement"), (C("seq") % 7).cast("double").alias("elapsed_s"), (C("seq") % 3).alias("tool_calls"), C("seq").alias("prompt_tokens"), F.when(C("seq") % 2 == 0, C("seq")).alias("completion_tokens"))


@query(f"""WITH {DECISIONS}, b AS (SELECT run AS backend, seq, prediction = 'YES' AS y, truth = 'fix' AS f FROM dec) SELECT backend, count(*) AS n, count(*) FILTER (y AND f) AS true_positives, count(*) FILTER (y AND NOT f) AS false_positives, count(*) FILTER (NOT y AND f) AS missed, round(avg(CASE WHEN seq % 2 = 0 THEN 0.5 ELSE 1.0 END), 3) AS mean_agreement,
  round(avg(seq % 7), 1) AS mean_elapsed_s, round(avg(seq % 3), 1) AS mean_tool_calls, round((sum(seq) * 1.25 + sum(CASE WHEN seq % 2 = 0 THEN seq ELSE 0 END) * 10.0) / 1e6, 2) AS estimated_cost_usd, count(*) FILTER (y AND f) / nullif(count(*) FILTER (y), 0) AS precision, count(*) FILTER (y AND f) / nullif(count(*) FILTER (f), 0) AS recall,
  coalesce(sha256(string_agg(substr(md5(CAST(seq AS VARCHAR)), 1, 12), ',' ORDER BY substr(md5(CAST(seq AS VARCHAR)), 1, 12)) FILTER (y AND NOT f)), sha256('')) AS fp_shas FROM b GROUP BY backend""")
def backend_summary(spark, d):
    s = reports.backend_summary(backend_rows(spark, d))
    return s.select("backend", "n", "true_positives", "false_positives", "missed", "mean_agreement", "mean_elapsed_s", "mean_tool_calls", "estimated_cost_usd", "precision", "recall", F.sha2(F.array_join("fp_shas", ","), 256).alias("fp_shas"))


@query("SELECT p_partkey, CASE WHEN p_size > p_partkey % 9 THEN p_partkey % 9 / (p_size - p_partkey % 9) END AS rate, round(((p_size * 100 - p_size) * 1.25 + p_size * 0.125 + p_partkey * 10.0) / 1e6, 12) AS cost, round((p_size * 100 * 1.25 + p_partkey * 10.0) / 1e6, 12) AS triage_cost FROM part")
def corrected_rates(spark, d):
    """Rates over what was evaluated, and costs with and without a discount for cached tokens."""
    k, n = C("p_partkey"), C("p_size").cast("long")
    return load(spark, d, "part").select("p_partkey", stats.coverage_corrected_rate(k % 9, n, k % 9).alias("rate"), F.round(calls.estimated_cost(n * 100, n, k), 12).alias("cost"), F.round(calls.estimated_cost(n * 100, F.lit(0), k), 12).alias("triage_cost"))


SAID = ("YES", " fix ", "SECURITY-FIX", "skip", "CANDIDATE", "FALLBACK", "true", "maybe", "")


@query(f"""WITH x AS (SELECT o_orderkey AS k, {choose_sql(SAID, 'o_orderkey')} AS v FROM orders), n AS (SELECT k, CASE WHEN k % 4 = 3 THEN CASE WHEN k % 2 = 0 THEN 'NO' ELSE 'YES' END ELSE upper(trim(v)) END AS v FROM x),
  a AS (SELECT k, CASE WHEN v IN ('TRUE', 'FIX', 'SECURITY-FIX') THEN 'YES' WHEN v = 'SKIP' THEN 'NO' WHEN v IN ('YES', 'NO', 'CANDIDATE') THEN v ELSE 'ERROR' END AS triage FROM n) SELECT k AS o_orderkey, triage, CASE WHEN triage = 'CANDIDATE' THEN 'ERROR' ELSE triage END AS adjudication, triage <> 'NO' AS goes_on FROM a""")
def stage_verdicts(spark, d):
    k = C("o_orderkey")
    key = F.when(k % 4 == 0, "verdict").when(k % 4 == 1, "decision").otherwise("label")
    result = F.when(k % 4 == 3, F.concat(F.lit('{"flagged":'), (k % 2 == 1).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"'), key, F.lit('":"'), choose(SAID, k), F.lit('"}')))
    triage = calls.verdict_of(result)
    return load(spark, d, "orders").select("o_orderkey", triage.alias("triage"), calls.verdict_of(result, "adjudication").alias("adjudication"), calls.goes_on(triage).alias("goes_on"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 50 END AS prompt_tokens, 0 AS completion_tokens, o_orderkey % 7 AS cached_tokens, least(300.0, greatest(CASE WHEN o_orderkey % 5 = 0 THEN 40.0 ELSE 0.0 END, least(60.0, pow(2, o_orderkey % 9)) * (0.5 + 0.25))) AS wait FROM orders")
def service_usage(spark, d):
    """Counters of a usage payload, and the wait before another attempt."""
    k = C("o_orderkey")
    prompt = F.when(k % 3 == 0, F.lit('"many"')).otherwise((k % 50).cast("string"))
    usage = calls.usage_payload(F.concat(F.lit('{"prompt_tokens":'), prompt, F.lit(',"completion_tokens":-4,"prompt_tokens_details":{"cached_tokens":'), k % 7, F.lit("}}")))
    wait = calls.backoff(k % 9, F.when(k % 5 == 0, 40.0), F.lit(0.5))
    return load(spark, d, "orders").select("o_orderkey", *[usage[c].cast("int").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")], wait.alias("wait"))


@query("SELECT p_partkey, 'sha256:' || sha256(p_type || chr(0) || p_name || ' {diff}') AS prompt_hash, p_name || ' ' || p_brand AS prompt, 8 + strlen(p_name) + strlen(p_brand) + 5 AS tokens, '{\"a\":' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ',\"c\":{\"d\":\"x\"}}' ELSE ',\"c\":{}}' END AS pruned, CASE p_partkey % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'commit' WHEN 2 THEN 'parent' END AS label FROM part")
def prompts(spark, d):
    """Prompts, their hash and size, answers without nulls, and revisions by name and by id."""
    k = C("p_partkey")
    template = F.concat("p_name", F.lit(" {diff}"))
    answer = F.concat(F.lit('{"a": '), "p_size", F.lit(', "b": null, "c": {"d": '), F.when(k % 2 == 0, '"x"').otherwise("null"), F.lit("}}"))
    revision = F.when(k % 4 == 0, " HEAD ").when(k % 4 == 1, "0123456789").when(k % 4 == 2, "fedcba9876543210").otherwise("7654321")
    label = calls.revision_label(revision, F.lit("0123456789abcdef"), F.lit("fedcba98"), F.lit("aaaaaaaa"))
    return load(spark, d, "part").select("p_partkey", calls.prompt_hash(C("p_type"), template).alias("prompt_hash"), calls.prompt(template, C("p_brand")).alias("prompt"), calls.token_bound(F.array("p_name", "p_brand"), F.lit(5)).cast("int").alias("tokens"), calls.without_nulls(answer, "a int, b string, c struct<d:string>").alias("pruned"), label.alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'i' || s_suppkey ELSE 'r' || s_nationkey || '@' || s_name END AS record_id, array_to_string(list_sort(list_distinct([CAST(s_nationkey AS VARCHAR), s_name])), ',') AS relations, strftime(TIMESTAMP '2024-03-01' + INTERVAL 1 HOUR * (CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 5 END), '%Y-%m-%dT%H:%M:%SZ') AS at FROM supplier")
def record_identities(spark, d):
    """Ids of records, or what stands for them; the values that link them; times with, without and in another zone."""
    s = load(spark, d, "supplier")
    k = C("s_suppkey")
    rows = s.select(k, F.when(k % 2 == 0, F.concat(F.lit("i"), k)).alias("id"), F.concat(F.lit("r"), "s_nationkey").alias("repository"), C("s_name").alias("sha"), C("s_nationkey").cast("string").alias("n"))
    at = F.when(k % 3 == 0, "2024-03-01").when(k % 3 == 1, "2024-03-01T05:00:00Z").otherwise("2024-03-01T07:00:00+02:00")
    values = splits.relation_values(F.array("n", "sha", F.lit(""), "n"))
    return rows.select("s_suppkey", splits.record_ids(rows).alias("record_id"), F.array_join(values, ",").alias("relations"), splits.iso_utc(splits.timestamp_of(at)).alias("at"))


@query("SELECT CAST(count(*) AS BIGINT) AS arm_count, string_agg(p_name || p_partkey, ',' ORDER BY p_partkey) FILTER (p_size > 25) AS available, sum(p_size) AS total_result_count, sum(p_partkey % 3) AS total_external_processes, CAST(round(sum(p_size * 0.001), 8) AS DOUBLE) AS estimated_cost_usd FROM part")
def analyzer_arms(spark, d):
    p = load(spark, d, "part")
    arms = p.select(C("p_partkey").alias("place"), F.concat("p_name", "p_partkey").alias("name"), (C("p_size") > 25).alias("available"), F.lit("ok").alias("status"), C("p_size").cast("long").alias("result_count"), (C("p_partkey") % 3).alias("external_processes"), (C("p_size") * 0.001).alias("cost"))
    return reports.arms_summary(arms).select("arm_count", F.array_join("available", ",").alias("available"), "total_result_count", "total_external_processes", "estimated_cost_usd")


def judged(row: dict):
    """A stand-in for a model: it fails, answers in several forms, or says nothing it may say."""
    k = int(row["p_partkey"])
    if k % 5 == 0:
        raise ValueError("no answer")
    return (None, True, "no", {"decision": "fix", "cost": k}, {"flagged": False})[k % 5]


@query("SELECT p_partkey, ['YES', 'NO', 'YES', 'NO', 'ERROR'][CASE WHEN p_partkey % 5 = 0 THEN 5 ELSE p_partkey % 5 END] AS verdict, CASE WHEN p_partkey % 5 = 3 THEN '{\"cost\":' || p_partkey || '}' ELSE '{}' END AS usage, CASE WHEN p_partkey % 5 = 0 THEN '{\"kind\":\"ValueError\",\"message\":\"no answer\"}' END AS error FROM part")
def stage_outcomes(spark, d):
    """Answers of an injected callable, whatever their form, and its failures as rows."""
    from prospector.operators.stages import run_stage

    return run_stage(load(spark, d, "part").select("p_partkey"), judged).select("p_partkey", "verdict", "usage", "error")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'NO' ELSE 'YES' END AS verdict, CAST(CASE p_partkey % 3 WHEN 0 THEN 1.0 ELSE 0.67 END AS DOUBLE) AS agreement FROM part")
def voted_rounds(spark, d):
    """Three rounds of a callable by majority."""
    from prospector.operators.stages import voted

    def vote(row):
        k, n = int(row["p_partkey"]) % 3, int(row["round"])
        return "YES" if k == 0 or (k == 1 and n == 1) or (k == 2 and n > 1) else "NO"

    return voted(load(spark, d, "part").select("p_partkey"), "p_partkey", vote, 3).select("p_partkey", "verdict", "agreement")
