"""Queries of the corpus, its queues and worklists, of what changes show, and of attribution, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.functions import diffs, profiles
from prospector.operators import attribution, corpus, evaluation, runs
from prospector.sources import git
from prospector.plans.catalog import ADVISORY_SQL, DECISIONS, MESSAGES, C, choose, choose_sql, decisions, load, messages, query, terms_sql

# --- the corpus: orders as commits, customers as advisories

STORED, GIVEN = ("quiet", "", "announced", "empty"), ("fix", "", "context", "other", "backport", "introduce", "")


def raw_rows(spark, d) -> DataFrame:
    m = messages(spark, d).select(C("seq").alias("_s"), "message", "is_merge")
    o = load(spark, d, "orders").join(m, C("o_orderkey") == C("_s"))
    k, c = C("o_orderkey"), C("o_custkey")
    return o.select(
        k.alias("seq"), F.concat(F.lit("G"), c % 400).alias("ghsa_id"), F.when(k % 3 == 0, "gitlab.com").alias("host"), F.concat(F.lit("o/r"), c % 20).alias("repo"), F.upper(F.md5(c.cast("string").cast("binary"))).alias("sha"),
        F.lit(None).cast("string").alias("source"), choose(GIVEN, k).alias("role"), choose(STORED, k).alias("msg_class"), F.lit(None).cast("string").alias("subject"), "message", F.concat(F.lit("d/"), k).alias("diff_path"),
        (k % 100).alias("diff_bytes"), "is_merge", F.lit(None).cast("int").alias("parent_count"), F.lit(None).cast("boolean").alias("resolved"), F.when(k % 2 == 0, "x").alias("resolved_sha"),
        F.lit(None).cast("string").alias("message_class"), F.array(F.upper(F.md5(k.cast("string").cast("binary")))).alias("parents"),
    )


RAW = f"""{MESSAGES}, raw AS (SELECT o_orderkey AS seq, 'G' || (o_custkey % 400) AS ghsa_id, CASE WHEN o_orderkey % 3 = 0 THEN 'gitlab.com' ELSE 'github.com' END AS host, o_orderkey % 3 = 0 AS hosted, 'o/r' || (o_custkey % 20) AS repo,
  md5(CAST(o_custkey AS VARCHAR)) AS sha, {choose_sql(GIVEN, "o_orderkey")} AS role, {choose_sql(STORED, "o_orderkey")} AS stored, 'd/' || o_orderkey AS diff_path, o_orderkey % 100 AS diff_bytes, message, msg.is_merge, string_split(message, chr(10))[1] AS subject,
  o_orderkey % 2 = 0 AS resolved FROM orders JOIN msg ON msg.seq = o_orderkey),
cls AS (SELECT *, CASE WHEN message = '' THEN 'empty' WHEN is_merge AND regexp_matches(message, '^(Merge branch|Merge commit from fork|Merge remote-tracking branch|merge tag) ') THEN 'merge_noise' WHEN {ADVISORY_SQL} OR len({terms_sql('message')}) >= 2 THEN 'announced' ELSE 'quiet' END AS now FROM raw)"""


@query(f"WITH {RAW} SELECT seq, ghsa_id, host, sha, subject, now AS msg_class, row_number() OVER (PARTITION BY ghsa_id ORDER BY seq) - 1 AS ordinal, count(*) OVER (PARTITION BY ghsa_id) AS n_in_advisory FROM cls")
def corpus_rows(spark, d):
    return corpus.commit_rows(raw_rows(spark, d)).select("seq", "ghsa_id", "host", "sha", "subject", "msg_class", "ordinal", "n_in_advisory")


@query(f"WITH {RAW} SELECT now AS msg_class, count(*) AS n FROM cls GROUP BY now")
def stratum_counts(spark, d):
    return corpus.stratum_counts(corpus.commit_rows(raw_rows(spark, d)))


@query(f"WITH {RAW} SELECT sha, substr(subject, 1, 100) AS subject, stored AS was, now, {ADVISORY_SQL} AS has_identifier FROM cls WHERE stored <> '' AND stored <> now")
def reclassified(spark, d):
    return corpus.reclassified(corpus.commit_rows(raw_rows(spark, d))).select("sha", "subject", "was", "now", "has_identifier")


@query(f"WITH {RAW} SELECT role, count(*) AS n, count(DISTINCT (host, repo, sha)) AS commits FROM raw WHERE role IN ('fix', 'context') GROUP BY role UNION ALL SELECT 'labelled', count(*), count(DISTINCT (host, repo, sha)) FROM raw WHERE role <> ''")
def role_filters(spark, d):
    rows = raw_rows(spark, d).withColumn("host", corpus.text_of("host", "github.com")).withColumn("sha", F.lower("sha"))
    facts = lambda df: df.agg(F.count("*").alias("n"), F.count_distinct(*corpus.CONTENT).alias("commits"))
    one = [facts(corpus.by_role(rows, r)).select(F.lit(r).alias("role"), "n", "commits") for r in ("fix", "context")]
    return one[0].unionByName(one[1]).unionByName(facts(corpus.labelled(rows)).select(F.lit("labelled").alias("role"), "n", "commits"))


@query(f"WITH {RAW} SELECT host, repo, sha, arg_max(role, seq) AS role FROM raw WHERE role <> '' GROUP BY ALL")
def applied_roles(spark, d):
    return corpus.applied_roles(raw_rows(spark, d))


@query(f"WITH {RAW} SELECT host, repo, sha, min(seq) AS seq FROM raw GROUP BY ALL")
def unique_commits(spark, d):
    rows = raw_rows(spark, d).withColumn("host", corpus.text_of("host", "github.com")).withColumn("sha", F.lower("sha"))
    return corpus.unique_commits(rows).select(*corpus.CONTENT, "seq")


@query(f"""WITH {RAW}, one AS (SELECT repo, sha, arg_min(seq, (NOT resolved, seq)) AS seq FROM raw WHERE hosted GROUP BY ALL), lab AS (SELECT repo, sha, arg_max(role, seq) AS label FROM raw WHERE hosted AND seq % 2 = 1 GROUP BY ALL)
  SELECT 'gitlab.com/' || r.repo || '@' || r.sha AS id, md5(CAST(r.seq AS VARCHAR)) AS parent_sha, r.subject, CASE WHEN r.stored = '' THEN 'unknown' ELSE r.stored END AS message_class, CASE WHEN coalesce(label, '') = '' THEN r.role ELSE label END AS role
  FROM raw r JOIN one USING (repo, sha, seq) LEFT JOIN lab USING (repo, sha) WHERE r.hosted AND (r.role <> '' OR coalesce(label, '') <> '')""")
def development_rows(spark, d):
    """Rows of a named host, labelled by every second one of them."""
    raw = raw_rows(spark, d)
    labels = raw.where("seq % 2 = 1").select("seq", *corpus.CONTENT, "role").where("host IS NOT NULL")
    return corpus.development_rows(raw, labels).select("id", "parent_sha", "subject", "message_class", "role")


ADVISORIES = "adv AS (SELECT 'G' || (c_custkey % 350) AS g, arg_max('{\"ghsa_id\":\"' || 'G' || (c_custkey % 350) || '\",\"id\":null,\"summary\":\"' || c_name || '\"}', c_custkey) AS advisory FROM customer GROUP BY 1)"
ITEM = "'{0}-' || substr(sha256('{0}|' || repo || '|' || sha), 1, 10) AS item_id"


def advisories(spark, d) -> DataFrame:
    g = F.concat(F.lit("G"), C("c_custkey") % 350)
    return load(spark, d, "customer").select(C("c_custkey").alias("seq"), g.alias("ghsa_id"), F.lit(None).cast("string").alias("id"), C("c_name").alias("summary"))


def shown(items: DataFrame) -> DataFrame:
    """An item's columns; the advisory without nulls, as JSON has it."""
    return items.select("item_id", "sha", "subject", "diff_bytes", "advisory", F.coalesce("role", F.lit("-")).alias("role"))


SHOWN = "sha, subject, diff_bytes, replace(advisory, '\"id\":null,', '') AS advisory, '-' AS role"


def low_rows(spark, d) -> DataFrame:
    return raw_rows(spark, d).withColumn("sha", F.lower("sha")).withColumn("subject", F.split("message", "\n")[0])


@query(f"WITH {RAW}, {ADVISORIES}, one AS (SELECT sha, min(seq) AS seq FROM raw GROUP BY sha) SELECT {ITEM.format('holdout')}, {SHOWN} FROM raw JOIN one USING (sha, seq) LEFT JOIN adv ON ghsa_id = g")
def holdout_worklist(spark, d):
    return shown(corpus.holdout_worklist(low_rows(spark, d), advisories(spark, d)))


@query(f"WITH {RAW}, {ADVISORIES}, one AS (SELECT sha, min(seq) AS seq FROM raw WHERE substr(sha, 1, 2) IN ('0a', 'ff') OR substr(sha, 1, 3) = '123' GROUP BY sha) SELECT {ITEM.format('relabel-audit')}, {SHOWN} FROM raw JOIN one USING (sha, seq) LEFT JOIN adv ON ghsa_id = g")
def relabel_worklist(spark, d):
    """Commits whose ids begin with prefixes of several lengths, each once and blind."""
    prefixes = spark.createDataFrame([("0A",), ("ff",), ("123",), ("",)], "prefix string")
    return shown(corpus.relabel_audit(low_rows(spark, d), prefixes, advisories(spark, d)))


@query(f"WITH {RAW}, {ADVISORIES}, one AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY seq) AS rn FROM raw WHERE role IN ('other', 'context') AND sha IN (SELECT md5(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_acctbal > 0)), x AS (FROM one WHERE rn = 1 ORDER BY sha256('negative-audit-v1|' || sha) LIMIT 40) SELECT {ITEM.format('negative-audit')}, {SHOWN} FROM x LEFT JOIN adv ON ghsa_id = g")
def negative_worklist(spark, d):
    no = load(spark, d, "customer").where("c_acctbal > 0").select(F.md5(C("c_custkey").cast("string").cast("binary")).alias("sha"))
    rows = corpus.logs.earliest(corpus.by_role(low_rows(spark, d), "other", "context"), ["sha"])
    return shown(corpus.negative_audit(rows, no, advisories(spark, d)))


QUEUE = f"{DECISIONS}, tri AS (SELECT repository, CAST(item AS VARCHAR) AS sha, arg_max(prediction, seq) AS verdict, CASE WHEN arg_max(run, seq) = 'error' THEN 'e' END AS error FROM dec WHERE seq % 2 = 0 GROUP BY ALL)"


@query(f"""WITH {QUEUE}, have AS (SELECT repository, CAST(item AS VARCHAR) AS sha, list_sort(list(DISTINCT run)) AS present FROM dec WHERE seq % 2 = 1 AND run <> 'signup' AND value > 90 GROUP BY ALL),
  j AS (SELECT t.*, coalesce(present, CAST([] AS VARCHAR[])) AS present FROM tri t LEFT JOIN have USING (repository, sha)), k AS (SELECT *, list_filter(['click', 'view'], lambda x: NOT list_contains(present, x)) AS missing FROM j)
  SELECT repository, sha, array_to_string(present, ',') AS present, array_to_string(missing, ',') AS missing, CASE WHEN error IS NULL THEN 'triage_candidate' ELSE 'triage_error' END AS reason FROM k WHERE (verdict <> 'NO' OR error IS NOT NULL) AND len(missing) > 0""")
def candidate_queue(spark, d):
    x = decisions(spark, d).withColumn("sha", C("item").cast("string"))
    last = corpus.logs.latest(x.where("seq % 2 = 0"), ["repository", "sha"])
    triage = last.select("repository", "sha", C("prediction").alias("verdict"), F.when(C("run") == "error", "e").alias("error"))
    labels = x.where("seq % 2 = 1 AND value > 90").select("seq", "repository", "sha", C("run").alias("annotator"), F.when(C("run") == "signup", "adjudication").alias("record_type"))
    out = corpus.candidate_queue(x.select("repository", "sha").distinct(), triage, labels, ["click", "view"])
    return out.select("repository", "sha", F.array_join("annotators_present", ",").alias("present"), F.array_join("annotators_missing", ",").alias("missing"), "reason")


LAYERS = f"""{DECISIONS}, g AS (SELECT repository, CAST(item AS VARCHAR) AS sha, list(DISTINCT prediction) FILTER (prediction IN ('YES', 'NO')) AS v, max(CASE WHEN value > 180 THEN 1 ELSE 0 END) AS fix, max(CASE WHEN value < 0.5 THEN 1 ELSE 0 END) AS con FROM dec GROUP BY ALL),
  s AS (SELECT repository, sha, CASE WHEN fix = 1 THEN 'positive' WHEN con = 1 THEN 'hard_negative' WHEN v = ['YES'] THEN 'positive' WHEN v = ['NO'] THEN 'hard_negative' ELSE 'unknown' END AS stratum, len(v) > 1 AS dis, sha256('rich-pilot-v1' || chr(0) || repository || chr(0) || sha) AS h FROM g)"""


@query(f"""WITH {LAYERS}, r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY NOT dis, h) AS k FROM s), f AS (SELECT *, k <= CASE stratum WHEN 'unknown' THEN 0 ELSE 20 END AS quota FROM r),
  z AS (SELECT *, row_number() OVER (ORDER BY NOT quota, NOT dis, h) AS place FROM f) SELECT repository, sha, stratum FROM z WHERE place <= 40""")
def rich_pilot_queue(spark, d):
    x = decisions(spark, d).withColumn("sha", C("item").cast("string"))
    role = F.when(C("value") > 180, "fix").when(C("value") < 0.5, "context")
    g = x.groupBy("repository", "sha").agg(F.collect_set(role).alias("roles"), F.collect_set(F.when(C("prediction").isin("YES", "NO"), C("prediction"))).alias("verdicts"))
    g = g.select("repository", "sha", corpus.pilot_stratum(F.lit(None).cast("string"), C("roles"), C("verdicts")).alias("stratum"), (F.size("verdicts") > 1).alias("has_disagreement"))
    return corpus.pilot_queue(g).select("repository", "sha", "stratum")


@query(f"""WITH {DECISIONS}, l AS (SELECT repository, item, run, arg_max(prediction, seq) AS p, max(seq) AS seq FROM dec WHERE run <> 'signup' GROUP BY ALL), d AS (SELECT repository, item, count(*) AS annotators FROM l GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT p) > 1),
  t AS (SELECT repository, item, max(seq) FILTER (run = 'signup') AS a, max(seq) FILTER (run <> 'signup') AS n FROM dec GROUP BY ALL) SELECT repository, item, annotators FROM d JOIN t USING (repository, item) WHERE NOT coalesce(a > n, a IS NOT NULL)""")
def unresolved_disagreements(spark, d):
    x = decisions(spark, d).withColumn("record_type", F.when(C("run") == "signup", "adjudication")).withColumnRenamed("run", "annotator")
    return corpus.unresolved(x, ["repository", "item"], ["prediction"]).select("repository", "item", "annotators")


@query(f"WITH {DECISIONS}, l AS (SELECT item, run, arg_max(prediction, seq) AS p FROM dec WHERE run <> 'signup' GROUP BY ALL) SELECT item, string_agg(run || '=' || p, ',' ORDER BY run) AS records FROM l GROUP BY item")
def annotations_by_candidate(spark, d):
    x = decisions(spark, d).withColumn("record_type", F.when(C("run") == "signup", "adjudication")).select("item", "seq", C("run").alias("annotator"), "prediction", "record_type")
    a = corpus.annotations(x, ["item"], "annotation")
    return a.select("item", F.array_join(F.transform("records", lambda r: F.concat(r["annotator"], F.lit("="), r["prediction"])), ",").alias("records"))


@query(f"""WITH {DECISIONS}, l AS (SELECT item, run, max(seq) AS seq FROM dec WHERE run <> 'signup' GROUP BY ALL), g AS (SELECT item, array_to_string(list_sort(list('h' || seq)), ',') AS hashes, array_to_string(list_sort(list(run)), ',') AS annotators, count(*) AS k FROM l GROUP BY item)
  SELECT item, hashes, annotators, 'frozen' AS status FROM g WHERE k >= 2""")
def adjudication_records(spark, d):
    last = corpus.logs.latest(decisions(spark, d).where("run <> 'signup'"), ["item", "run"]).select("item", C("run").alias("annotator"), F.concat(F.lit("h"), "seq").alias("record_id"))
    many = last.groupBy("item").agg(F.count("*").alias("k")).where("k >= 2").select("item", F.lit("judge").alias("annotator"))
    out = corpus.adjudication(last, ["item"], many)
    return out.select("item", F.array_join("source_record_hashes", ",").alias("hashes"), F.array_join("source_annotators", ",").alias("annotators"), "status")


@query(f"""WITH {DECISIONS}, s AS (SELECT DISTINCT run, item FROM dec), r AS (SELECT DISTINCT run FROM s), p AS (SELECT a.run AS l, b.run AS r FROM r a JOIN r b ON a.run < b.run)
  SELECT l AS "left", r AS "right", (SELECT count(*) FROM s x JOIN s y USING (item) WHERE x.run = l AND y.run = r) AS in_both, (SELECT count(*) FROM s x WHERE x.run = l AND NOT EXISTS (SELECT 1 FROM s y WHERE y.run = r AND y.item = x.item)) AS only_left,
  (SELECT count(*) FROM s x WHERE x.run = r AND NOT EXISTS (SELECT 1 FROM s y WHERE y.run = l AND y.item = x.item)) AS only_right FROM p""")
def candidate_pairs(spark, d):
    return evaluation.pairs_of_runs(decisions(spark, d), "run", "item")


# --- what changes show

VENDORED = "diff --git a/vendor/v.go b/vendor/v.go\nindex 1a..2b 100644\n--- a/vendor/v.go\n+++ b/vendor/v.go\n@@ -1 +1 @@\n-a\n+b\n"


def sample_diffs(spark, d) -> DataFrame:
    """A vendored and an own section around each part's name; some without either, some empty, some no diff."""
    k = C("p_partkey")
    own = F.concat(F.lit("diff --git a/src/m.py b/src/m.py\r\nindex 1a..2b\r\n--- a/src/m.py\n+++ b/src/m.py\n@@ -1 +1 @@\n-x\n+"), C("p_name"))
    diff = F.when(k % 5 == 0, F.concat(F.lit(VENDORED), own)).when(k % 5 == 1, own).when(k % 5 == 2, VENDORED).when(k % 5 == 3, C("p_name")).otherwise(" \n")
    return load(spark, d, "part").select(k.alias("seq"), diff.alias("diff"), F.when(k % 2 == 0, C("p_type")).otherwise(" ").alias("subject"))


OWN_SQL = "'diff --git a/src/m.py b/src/m.py' || chr(10) || '--- a/src/m.py' || chr(10) || '+++ b/src/m.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-x' || chr(10) || '+' || p_name || chr(10)"


@query(f"""WITH x AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 5 < 2 THEN {OWN_SQL} ELSE '' END AS body, CASE p_partkey % 5 WHEN 0 THEN 'ready' WHEN 1 THEN 'ready' WHEN 2 THEN 'empty_first_party' WHEN 3 THEN 'malformed' ELSE 'empty' END AS status,
    '### Commit subject' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '(empty)' END || chr(10) || chr(10) || '### Diff' || chr(10) AS before FROM part)
  SELECT seq, status, 'sha256:' || sha256(before || body) AS input_hash, 'sha256:' || sha256(body) AS normalized_diff_hash, CASE WHEN status = 'ready' THEN 1 ELSE 0 END AS chunks, CASE WHEN status = 'ready' THEN 'sha256:' || sha256(before || body) ELSE '' END AS chunk_hashes,
  CASE WHEN seq % 5 IN (0, 2) THEN 'vendor/v.go' ELSE '' END AS excluded, CASE seq % 5 WHEN 0 THEN 'source,generated_vendor' WHEN 1 THEN 'source' WHEN 2 THEN 'generated_vendor' ELSE '' END AS kinds,
  CASE status WHEN 'empty' THEN 'raw diff is empty' WHEN 'malformed' THEN 'input is not a recognizable Git diff' WHEN 'empty_first_party' THEN 'no first-party files remain after generated/vendor filtering' END AS error FROM x""")
def input_profiles(spark, d):
    """First-party sections after the subject, their status, hashes, kinds, and what is left out."""
    x = profiles.input_hashes(profiles.input_profile(sample_diffs(spark, d), "D2", "diff", subject=C("subject")))
    return x.select(
        "seq", "status", "hashes.input_hash", "hashes.normalized_diff_hash", F.size("chunks").alias("chunks"), F.array_join("hashes.chunk_hashes", ",").alias("chunk_hashes"),
        F.array_join("excluded_paths", ",").alias("excluded"), F.array_join("change_kinds", ",").alias("kinds"), "error",
    )


@query("SELECT p_partkey AS seq, unnest(['R100', 'A', 'D', 'M']) AS status, unnest(['new/' || p_name, 'a b/' || p_partkey, 'gone/' || p_partkey, 'kept']) AS path, unnest(['old/' || p_name, NULL, NULL, NULL]) AS old_path FROM part")
def changed_paths(spark, d):
    """Renamed, added, deleted and modified files of a patch; a name with a blank is read from its own line."""
    k = C("p_partkey").cast("string")
    patch = F.concat(
        F.lit("diff --git a/old b/new\nrename from old/"), C("p_name"), F.lit("\nrename to new/"), C("p_name"), F.lit("\ndiff --git a/a b/"), k, F.lit(" b/a b/"), k, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/a b/"), k,
        F.lit("\ndiff --git a/gone/"), k, F.lit(" b/gone/"), k, F.lit("\ndeleted file mode 100644\n--- a/gone/"), k, F.lit("\n+++ /dev/null\ndiff --git a/kept b/kept\n@@ -1 +1 @@\n-a\n+b\n"),
    )
    return load(spark, d, "part").select(C("p_partkey").alias("seq"), F.explode(diffs.changed_paths(patch)).alias("c")).select("seq", "c.status", "c.path", "c.old_path")


@query("SELECT p_partkey AS seq, 3 AS input_hunks, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS filtered_hunks, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS substantive_hunks, 'foo,go' AS calls FROM part")
def substantive_hunks(spark, d):
    """Hunks left when white space and comments don't count, and the calls that the first hunk changes."""
    name = F.concat(F.lit("x"), choose((".go", ".py"), C("p_partkey")))
    t = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n@@ -1 +1 @@\n-a.foo (1)\n+if (go(2))\n@@ -5 +5 @@\n-// one\n+  // two\n@@ -9 +9 @@\n-b  c\n+b  c \n"))
    h = load(spark, d, "part").select(C("p_partkey").alias("seq"), diffs.hunks(t).alias("h"))
    s = diffs.substantive(C("h"))
    return h.select("seq", s["input_hunks"].alias("input_hunks"), s["filtered_hunks"].alias("filtered_hunks"), s["substantive_hunks"].alias("substantive_hunks"), F.array_join(diffs.changed_calls(C("h")[0]["lines"]), ",").alias("calls"))


@query("SELECT p_brand, CASE WHEN p_brand = 'Brand#11' THEN '' ELSE chr(10) || chr(10) || 'About ' || p_brand || chr(10) END AS appendix, count(*) AS n FROM part GROUP BY ALL")
def language_appendix(spark, d):
    x = load(spark, d, "part").select(C("p_brand").alias("language"))
    bodies = x.distinct().where("language <> 'Brand#11'").select("language", F.concat(F.lit("About "), "language", F.lit(" ")).alias("body"))
    return runs.with_appendix(x, "language", bodies).groupBy(C("language").alias("p_brand"), "appendix").agg(F.count("*").alias("n"))


# --- attribution: orders as commits in tens, see catalog.edges()

SHA = "printf('%012x', {})"


def sha(k):
    return F.lpad(F.lower(F.hex(k)), 12, "0")


def commits(spark, d) -> DataFrame:
    k = C("o_orderkey")
    parents = F.when(k % 10 == 5, F.array(sha(k - 3))).when(k % 10 == 6, F.array(sha(k - 1), sha(k - 2))).otherwise(F.array(sha(k - 1)))
    path = F.when(k % 10 == 3, "x").when(k % 10 == 4, F.when(k % 20 == 4, "x").otherwise("y")).otherwise("z")
    added = F.when(k % 10 == 4, F.array(F.lit("cited line"))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "orders").select(sha(k).alias("sha"), k.alias("place"), parents.alias("parents"), F.array(path).alias("paths"), added.alias("added"), F.when(k % 10 == 6, F.concat(F.lit("p"), F.floor(k / 20))).alias("patch_id"))


def merge_findings(spark, d) -> DataFrame:
    """A finding on every commit."""
    k = C("o_orderkey")
    e = F.array(F.struct(F.lit("commit").alias("revision"), sha(k).alias("revision_sha"), F.lit("x").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(" cited  line").alias("quoted_span")))
    return load(spark, d, "orders").select(k.alias("seq"), sha(k).alias("sha"), F.array(F.lit("x")).alias("affected_paths"), e.alias("evidence"), F.lit(None).cast("string").alias("attributed_from"))


@query(f"""SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 <> 6 THEN 'direct' WHEN o_orderkey % 20 = 6 THEN 'merge_evidence_content' ELSE 'merge_first_parent_walk' END AS method,
  CASE WHEN o_orderkey % 10 <> 6 THEN {SHA.format('o_orderkey')} WHEN o_orderkey % 20 = 6 THEN {SHA.format('o_orderkey - 2')} ELSE {SHA.format('o_orderkey - 3')} END AS attributed FROM orders""")
def merge_attribution(spark, d):
    """Findings on merges: of two commits brought in, one or both touch the path, and one has added the cited line."""
    return attribution.attribute(merge_findings(spark, d), commits(spark, d)).select("seq", "method", "attributed")


@query(f"""SELECT o_orderkey AS seq, {SHA.format('o_orderkey')} AS sha, CAST(NULL AS VARCHAR) AS duplicate_of FROM orders WHERE o_orderkey % 10 <> 6 UNION ALL SELECT NULL, {SHA.format('o_orderkey')}, {SHA.format('o_orderkey - 3')} FROM orders WHERE o_orderkey % 10 = 6""")
def merge_collapse(spark, d):
    """Findings on merges fold into those on commits that they brought in."""
    kept, dropped = attribution.collapse(merge_findings(spark, d), commits(spark, d))
    return kept.select("seq", "sha", F.lit(None).cast("string").alias("duplicate_of")).unionByName(dropped.select(F.lit(None).cast("long").alias("seq"), "sha", "duplicate_of"))


@query(f"""WITH r AS (SELECT o_orderkey AS seq, {SHA.format('o_orderkey')} AS sha, o_orderkey // 20 AS p, o_orderkey % 20 AS n FROM orders), m AS (SELECT *, count(*) OVER (PARTITION BY p) AS k FROM r WHERE n IN (6, 16))
  SELECT seq, sha, CAST(NULL AS VARCHAR) AS duplicate_of FROM r WHERE n NOT IN (6, 16) UNION ALL SELECT seq, sha, NULL FROM m WHERE n = 6 OR k = 1 UNION ALL SELECT NULL, sha, {SHA.format('seq - 10')} FROM m WHERE n = 16 AND k = 2""")
def patch_duplicates(spark, d):
    """Merges of one patch id: the smaller sha stays and is named by the other."""
    rows = merge_findings(spark, d).join(commits(spark, d).select("sha", "patch_id"), "sha", "left")
    kept, dropped = attribution.deduplicate(rows)
    return kept.select("seq", "sha", F.lit(None).cast("string").alias("duplicate_of")).unionByName(dropped.select(F.lit(None).cast("long").alias("seq"), "sha", "duplicate_of"))


@query(f"""SELECT o_orderkey AS seq, o_orderkey % 3 > 0 AS rebased, CASE WHEN o_orderkey % 3 > 0 THEN {SHA.format('o_orderkey - 2')} ELSE {SHA.format('o_orderkey')} END AS revision_sha FROM orders WHERE o_orderkey % 10 = 6""")
def rebased_evidence(spark, d):
    """Quotes looked up at the commit that the finding moves to; where one is not there, the evidence stays."""
    k = C("seq")
    found = merge_findings(spark, d).where(k % 10 == 6).withColumn("attributed", sha(k - 2))
    blobs = found.where(k % 3 > 0).select(C("attributed").alias("sha"), F.lit("x").alias("path"), F.lit("the cited line is here\nmore").alias("content"))
    return attribution.rebase(found, commits(spark, d), blobs).select("seq", "rebased", C("evidence")[0]["revision_sha"].alias("revision_sha"))


@query("WITH x AS (SELECT o_orderkey AS seq, greatest(o_orderkey % 7 + 1, least(9000, 9)) AS n FROM orders) SELECT seq, 'c' || (seq + n) AS introduced_by, CAST(TIMESTAMP '2024-01-01' - INTERVAL 1 DAY * n AS TIMESTAMP) AS introduced_at FROM x")
def oldest_introduction(spark, d):
    """The oldest commit that last touched one of the lines of a finding's parent evidence."""
    o = load(spark, d, "orders").select(C("o_orderkey").alias("seq"))
    n = C("seq") % 7 + 1
    ev = lambda kind, lo, hi: F.struct(F.lit(kind).alias("revision"), C("seq").cast("string").alias("revision_sha"), F.lit("x").alias("path"), F.lit(lo).alias("start_line"), hi.cast("int").alias("end_line"), F.lit("q").alias("quoted_span"))
    found = o.select("seq", F.array(ev("parent", 1, n), ev("commit", 1, n + 9), ev("parent", 1, F.lit(9000))).alias("evidence"))
    lines = o.select(C("seq").cast("string").alias("sha"), F.lit("x").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("line"), "seq")
    blame = lines.select("sha", "path", "line", F.concat(F.lit("c"), C("seq") + C("line")).alias("commit"), C("line").alias("age"))
    at = blame.select("sha", "path", "line", F.concat_ws("@", "commit", "line").alias("commit"))
    when = at.select(C("commit").alias("sha"), (F.lit("2024-01-01").cast("timestamp") - F.make_dt_interval("line")).alias("committed_at"), F.array(F.lit("p")).alias("parents"))
    out = attribution.oldest_introduction(found, at, when)
    return out.select("seq", F.substring_index("introduced_by", "@", 1).alias("introduced_by"), C("introduced_at").cast("timestamp_ntz").alias("introduced_at"))


@query(f"""SELECT o_orderkey AS seq, unnest([{SHA.format('o_orderkey').replace('%012x', '%040x')}, {SHA.format('o_orderkey + 1').replace('%012x', '%040x')}]) AS sha, unnest(['fix it' || chr(10) || chr(10) || o_orderpriority, 'é']) AS message,
  unnest(['M src/' || o_orderkey, '']) AS paths, unnest([o_orderkey % 9 = 0, false]) AS truncated, unnest([CASE WHEN o_orderkey % 9 = 0 THEN 200 ELSE 28 + 2 * length(CAST(o_orderkey AS VARCHAR)) END, 0]) AS bytes FROM orders""")
def commit_records(spark, d):
    """Streams of two commits each, taken apart; patches of over 200 bytes are cut."""
    k = C("o_orderkey")
    full = lambda x: F.lpad(F.lower(F.hex(x)), 40, "0")
    begin, end, z = F.lit("\0\x01commit\0"), F.lit("\0\x01patch\0"), F.lit("\0")
    record = lambda s, parents, said, patch: F.concat(begin, s, z, parents, F.lit("\0n\0e\0t\0n\0e\0t\0"), said, end, F.lit("\n"), patch)
    diff = F.concat(F.lit("\ndiff --git a/src/"), k, F.lit(" b/src/"), k, F.lit("\n@@\n"), F.when(k % 9 == 0, F.repeat(F.lit("x"), 900)).otherwise(""))
    stream = F.concat(F.lit("noise"), record(full(k), full(k + 1), F.concat(F.lit("fix it\n\n"), "o_orderpriority", F.lit("\n")), diff), record(full(k + 1), F.lit(""), F.lit("é\n"), F.lit("")))
    x = load(spark, d, "orders").select(k.alias("seq"), F.explode(git.commits_in(stream.cast("binary"), 200)).alias("c"))
    paths = F.array_join(F.transform("c.changed_paths", lambda p: F.concat_ws(" ", p["status"], p["path"])), ",")
    return x.select("seq", "c.sha", "c.message", paths.alias("paths"), "c.truncated", F.length("c.patch").alias("bytes"))
