"""Queries over histories made of all orders or all line items, beside their SQL: long branches, blame in runs, hot links, and profiles over parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prospector.operators import attribution, graph, profiled, reach
from prospector.plans.catalog import C, load, query
from prospector.plans.corpus import sample_diffs


def two_lines(spark, d):
    """(edges, merges, order) of all orders: even keys are main, odd ones a branch as long as the history, and each thousandth key merges
    the branch into main."""
    k = C("o_orderkey")
    parents = F.when(k == 0, F.array().cast("array<bigint>")).when((k % 1000 == 0), F.array(k - 2, k - 1)).otherwise(F.array(F.greatest(k - 2, F.lit(0))))
    o = load(spark, d, "orders").select(k.cast("long").alias("node"), parents.cast("array<bigint>").alias("parents"))
    return o.select(C("node").alias("child"), F.posexplode("parents").alias("k", "parent")), o.where("size(parents) > 1").select(C("node").alias("merge"), C("parents")[0].alias("first_parent")), o.select("node", C("node").alias("place"))


@query("SELECT m.o_orderkey AS merge, n.o_orderkey AS node FROM orders m JOIN orders n ON n.o_orderkey % 2 = 1 AND n.o_orderkey BETWEEN m.o_orderkey - 999 AND m.o_orderkey - 1 WHERE m.o_orderkey % 1000 = 0 AND m.o_orderkey > 0")
def long_branches(spark, d):
    """What each merge of a long-lived branch brings in: what was added to it since the last one."""
    edges, merges, order = two_lines(spark, d)
    return reach.brought_in(edges, merges, order, None)


@query("SELECT o_orderkey AS node, o_orderkey AS place, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey = 0) = chain_of AS on_main, pos FROM (SELECT *, (SELECT max(x.o_orderkey) FROM orders x WHERE x.o_orderkey % 2 = o.o_orderkey % 2) AS chain_of, (o_orderkey + 1) // 2 AS pos FROM orders o WHERE o_orderkey > 0) WHERE pos > 0")
def chain_index(spark, d):
    """The place of each commit but the root on its chain: main is one, the branch the other."""
    edges, _, order = two_lines(spark, d)
    nodes, _ = reach.index(edges, order)
    main = nodes.where("node % 2 = 0").agg(F.max("node").alias("tip"))
    return nodes.where("node > 0").join(F.broadcast(main)).select("node", "place", (C("chain") == C("tip")).alias("on_main"), "pos")


RUNS = """r AS (SELECT l_orderkey AS sha, (l_linenumber - 1) * 40 + 1 AS first, l_linenumber * 40 AS last, l_partkey AS part FROM lineitem),
  c AS (SELECT DISTINCT p_partkey AS part, TIMESTAMP '2024-01-01' - INTERVAL 1 DAY * p_size AS made FROM part), f AS (SELECT o_orderkey AS seq, o_orderkey % 100 + 1 AS lo, o_orderkey % 100 + 1 + o_custkey % 150 AS hi FROM orders)"""


@query(f"WITH {RUNS} SELECT seq, arg_min('c' || lpad(CAST(part AS VARCHAR), 8, '0'), (made, part)) AS introduced_by, CAST(min(made) AS TIMESTAMP) AS introduced_at FROM f JOIN r ON sha = seq AND first <= hi AND last >= lo JOIN c USING (part) GROUP BY seq")
def introductions_by_runs(spark, d):
    """Every order's lines as a file in runs of forty lines, one for each line item; each finding reaches over up to four of them."""
    name = lambda k: F.concat(F.lit("c"), F.lpad(k.cast("string"), 8, "0"))
    n = C("l_linenumber").cast("int")
    runs = load(spark, d, "lineitem").select(C("l_orderkey").cast("string").alias("sha"), F.lit("x").alias("path"), ((n - 1) * 40 + 1).alias("first"), (n * 40).alias("last"), name(C("l_partkey")).alias("commit"))
    known = load(spark, d, "part").select(name(C("p_partkey")).alias("sha"), (F.lit("2024-01-01").cast("timestamp") - F.make_dt_interval("p_size")).alias("committed_at"), F.array(F.lit("p")).alias("parents"))
    lo = (C("o_orderkey") % 100 + 1).cast("int")
    e = F.struct(F.lit("parent").alias("revision"), C("o_orderkey").cast("string").alias("revision_sha"), F.lit("x").alias("path"), lo.alias("start_line"), (lo + C("o_custkey") % 150).cast("int").alias("end_line"), F.lit("q").alias("quoted_span"))
    found = load(spark, d, "orders").select(C("o_orderkey").alias("seq"), F.array(e).alias("evidence"))
    out = attribution.oldest_introduction(found, runs, known)
    return out.select("seq", "introduced_by", C("introduced_at").cast("timestamp_ntz").alias("introduced_at"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS line, min(l_partkey) AS part FROM lineitem GROUP BY ALL), p AS (SELECT *, part % 3 > 0 OR coalesce(lag(line) OVER w <> line - 1, true) AS starts FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)),
  g AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY l_orderkey ORDER BY line) AS run FROM p) SELECT l_orderkey AS sha, min(line) AS first, max(line) AS last, arg_min(part, line) AS commit FROM g GROUP BY l_orderkey, run""")
def blame_in_runs(spark, d):
    """Lines of one commit in a row become one run; a missing line ends it."""
    file = attribution.Window.partitionBy("sha").orderBy("line")
    lines = load(spark, d, "lineitem").groupBy(C("l_orderkey").alias("sha"), C("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"))
    own = (C("part") % 3 > 0) | F.coalesce(F.lag("line").over(file) != C("line") - 1, F.lit(True))
    lines = lines.withColumn("own", own).withColumn("commit", F.max(F.when(C("own"), F.struct("line", "part"))).over(file))
    return attribution.blame_runs(lines.select("sha", F.lit("x").alias("path"), "line", "commit")).select("sha", "first", "last", C("commit.part").alias("commit"))


@query("SELECT s_suppkey AS id, (SELECT min(s_suppkey) FROM supplier) AS \"group\" FROM supplier")
def groups_of_one_value(spark, d):
    """A value that all suppliers share links them all; it leaves each task as one row."""
    s = load(spark, d, "supplier").select(C("s_suppkey").alias("id"), F.lit("all").alias("shared"), C("s_nationkey").alias("nation"))
    return graph.linked_groups(s, "id", ["shared", "nation"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE min(o_orderkey) OVER (PARTITION BY o_orderkey % 5 > 0, o_orderkey // 1000) END AS \"group\" FROM orders")
def groups_of_long_ways(spark, d):
    """Orders linked each to the next one within a thousand; every fifth stands alone."""
    k = C("o_orderkey")
    place = F.when(k % 5 > 0, F.floor(k / 1000) * 800 + F.floor((k % 1000) / 5) * 4 + k % 5 - 1)
    o = load(spark, d, "orders").select(k.alias("id"), F.concat(F.floor(k / 1000), F.lit(":"), F.floor(place / 2)).alias("a"), F.concat(F.floor(k / 1000), F.lit(":"), F.floor((place + 1) / 2)).alias("b"))
    return graph.linked_groups(o, "id", ["a", "b"])


INPUTS = """x AS (SELECT p_partkey AS seq, p_partkey % 5 AS c, CASE WHEN p_partkey % 5 = 2 THEN '' ELSE p_name END AS name FROM part),
  y AS (SELECT *, unnest(['D0', 'D1']) AS profile FROM x), z AS (SELECT *, c < 2 OR (c = 2 AND profile = 'D0') AS ready FROM y)"""


def answer(text: str) -> dict:
    return {"text": "YES" if "e" in text.rpartition("\n+")[2] else "NO", "usage": {"total_tokens": len(text)}}


def two_runs(spark, d):
    """Profiles run over even parts, and then over all of them with what was decided."""
    diffs = sample_diffs(spark, d).withColumn("message", F.lit(""))
    cache = profiled.Decisions(spark, f"{graph.shared_dir(spark)}/decisions-{uuid.uuid4().hex}")
    profiled.run_profiles(diffs.where("seq % 2 = 0"), answer, cache, ("D0", "D1"), key="seq")
    return profiled.run_profiles(diffs, answer, cache, ("D0", "D1"), key="seq")


@query(f"""WITH {INPUTS} SELECT seq, profile, CASE WHEN ready THEN CASE WHEN contains(CASE c WHEN 2 THEN 'b' ELSE name END, 'e') THEN 'YES' ELSE 'NO' END END AS verdict,
  CASE WHEN ready THEN bool_or(seq % 2 = 0) OVER w OR seq > min(seq) OVER w END AS cache_hit FROM z WINDOW w AS (PARTITION BY profile, c, name)""")
def profile_runs(spark, d):
    """Every part's decisions, and which of them needed no call: known from the first run, or shared with a part before it."""
    return two_runs(spark, d).select("seq", "profile", "verdict", "cache_hit")


@query(f"""WITH {INPUTS}, h AS (SELECT *, bool_or(seq % 2 = 0) OVER w OR seq > min(seq) OVER w AS hit, contains(CASE c WHEN 2 THEN 'b' ELSE name END, 'e') AS yes FROM z WINDOW w AS (PARTITION BY profile, c, name))
  SELECT profile, count(*) AS commits, count(*) FILTER (ready) AS decided, count(*) FILTER (ready AND NOT hit) AS asked, count(*) FILTER (ready AND hit) AS reused, count(*) FILTER (ready AND yes) AS yes FROM h GROUP BY profile""")
def profile_run_costs(spark, d):
    return profiled.profile_costs(two_runs(spark, d)).drop("tokens")
