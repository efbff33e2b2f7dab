"""Linked groups against brute force over small chunks, and what a shared value leaves a task as; introductions by runs of blame."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospector.operators import attribution, graph


def brute(rows):
    group = {i: i for i, *_ in rows}
    while True:
        low = {}
        for i, *vs in rows:
            for k, v in enumerate(vs):
                if v is not None:
                    low[k, v] = min(low.get((k, v), group[i]), group[i])
        after = dict(group)
        for i, *vs in rows:
            after[i] = min([after[i], *[low[k, v] for k, v in enumerate(vs) if v is not None]])
        if after == group:
            return group
        group = after


@pytest.mark.parametrize("chunk", [7, 60, 10**6])
@pytest.mark.parametrize("text", [False, True])
def test_linked_groups(spark, chunk, text):
    r = random.Random(chunk)
    name = (lambda k: f"é{k}") if text else (lambda k: k)
    rows = [(name(r.randrange(120)), r.choice([None, str(r.randrange(90))]), r.choice([None, r.randrange(60)]), None) for _ in range(150)]
    rows += [(name(500 + k), f"way{k}", None, f"way{k // 2}") for k in range(40)] + [(name(600 + k), f"l{k}", None, None) for k in range(3)]
    rows += [(name(700 + k), str(5000 + k), 9000 + (k + 1) // 2, None) for k in range(2)] + [(name(800 + k), f"c{k // 2}", 7000 + (k + 1) // 2, None) for k in range(60)]
    df = spark.createDataFrame(rows, f"id {'string' if text else 'int'}, a string, b int, c string").repartition(5)
    got = {x["id"]: x["group"] for x in graph.linked_groups(df, "id", ["a", "b", "c"], chunk).collect()}
    assert got == brute(rows)


def test_a_value_of_all_records_is_one_row_a_chunk(spark):
    rows = spark.range(1000).select("id", F.lit("all").alias("v"), (F.col("id") % 300).alias("w")).repartition(4)
    pairs = rows.select(F.col("id").alias("item"), F.lit("k").alias("k"), "v")
    held = pairs.mapInArrow(graph.linked_here(100), "item long, root long, k string, v string").where("v IS NOT NULL")
    assert held.count() <= 4 * 10  # of 1,000 links
    got = graph.linked_groups(rows, "id", ["v", "w"], 100)
    assert got.count() == 1000 and got.where("`group` <> 0").count() == 0


def test_no_links(spark):
    df = spark.createDataFrame([(3, None), (1, "x")], "id int, a string")
    assert sorted(map(tuple, graph.linked_groups(df, "id", ["a"]).collect())) == [(1, 1), (3, 3)]
    assert graph.linked_groups(df.limit(0), "id", ["a"]).count() == 0


def test_introductions_by_runs(spark):
    r = random.Random(3)
    lines = [("s", "f", k, r.choice("abcd")) for k in range(1, 400) if k % 37] + [("s", "g", k, "e") for k in range(1, 9)] + [("t", "f", 5, "z")]
    blame = spark.createDataFrame(lines, "sha string, path string, line int, commit string")
    runs = attribution.blame_runs(blame)
    back = {(x["sha"], x["path"], k, x["commit"]) for x in runs.collect() for k in range(x["first"], x["last"] + 1)}
    assert back == set(lines) and runs.count() < len(lines)
    when = {"a": "2024-01-04", "b": "2024-01-02", "c": "2024-01-02", "d": None, "e": "2024-01-09", "z": None}
    commits = spark.createDataFrame([(c, t, [] if c == "b" else ["p"]) for c, t in when.items()], "sha string, at string, parents array<string>").select("sha", F.to_timestamp("at").alias("committed_at"), "parents")
    spans = []
    for k in range(60):
        lo = r.randint(1, 420)
        spans.append((k, "s", r.choice("fg"), lo, lo + r.choice([0, 1, 5, 130, 399, 400])))
    spans += [(60, "t", "f", 1, 9), (61, "s", "f", 9, 3), (62, "u", "f", 1, 9)]
    e = F.array(F.struct(F.lit("parent").alias("revision"), F.col("at").alias("revision_sha"), "path", F.col("lo").alias("start_line"), F.col("hi").alias("end_line"), F.lit("q").alias("quoted_span")))
    found = spark.createDataFrame(spans, "seq int, at string, path string, lo int, hi int").select("seq", e.alias("evidence"))
    want = {}
    for k, sha, path, lo, hi in spans:
        if 0 <= hi - lo < attribution.BLAME_LINES and (met := {c for s, p, n, c in lines if (s, p) == (sha, path) and lo <= n <= hi}):
            dated = sorted((when[c], c) for c in met if when[c])
            want[k] = (dated[0][1], dated[0][1] == "b") if dated else (None, None)
    for given in (blame, runs):
        out = attribution.oldest_introduction(found, given, commits)
        assert {x["seq"]: (x["introduced_by"], x["is_root"]) for x in out.collect()} == want
    assert want[60] == (None, None)


def test_blame_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(attribution, "BLAME_ROWS", 10)
    blame = spark.range(200).selectExpr("concat('s', id % 9) AS sha", "'f' AS path", "CAST(id / 9 AS INT) + 1 AS line", "concat('c', id % 5) AS commit")
    plan = attribution.blame_runs(blame)._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    commits = spark.range(5).selectExpr("concat('c', id) AS sha", "timestamp_seconds(id) AS committed_at", "array('p') AS parents")
    found = spark.range(9).selectExpr("id AS seq", "array(named_struct('revision', 'parent', 'revision_sha', concat('s', id), 'path', 'f', 'start_line', 1, 'end_line', 3, 'quoted_span', 'q')) AS evidence")
    out = attribution.oldest_introduction(found, blame, commits)
    assert out._jdf.queryExecution().toString().count(", 20), REPARTITION_BY_NUM") >= 4
    assert {r["seq"]: r["introduced_by"] for r in out.collect()} == {k: f"c{min((k + 9 * n) % 5 for n in range(3))}" for k in range(9)}


def test_ranges_of_any_length(spark, monkeypatch):
    r = random.Random(5)
    lines = [(s, "f", k, f"{s}{r.randrange(60)}") for s, n in (("s", 3000), ("t", 500), ("u", 9)) for k in range(1, n + 1) if k % 700 > 20]
    blame = spark.createDataFrame(lines, "sha string, path string, line int, commit string")
    at = {c: r.choice([None, *range(40)]) for c in sorted({c for *_, c in lines})}
    commits = spark.createDataFrame(list(at.items()), "sha string, at long").selectExpr("sha", "timestamp_seconds(at) AS committed_at", "array('p') AS parents")
    spans = [(k, s, lo, lo + n) for k, (s, lo, n) in enumerate((r.choice("stu"), r.randint(1, 2500), r.choice([5, 130, 399, 400, 401, 900, 1100, 2500])) for _ in range(60))]
    spans += [(70, "s", 1, 2**31 - 1), (71, "u", 2, 9000), (72, "t", 501, 9000), (73, "s", 2300, 2400), (73, "s", 1, 1500), (73, "t", 1, 2**31 - 1), (74, "s", 1, 4)]
    e = F.collect_list(F.struct(F.lit("parent").alias("revision"), F.col("at").alias("revision_sha"), F.lit("f").alias("path"), F.col("lo").alias("start_line"), F.col("hi").alias("end_line"), F.lit("q").alias("quoted_span")))
    found = spark.createDataFrame(spans, "seq int, at string, lo int, hi int").groupBy("seq").agg(e.alias("evidence"))
    want = {}
    for k, sha, lo, hi in spans:
        want.setdefault(k, set()).update(c for s, _, n, c in lines if s == sha and lo <= n <= hi)
    want = {k: min(((at[c], c) for c in met if at[c] is not None), default=(None, None))[1] for k, met in want.items() if met}
    for far in (1, 3, attribution.BLAME_FAR):
        monkeypatch.setattr(attribution, "BLAME_FAR", far)
        for given in (blame, attribution.blame_runs(blame)):
            assert {x["seq"]: x["introduced_by"] for x in attribution.oldest_introduction(found, given, commits).collect()} == want


def test_a_chunk_of_values_comes_back_in_batches():
    n = 200_000
    chunk = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["a", "b"] * (n // 2)), pa.array([str(k // 4) for k in range(n)])], names=["item", "k", "v"])
    out = [(b.num_rows, b.filter(pa.compute.is_null(b["v"]))["root"].to_pylist()[:3]) for b in graph.linked_here(n)([chunk])]
    assert out[0][1] == [0, 1, 0] and max(k for k, _ in out) <= graph.SENT and sum(k for k, _ in out) == n + n // 2
