"""Contracts, answers of services, splits and runs."""

import pytest
from pyspark.sql import functions as F

from prospector.functions import calls, contracts
from prospector.operators import runs, splits

SHA, OTHER = "a" * 40, "b" * 40
ANCHOR = "revision string, revision_sha string, path string, start_line int, end_line int, quoted_span string, supports array<string>"
CORE = contracts.CORE_FIELDS
ALL_CLAIMS = [*CORE, "affected_paths"]


def row(spark, schema, **values):
    return spark.createDataFrame([values], schema)


def finding(spark, **over):
    schema = "verdict string, " + ", ".join(f"{c} string" for c in (*CORE, "cwe_id", "invariant")) + f", affected_paths array<string>, evidence array<struct<{ANCHOR.replace(' ', ':').replace(',:', ',')}>>, commit_sha string, parent_sha string"
    anchor = dict(revision="commit", revision_sha=SHA, path="x.c", start_line=1, end_line=2, quoted_span="q", supports=ALL_CLAIMS)
    good = dict(verdict="YES", **{c: "x" for c in CORE}, cwe_id=None, invariant=None, affected_paths=["x.c"], evidence=[anchor], commit_sha=SHA, parent_sha=OTHER)
    return row(spark, schema, **{**good, **{k: (v(anchor) if callable(v) else v) for k, v in over.items()}}).select(contracts.finding_problems(F.col).alias("p")).first()["p"]


def test_finding(spark):
    assert finding(spark) == []
    assert finding(spark, impact=None) == ["YES lacks fields"]
    assert finding(spark, cwe_id="CWE-1") == ["claims without anchor"]
    assert finding(spark, affected_paths=["x.c", "y.c"]) == ["paths without anchor"]
    assert finding(spark, evidence=lambda a: [{**a, "revision_sha": OTHER}]) == ["anchor of another commit"]
    assert finding(spark, evidence=lambda a: [{**a, "revision": "parent", "revision_sha": OTHER}]) == []
    assert finding(spark, verdict="NO") == ["positive fields without YES"]
    assert finding(spark, verdict="ABSTAIN", **{c: None for c in CORE}, affected_paths=[], evidence=[]) == []


def test_label(spark):
    schema = "record_type string, status string, commit_sha string, independent boolean, source_record_hashes array<string>, source_annotators array<string>, role string, rationale string, verdict string, abstain_reason string, affected_paths array<string>, evidence array<string>, " + ", ".join(f"{c} string" for c in (*CORE, "cwe_id", "invariant"))
    base = dict(record_type="annotation", status="frozen", commit_sha=SHA, independent=True, source_record_hashes=[], source_annotators=[], role="other", rationale="r", verdict="NO", abstain_reason=None, affected_paths=[], evidence=[], **dict.fromkeys((*CORE, "cwe_id", "invariant")))
    check = lambda **over: row(spark, schema, **{**base, **over}).select(contracts.label_problems(F.col).alias("p")).first()["p"]
    assert check() == [] and check(status="draft", verdict=None, role=None) == []
    assert check(role="fix") == ["NO of another role"]
    assert check(verdict="ABSTAIN") == ["ABSTAIN needs a reason"]
    assert check(verdict="YES", role="fix", affected_paths=["a"], evidence=["b"], **dict.fromkeys(CORE, "x")) == []
    assert check(verdict="YES", role="fix") == ["YES lacks fields", "YES lacks paths or evidence"]
    h = "sha256:" + "0" * 64
    assert check(record_type="adjudication", independent=False, source_record_hashes=[h, h], source_annotators=["a", "b"]) == []
    assert check(record_type="adjudication", independent=False, source_record_hashes=[h], source_annotators=["a"]) == ["adjudication needs two sources"]


def test_decision(spark):
    schema = "status string, verdict string, error string, chunks array<struct<index:int,status:string,verdict:string>>"
    check = lambda *v: row(spark, schema, **dict(zip(("status", "verdict", "error", "chunks"), v, strict=True))).select(contracts.decision_problems(*[F.col(c) for c in ("status", "verdict", "error", "chunks")]).alias("p")).first()["p"]
    yes, no, bad = (0, "valid", "YES"), (1, "valid", "NO"), (1, "malformed", None)
    assert check("valid", "YES", None, [yes, no]) == [] and check("partial", "YES", "e", [yes, bad]) == []
    assert check("valid", "NO", None, [yes, no]) == ["verdict against chunks"]
    assert check("partial", "YES", "e", [yes, no]) == ["partial needs a YES and a failed chunk"]
    assert check("malformed", None, "e", [bad[:0] + (0, *bad[1:])]) == []
    assert check("valid", "NO", None, []) == ["valid needs valid chunks only"]


def test_chunks(spark):
    d = spark.createDataFrame([("valid", "YES", None), ("valid", None, None), ("malformed", None, "e"), ("malformed", "NO", "e"), ("odd", None, "e")], "s string, v string, e string")
    assert [len(r["p"]) for r in d.select(contracts.chunk_problems(F.col("s"), F.col("v"), F.col("e")).alias("p")).collect()] == [0, 1, 0, 1, 1]


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [one(calls.reset_seconds(lit(t))) for t in ("6m0s", "250ms", "1h", "-2", "soon", "")] == [360.0, 0.25, 3600.0, 0.0, None, None]
    assert one(calls.same_revision(lit("ABCDEF1"), lit("abcdef1234"))) and not one(calls.same_revision(lit("abcdef"), lit("abcdef1")))
    assert [one(calls.clock(lit(s))) for s in (59.9, 3600.0, -1.0)] == ["00:59", "1:00:00", "00:00"]
    assert [one(calls.throughput(lit(d), lit(10.0))) for d in (25, 1, 0)] == ["2.5/s", "6.0/min", None]
    assert one(calls.archetype(F.array(lit("cmd/x"), lit("http")))) == "cli" and one(calls.archetype(F.array(lit("lexer.c")))) == "parser"
    assert one(calls.usage_tokens(lit(None).cast("long"), lit(3), lit(4))) == 7 and one(calls.usage_cost(lit(float("nan")))) == 0.0
    assert one(calls.json_answer(lit("```json\n{\"k\": 1}\n```"), "k int"))["k"] == 1 and one(calls.json_answer(lit("[1]"), "k int")) is None


def slots(spark, used, cost, cap):
    x = spark.createDataFrame([(used, 0, cost)], "calls long, tokens long, cost double")
    return x.select(runs.call_slots(runs.Limits(cost=cap), 8, F.col("calls"), F.col("tokens"), F.col("cost")).alias("s")).first()["s"]


def test_budgets(spark):
    assert [slots(spark, 9, 9.0, 10.0), slots(spark, 9, 10.0, 10.0), slots(spark, 9, 9.0, 1000.0), slots(spark, 0, 0.0, 10.0), slots(spark, 9, 9.0, None)] == [1, 0, 8, 1, 8]
    with pytest.raises(ValueError, match="cost"):
        runs.Limits(cost=-1.0)


def test_run_stage(spark, tmp_path):
    at = str(tmp_path / "results")
    items = spark.createDataFrame([(f"k{i}", i) for i in range(12)], "key string, n int")

    def call(r):
        if r["n"] == 5:
            raise ValueError("broken")
        return {"verdict": "YES" if r["n"] % 2 else "NO", "tokens": 10, "cost": 0.5}

    first = runs.run_stage(items, call, at, "c1", runs.Limits(tokens=45), batch=4)
    assert first["status"] == "budget_exhausted" and 4 <= first["calls"] <= 6
    rest = runs.run_stage(items, call, at, "c1")
    assert (rest["status"], rest["calls"], rest["errors"], rest["tokens"]) == ("completed_with_errors", 12, 1, 110)
    assert runs.stored(spark, at).where("config = 'c1'").select("key").distinct().count() == 12
    assert runs.run_stage(items, call, at, "c1") == rest
    assert runs.run_stage(items.limit(0), call, at, "c2")["status"] == "completed"


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, None)], "id int, tags array<string>")
    same = spark.createDataFrame([(2, None), (1, ["a", "b"])], "id int, tags array<string>")
    h = lambda d: splits.dataset_hash(d).first()["dataset_hash"]
    assert h(rows) == h(same) != h(rows.union(rows)) and splits.dataset_hash(rows.limit(0)).first()["rows"] == 0
    a = spark.createDataFrame([("r2", "g", "holdout"), ("r1", "h", "development")], "record string, group string, split string")
    splits.write_manifest(a, rows, str(tmp_path), "grouped_hash", seed="s")
    head = spark.read.json(f"{tmp_path}/manifest").first()
    assert (head["development"], head["holdout"], head["rows"]) == (1, 1, 2)
    with pytest.raises(ValueError, match="repeated record"):
        splits.write_manifest(a.union(a), rows, str(tmp_path), "temporal")
    with pytest.raises(ValueError, match="seed"):
        splits.write_manifest(a, rows, str(tmp_path), "grouped_hash")


def test_nulls_reach_a_stage_as_none(spark, tmp_path):
    items = spark.createDataFrame([("a", None), ("b", 7)], "key string, n long")
    told = runs.run_stage(items, lambda row: {"verdict": "YES" if row["n"] is None else "NO" if row["n"] == 7 and isinstance(row["n"], int) else "ERROR", "tokens": row["n"]}, f"{tmp_path}/r", "c")
    assert (told["yes"], told["no"], told["tokens"]) == (1, 1, 7)
