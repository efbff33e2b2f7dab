"""A repository's way into a store, stopped by budgets and gone on with, and the reports."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from prospector import __main__ as cli
from prospector.operators import evaluation, importing, runs, state


def ask(row):
    if "boom" in row["message"]:
        raise ValueError("no answer")
    return {"verdict": "YES" if "fix" in row["message"] else "NO", "usage": {"total_tokens": 10, "estimated_cost": 1.0}}


def judge(row, repository):
    return {"verdict": "YES" if "+safe" in row["diff"] else "ABSTAIN", "usage": {"total_tokens": 5}, "l0_class": "injection"}


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "r"
    at.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(at), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for k, message in enumerate(("root", "fix one", "boom", "fix two")):
        (at / f"f{k}").write_text("safe\n" if k == 1 else "x\n")
        run("add", "."), run("commit", "-qm", message)
    return str(at)


def test_import(spark, repo, tmp_path):
    store = state.Store(spark, f"{tmp_path}/s")
    make = lambda **limits: importing.Import(store, repo, f"{tmp_path}/m", ask, judge, limits=runs.Limits(**limits))
    dry = make().go(dry_run=True)
    assert (dry["status"], dry["planned"], dry["calls"]) == ("dry_run", 4, 0)
    first = make(cost=1.5).go()
    assert first["status"] == "budget_exhausted" and first["created"] and 1 <= first["calls"] < 7
    rest = make().go()
    assert (rest["status"], rest["created"], rest["run"]) == ("completed_with_errors", False, first["run"])
    assert (rest["calls"], rest["tokens"]) == (7, 45)  # four asked, three candidates judged
    assert make().go()["calls"] == 7  # nothing is asked again
    assert {r["verdict"]: r["count"] for r in store.read("triage_results").groupBy("verdict").count().collect()} == {"YES": 2, "NO": 1, "ERROR": 1}
    assert store.read("findings").count() == 1 and [r["kind"] for r in store.read("errors").collect()] == ["ValueError"]
    rows = {r["position"]: (r["triage_status"], r["adjudication_status"]) for r in store.read("run_commits").where(F.col("run") == first["run"]).collect()}
    assert rows == {0: ("YES", "ABSTAIN"), 1: ("ERROR", "ABSTAIN"), 2: ("YES", "YES"), 3: ("NO", None)}
    assert store.export("triage", f"{tmp_path}/t", first["run"]) == 4 and store.export("findings", f"{tmp_path}/f") == 1
    other = importing.Import(store, repo, f"{tmp_path}/m", ask, judge, {"temperature": 1})
    assert other.config != make().config


def test_command_line(spark, repo, tmp_path, capsys):
    base = ["--store", f"{tmp_path}/s"]
    args = ["review", "--repo", repo, *base, "--mirrors", f"{tmp_path}/m", "--triage", "tests.test_importing:ask", "--adjudicate", "tests.test_importing:judge", "--last", "1"]
    assert cli.main([*args, "--dry-run"]) == 0 and cli.main(args) == 0
    told = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (told["status"], told["planned"], told["calls"]) == ("completed", 1, 2)
    assert cli.main(["runs", *base, "--run", told["run"]]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["status"] == "completed" and shown["triaged"] == shown["adjudicated"] == 1
    assert cli.main(["write", *base, "--kind", "triage", "--out", f"{tmp_path}/t", "--run", told["run"]]) == 0 and json.loads(capsys.readouterr().out) == {"kind": "triage", "rows": 1}
    with pytest.raises(ValueError):
        cli.loaded("nothing")


def test_reports(spark):
    judged = spark.createDataFrame([("b" * 40, "s", "YES", None, [], None, 0.5, None), ("a" * 40, "t", "ABSTAIN", "no_signal", [], None, None, None), ("c" * 40, "u", "ABSTAIN", "odd\nreason", ["x"], "raw", None, None), ("d" * 40, "v", "ERROR", None, [], None, None, "Trace\nValueError: v")], "sha string, subject string, verdict string, reason string, validation_errors array<string>, raw_output string, cost double, traceback string")
    report = importing.debug_report(judged, spark.createDataFrame([("e", "down")], "sha string, error string"), 2.04)
    assert report["summary"] == {"adjudicated": 4, "findings": 1, "rejected": 0, "abstained": 2, "errors": 1, "triage_errors": 1, "suspect_reasons": 1, "abstain_reasons": {"no_signal": 1, "odd\nreason": 1}, "estimated_cost_usd": 0.5, "wall_clock_s": 2.0}
    text = importing.debug_markdown(report)
    assert "- findings: 1" in text and "`cccccccccccc` u: odd\nreason (suspect)" in text and "ValueError: v" in text
    truth = spark.createDataFrame([("r", "1", "fix"), ("r", "2", "context"), ("r", "3", "fix")], "repository string, sha string, role string")
    table = importing.score_table(evaluation.score_truth(spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "9")], "repository string, sha string"), truth)).split("\n")
    assert table[2] == "r                          3    1    1     1     1    50%     50%" and table[-1].startswith("TOTAL                           1    1")
