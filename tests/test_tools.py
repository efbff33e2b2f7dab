"""A reviewer's bounded reads, and static analysis in arms."""

import pytest
from pyspark.sql import functions as F

from prospector.operators import analyzers, tools

P, C, H = "a" * 40, "b" * 40, "c" * 40


@pytest.fixture
def kit(spark):
    change = "array<struct<status:string,path:string,old_path:string>>"
    rows = [(H, 0, [C], "later\n", "t3", [("M", "z", None)], bytearray(b"+z")), (C, 1, [P], "fix it\n\nwhy", "t2", [("M", "src/x.py", None)], bytearray(b"+" * 40_000)), (P, 2, [], "root", "t1", [("A", "src/x.py", None)], bytearray(b"+x"))]
    commits = spark.createDataFrame(rows, f"sha string, place long, parents array<string>, message string, committer_time string, changed_paths {change}, patch binary")
    files = spark.createDataFrame([(C, "src/x.py", "one\n  two   2\n\nfour\n"), (C, "big", "y" * 40_000), (P, "src/x.py", "one"), (H, "src/x.py", "head")] + [(C, f"many/{k:03d}", "n") for k in range(60)], "sha string, path string, content string")
    blame = spark.createDataFrame([(C, "src/x.py", k, P) for k in (1, 2, 3)], "sha string, path string, line int, commit string")
    return tools.Tools(commits, files, blame, C)


def test_tools(kit):
    go = kit.execute
    assert go("show_commit", {})["message"] == "fix it\n\nwhy" and go("show_commit", {"revision": "parent"})["sha"] == P and go("show_commit", {"revision": "ccccccc"})["sha"] == H
    shown = go("show_diff", {"parent": "parent"})
    assert len(shown["diff"]) == tools.RESULT_BYTES and shown["truncated"]
    assert go("read_blob", {"path": "src/x.py"}).startswith("one\n")
    read = go("read_range", {"path": "src/x.py", "start_line": 2, "end_line": 99})
    assert read["lines"] == [{"n": 2, "text": "  two   2"}, {"n": 3, "text": ""}, {"n": 4, "text": "four"}]
    anchor = go("cite", {"path": "src/x.py", "start_line": 2, "end_line": 3, "supports": ["impact"]})["anchor"]
    assert anchor == {"revision": "commit", "revision_sha": C, "path": "src/x.py", "start_line": 2, "end_line": 3, "quoted_span": "two 2", "supports": ["impact"]} and list(kit.issued.values()) == [anchor]
    assert go("cite", {"revision": "head", "path": "src/x.py", "start_line": 1, "end_line": 1, "supports": ["severity"]})["anchor"]["revision"] == "head"
    assert go("search", {"query": "two", "path": "src/x.py"}) == [{"path": "src/x.py", "line": 2, "text": "  two   2"}]
    listed = go("list_paths", {"prefix": "many"})
    assert (listed["total"], listed["truncated"], len(listed["paths"]), listed["paths"][0]) == (60, True, 50, "many/000")
    assert [r["subject"] for r in go("history", {})] == ["fix it", "root"] and [r["sha"] for r in go("history", {"revision": "head", "path": "z"})] == [H]
    assert [r["line"] for r in go("blame", {"path": "src/x.py", "start_line": 2, "end_line": 9})] == [2, 3]
    bad = [
        ("rm", {}), ("show_commit", {"x": 1}), ("read_blob", {"path": "/etc/x"}), ("read_blob", {"path": "a/../b"}), ("read_blob", {"path": "big"}), ("read_blob", {"path": "none"}), ("show_commit", {"revision": "main"}),
        ("read_range", {"path": "x", "start_line": 1, "end_line": 401}), ("read_range", {"path": "x", "start_line": 0, "end_line": 1}), ("search", {"query": "q" * 501}), ("search", {"query": "q", "limit": 51}), ("linked_artifact", {"kind": "pr"}),
        ("cite", {"path": "src/x.py", "start_line": 1, "end_line": 4, "supports": ["impact"]}), ("cite", {"path": "src/x.py", "start_line": 3, "end_line": 3, "supports": ["impact"]}), ("cite", {"path": "src/x.py", "start_line": 1, "end_line": 1, "supports": ["magic"]}),
    ]
    for name, args in bad:
        with pytest.raises(ValueError):
            go(name, args)
    assert tools.Tools(kit.commits, kit.files, kit.blamed, C, "A1", lambda asked: asked).execute("linked_artifact", {"kind": "pr"}) == {"kind": "pr"}
    with pytest.raises(ValueError, match="root"):
        tools.Tools(kit.commits, kit.files, kit.blamed, P).execute("show_commit", {"revision": "parent"})


def test_analyzers(spark):
    diff = "diff --git a/x.py b/x.py\n@@ -1 +1 @@\n-a\n+go(1)\n@@ -5 +5 @@\n-# one\n+# two\n"
    there = analyzers.probe("t", ("no-such",), ("json",), now=lambda: 0.0)
    assert (there.available, there.module) == (True, "json") and not analyzers.probe("t", ("no-such",), ("no_such_module",)).available
    good = analyzers.ToolArm("runs", modules=("json",), run=lambda r: {"hits": [1, 2], "more": {"x": ["y"]}, "text": "abc"})

    def fail(request):
        raise OSError("gone")

    report = analyzers.ablation([analyzers.TextArm(), good, analyzers.ToolArm("idle", modules=("json",)), analyzers.ToolArm("absent", ("no-such",)), analyzers.ToolArm("fails", modules=("json",), run=fail)], diff)
    assert {n: a["status"] for n, a in report["arms"].items()} == {"text_baseline": "ok", "runs": "ok", "idle": "available_not_run", "absent": "unavailable", "fails": "error"}
    assert report["arms"]["text_baseline"]["results"]["changed_calls"] == ["go"] and report["arms"]["text_baseline"]["metrics"]["filtered_hunks"] == 1
    assert report["summary"]["total_result_count"] == 5 and report["summary"]["executed"] == ["text_baseline", "runs"] and report["summary"]["unavailable"] == ["absent"]
    row = analyzers.arms_table(spark, report).first()
    assert row["arm_count"] == 5 and row["total_result_count"] == 5 and list(row["executed"]) == ["text_baseline", "runs"]
    assert set(analyzers.availability_report()) == {"text_baseline", *analyzers.OPTIONAL}
    with pytest.raises(ValueError):
        analyzers.ablation([good, good], diff)
    hunks = spark.createDataFrame([(1, "x.py", 2, 2, ["-a", "+b"]), (2, "old.py", 2, 9, ["-# a"])], "seq int, path string, old_start int, new_start int, lines array<string>")
    text = spark.createDataFrame([("x.py", "def f():\n    pass\n")], "path string, text string")
    old = spark.createDataFrame([("old.py", "class K:\n    x = 1\n")], "path string, text string")
    got = {r["seq"]: (r["symbol"], r["side"], r["cosmetic_only"]) for r in analyzers.hunk_symbols(hunks, old, text).select("seq", "symbol", "side", "cosmetic_only").collect()}
    assert got == {1: ("f", "after", False), 2: ("K", "before", True)}
