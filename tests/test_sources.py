"""Repositories, stores, symbols and the command line."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from prospector import __main__ as cli
from prospector.functions.contracts import CORE_FIELDS
from prospector.operators import symbols
from prospector.sources import git, stores


def judge(row):
    return {"verdict": "YES" if "fix" in row["message"] else "NO", "tokens": 2, "cost": 0.0}


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "r"
    at.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(at), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    (at / "a.txt").write_text("one\ntwo\nthree\nfour\nfive\n")
    (at / "big").write_text("x" * 100)
    run("add", "."), run("commit", "-qm", "root")
    run("mv", "a.txt", "b.txt"), run("commit", "-qm", "rename")
    (at / "b.txt").write_text("one\n2\nthree\nfour\nfive\n")
    run("commit", "-qam", "fix two")
    return str(at)


def test_repository(spark, repo):
    git.register(spark)
    read = lambda kind, **o: spark.read.format(kind).option("path", repo).options(**o).load()
    files = {r["path"]: r for r in read("git_files", max_bytes=50).collect()}
    assert set(files) == {"b.txt", "big"} and files["big"]["content"] is None and files["big"]["size"] == 100 and bytes(files["b.txt"]["content"]).startswith(b"one\n2\n")
    assert [r["path"] for r in read("git_files", prefix="b.").collect()] == ["b.txt"]
    with pytest.raises(Exception, match="more than 1"):
        read("git_files", max_paths=1).collect()
    history = sorted(map(tuple, read("git_history", file="b.txt").select("seq", "subject", "path", "old_path").collect()))
    assert history == [(0, "fix two", "b.txt", None), (1, "rename", "b.txt", "a.txt"), (2, "root", "a.txt", None)]
    log = {r["message"]: r for r in read("git_commits", patch_ids="true").collect()}
    assert len(log["fix two"]["patch_id"]) == 40
    blame = read("git_blame", file="b.txt", start=1, end=900).orderBy("line").collect()
    assert [(r["line"], r["text"]) for r in blame][:2] == [(1, "one"), (2, "2")] and len(blame) == 5
    assert blame[0]["sha"] == log["root"]["sha"] and blame[1]["sha"] == log["fix two"]["sha"]
    assert git.default_branch(repo) == "main" and git.canonical_source(repo).startswith("file://")


def one_by_one(repo, sha):
    """A commit by several processes, against its first parent."""
    parents = git.git(repo, "show", "-s", "--format=%P", sha).decode().split()
    against = [parents[0], sha] if parents else ["4b825dc642cb6eb9a060e54bf8d69288fbee4904", sha]
    return parents, git.git(repo, "show", "-s", "--format=%B", sha).decode().rstrip("\n"), git.git(repo, "diff", "-M", "--binary", "--full-index", *against)


def test_stream_is_what_single_commits_say(spark, repo):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", repo, *a], check=True, capture_output=True)
    run("checkout", "-qb", "side", "HEAD~1"), run("commit", "-qm", "empty\n\nbody \u00e9", "--allow-empty")
    with open(f"{repo}/bin", "wb") as f:
        f.write(bytes(range(256)))
    run("add", "."), run("commit", "-qm", "binary"), run("checkout", "-q", "main"), run("merge", "-q", "--no-ff", "-m", "merge side", "side")
    git.register(spark)
    got = spark.read.format("git_commits").option("path", repo).option("slice", 2).load().orderBy("place").collect()
    shas = git.git(repo, "rev-list", "--topo-order", "--date-order", "HEAD").decode().split()
    assert [r["sha"] for r in got] == shas and len(shas) == 6
    for r in got:
        assert (list(r["parents"]), r["message"], bytes(r["patch"])) == one_by_one(repo, r["sha"]) and not r["truncated"]
    paths = {r["message"]: [(p["status"], p["path"], p["old_path"]) for p in r["changed_paths"]] for r in got}
    assert paths["rename"] == [("R100", "b.txt", "a.txt")] and paths["merge side"] == [("A", "bin", None)] == paths["binary"]
    short = spark.read.format("git_commits").option("path", repo).option("max_patch_bytes", 60).load().collect()
    assert {r["message"]: r["truncated"] for r in short}["root"] and all(len(r["patch"]) <= 60 for r in short)
    assert git.commit_at(spark, repo, "HEAD~1", patches=False).select("message", "patch").first()["patch"] == b""
    assert git.snapshot(repo, "/nowhere")["head_sha"] == shas[0] == git.resolve(repo, "main")
    for bad in ({"last": "0"}, {"range": "a..b", "revision": "c"}, {"since": "-x"}):
        with pytest.raises(ValueError):
            git.GitReader({"path": repo, **bad})


def test_frames_at_any_cut():
    mark = git.BEGIN
    stream = b"noise" + mark + b"one" + mark + b"" + mark + b"x" * 50 + mark[:4] + mark + b"y" * 9 + mark + b"z" * 30
    want = [(b"one", False), (b"", False), (b"x" * 20, True), (b"y" * 9, False), (b"z" * 20, True)]
    for n in range(1, len(stream) + 1):
        assert list(git.frames((stream[k : k + n] for k in range(0, len(stream), n)), 20)) == want, n
    assert list(git.frames([], 9)) == [] == list(git.frames([b"noise"], 9))


def test_mirror(repo, tmp_path, monkeypatch):
    monkeypatch.setattr(git, "canonical_source", lambda s: s)
    place = git.mirror(repo, f"{tmp_path}/m")
    assert place.endswith(".git") and git.resolve(place, "main") == git.resolve(repo, "main") and git.mirror(repo, f"{tmp_path}/m") == place


def test_source_names():
    assert git.canonical_source("HTTPS://Example.ORG:8443/a/b/") == "https://example.org:8443/a/b"
    assert git.canonical_source("git@host.org:a/b.git") == "git@host.org:a/b.git" and git.canonical_source("ssh://u@H.org/a") == "ssh://u@h.org/a"
    assert len(git.source_key("https://example.org/a")) == 64
    for bad in ("", "a\nb", "ftp://x/y", "https://u:p@x/y", "https://u@x/y", "https://x/y?q=1", "https://x/", "nowhere"):
        with pytest.raises(ValueError):
            git.canonical_source(bad)


def test_blobs(spark, tmp_path):
    at = str(tmp_path / "blobs")
    for _ in range(2):
        stores.put_blobs(spark.createDataFrame([("x",), ("x",), ("yy",), (None,), ("",)], "content string"), at)
    rows = spark.read.parquet(at)
    assert rows.count() == 3
    got = stores.get_blobs(spark, at, rows.select("hash"), most=1).orderBy("size").collect()
    assert [(r["size"], r["content"] and bytes(r["content"])) for r in got] == [(0, bytearray()), (1, b"x"), (2, None)]


def test_label_log(spark, tmp_path):
    schema = "repository string, annotator_id string, record_type string, status string, commit_sha string, independent boolean, source_record_hashes array<string>, source_annotators array<string>, role string, rationale string, verdict string, abstain_reason string, affected_paths array<string>, evidence array<string>, " + ", ".join(f"{c} string" for c in (*CORE_FIELDS, "cwe_id", "invariant"))
    one = dict(repository="r", annotator_id="a", commit_sha="A" * 40, role="Other", rationale="x", status="frozen")
    put = lambda **over: stores.append_labels(spark.createDataFrame([{**dict.fromkeys(x.split()[0] for x in schema.split(", ")), **one, "evidence": [], **over}], schema), str(tmp_path / "log"))
    put(), put(annotator_id="b")
    with pytest.raises(ValueError, match="NO of another role"):
        put(role="fix", verdict="no")
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(log) == 2 and {r["verdict"] for r in log} == {"NO"} and log[0]["record_id"] != log[1]["record_id"] and log[0]["commit_sha"] == "a" * 40


def test_symbols(spark):
    py = "import x\nclass A:\n    def f(self):\n        pass\n\n    def g(self):\n        return h(1)\ndef top():\n    pass\n"
    go = "package p\nfunc (s *T) Run(a int) {\n  return\n}\n"
    c = "#include\nstatic int parse(char *p) {\n  if (p) return f(p);\n}\n"
    files = spark.createDataFrame([("m.py", py), ("m.go", go), ("m.c", c)], "path string, text string")
    places = spark.createDataFrame([("m.py", 1), ("m.py", 4), ("m.py", 7), ("m.py", 9), ("m.go", 3), ("m.c", 3), ("gone", 1)], "path string, line int")
    got = {(r["path"], r["line"]): (r["symbol"], r["kind"], r["start_line"]) for r in symbols.enclosing(places, files).collect()}
    assert got[("m.py", 1)] == got[("gone", 1)] == ("<file>", "file", 1)
    assert got[("m.py", 4)] == ("A.f", "function", 3) and got[("m.py", 7)] == ("A.g", "function", 6) and got[("m.py", 9)] == ("top", "function", 8)
    assert got[("m.go", 3)] == ("Run", "function", 2) and got[("m.c", 3)] == ("parse", "function", 2)
    d = spark.createDataFrame([(["s"], "f(1)"), ([], "if(x) strcpy(a) os.system(b) strcpy(c)")], "d array<string>, t string")
    assert [r["x"] for r in d.select(symbols.sinks(F.col("d"), F.col("t")).alias("x")).collect()] == [["s"], ["strcpy", "os.system"]]


def test_command_line(spark, repo, tmp_path, capsys):
    told = lambda: json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    store = str(tmp_path / "results")
    load = ["import", "--repo", repo, "--store", store, "--stage", "tests.test_sources:judge"]
    assert cli.main([*load, "--dry-run"]) == 0 and told() == {"status": "dry_run", "planned": 3}
    assert cli.main([*load, "--max-calls", "1"]) == 3 and told()["calls"] == 1
    assert cli.main(load) == 0 and told()["yes"] == 1
    assert cli.main(["status", "--store", store]) == 0 and told()["calls"] == 3
    assert cli.main(["export", "--store", store, "--out", f"{tmp_path}/out"]) == 0 and spark.read.json(f"{tmp_path}/out").count() == 3
    assert cli.main(["queries"]) == 0 and "binary_summary" in capsys.readouterr().out
    assert cli.main(["query", "nothing", "--data", "x"]) == 2
    assert cli.main(["query", "split_counts", "--data", "/root/testdata/sf0.001", "--out", f"{tmp_path}/q"]) == 0 and spark.read.parquet(f"{tmp_path}/q").count() == 3
