"""Scan, score and ablate from the command line over a repository and a corpus made here."""

import json
import subprocess

from prospector import __main__ as cli
from prospector.sources import git, records
from tests.test_streams import Repo


def triage(row):
    return "safe" in row["diff"]


def adjudicate(row):
    quote = {"revision": "commit", "revision_sha": row["sha"], "path": "src/x.py", "start_line": 1, "end_line": 1, "quoted_span": "safe(x)"}
    return {"verdict": "YES" if "fix" in row["message"] else "NO", "l0_class": "injection", "severity": "high", "affected_paths": ["src/x.py"], "evidence": [quote], "invariant": "x is safe"}


def backend(text):
    return "YES" if "safe" in text else "NO"


def test_scan_and_score(spark, tmp_path, capsys):
    repo = Repo(tmp_path / "o" / "r")
    subprocess.run(["mkdir", "-p", f"{repo.at}/src"], check=True)
    start = repo.commit("src/x.py", "x\n")
    other = repo.commit("src/y.py", "unsafe thing\n")
    fix = repo.commit("src/x.py", "safe(x)\n")
    repo.run("commit", "--amend", "-qm", "fix x")
    fix = repo.run("rev-parse", "HEAD")
    head = repo.commit("README.md", "safe words\n")
    blobs = {(r["sha"], r["path"]): r["content"] for r in git.blobs_at(spark.createDataFrame([(start, "src/x.py"), (fix, "src/x.py"), (fix, "none"), (fix, "src"), ("0" * 40, "a"), (None, "a"), (fix, "a\nb")], "sha string, path string"), repo.at).collect()}
    assert blobs[start, "src/x.py"] == "x\n" and blobs[fix, "src/x.py"] == "safe(x)\n" and [v for k, v in blobs.items() if v is None].__len__() == 5
    out = f"{tmp_path}/context"
    assert cli.main(["scan", "--repo", repo.at, "--triage", "tests.test_commands:triage", "--adjudicate", "tests.test_commands:adjudicate", "--out", out]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["funnel"]["prefilter.admitted"] == 3 and told["funnel"]["review.yes"] == 1 and told["funnel"]["review.no"] == 1
    context = json.loads(spark.read.text(out, wholetext=True).first()[0])
    assert [f["commit_sha"] for f in context["fingerprints"]] == [fix] and context["repo"]["head_sha"] == head and context["commits_scanned"] == 4
    assert [tuple(r) for r in records.read_emitted(spark, out).collect()] == [("o/r", fix)]
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps({"entries": [{"sha": fix.upper(), "repo": "o/r", "role": "fix"}, {"sha": other, "repo": "o/r", "role": "fix"}]}))
    assert cli.main(["score", "--contexts", out, "--truth", str(truth), "--json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert {r["repository"]: (r["tp"], r["fp"], r["missed"], r["recall"]) for r in rows} == {"o/r": (1, 0, 1, 0.5), "total": (1, 0, 1, 0.5)}
    assert cli.main(["score", "--contexts", out, "--truth", str(truth)]) == 0 and "TOTAL" in capsys.readouterr().out


def test_ablate(spark, tmp_path, capsys):
    root = tmp_path / "corpus"
    (root / "d").mkdir(parents=True)
    lines = []
    for k in range(40):
        (root / f"d/{k}").write_text(f"diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-x\n+{'safe' if k % 2 else 'plain'} {k}\n")
        lines.append({"ghsa_id": f"G{k}", "repo": "o/r", "sha": f"{k:040x}", "subject": "tidy up", "message": "tidy up", "role": "fix" if k % 2 else "other", "diff_path": f"d/{k}"})
    (root / "commits.jsonl").write_text("\n".join(map(json.dumps, lines)))
    args = ["ablate", "--corpus", str(root), "--backend", "tests.test_commands:backend", "--cache", f"{tmp_path}/cache", "--profiles", "D0,D1", "--out", f"{tmp_path}/out"]
    code = cli.main(args)
    told = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [(r["profile"], r["recall"], r["fpr"], r["coverage"]) for r in told[:2]] == [("D0", 1.0, 0.0, 1.0), ("D1", 1.0, 0.0, 1.0)]
    assert code == (0 if told[2]["selected"] else 4) and told[2]["fallback"] in ("D0", "D1")
    assert cli.main(args) == code  # from the cache
    assert spark.read.json(f"{tmp_path}/out").agg({"calls": "sum"}).first()[0] == 0
