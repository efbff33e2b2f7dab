"""Streams that go on where they stopped: commits of a growing repository, and the latest record of each key of a log."""

import datetime as dt
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from prospector.sources import git
from prospector.streaming import latest


class Repo:
    def __init__(self, at):
        self.at, self.now = str(at), 1_700_000_000
        subprocess.run(["git", "init", "-q", "-b", "main", self.at], check=True)

    def run(self, *args):
        self.now += 60
        who = {f"GIT_{a}_{b}": v for a in ("AUTHOR", "COMMITTER") for b, v in (("NAME", "n"), ("EMAIL", "e@x"), ("DATE", f"{self.now} +0000"))}
        return subprocess.run(["git", "-C", self.at, *args], check=True, capture_output=True, env=os.environ | who).stdout.decode().strip()

    def commit(self, name, text):
        with open(f"{self.at}/{name}", "w") as f:
            f.write(text)
        self.run("add", "-A")
        self.run("commit", "-qm", f"{name} {text}")
        return self.run("rev-parse", "HEAD")


def test_commits_of_a_growing_repository(spark, tmp_path):
    repo = Repo(tmp_path / "r")
    git.register(spark)
    batches = []

    def take(**options):
        """Shas of each batch of one run of the stream."""
        before = len(batches)

        def keep(batch, number):
            batches.append([r["sha"] for r in batch.orderBy("place").select("sha").collect()])

        rows = spark.readStream.format("git_commits").option("path", repo.at).options(**options).load()
        rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return [b for b in batches[before:] if b]

    first = [repo.commit("a", str(k)) for k in range(5)]
    assert take(slice=2) == [first]  # oldest first, over three partitions
    assert take() == []  # a restart reads nothing twice
    repo.run("checkout", "-q", "-b", "side")
    side = [repo.commit("b", str(k)) for k in range(3)]
    repo.run("checkout", "-q", "main")
    main = repo.commit("a", "more")
    repo.run("merge", "-q", "--no-ff", "-m", "merge", "side")
    got = take()
    assert len(got) == 1 and sorted(got[0]) == sorted([*side, main, repo.run("rev-parse", "HEAD")]) and got[0][-1] == repo.run("rev-parse", "HEAD")
    repo.run("branch", "-D", "side")
    repo.run("branch", "again", side[0])  # old history under a new name
    assert take() == []
    repo.run("checkout", "-q", "main")
    repo.run("reset", "-q", "--hard", first[-1])
    moved = repo.commit("c", "other line")
    assert take() == [[moved]]
    repo.run("reflog", "expire", "--expire=now", "--all")
    repo.run("gc", "-q", "--prune=now")  # the heads before are no longer there
    last = repo.commit("c", "last")
    assert take() == [[last]]
    every = [s for b in batches for s in b]
    assert len(every) == len(set(every)) == 5 + 5 + 1 + 1


def test_what_an_offset_plans(tmp_path):
    repo = Repo(tmp_path / "r")
    shas = [repo.commit("a", str(k)) for k in range(7)]
    reader = git.GitStream({"path": repo.at, "slice": "3", "after": shas[1]})
    assert reader.initialOffset() == {"heads": shas[1]}
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [(p.shas, p.place) for p in parts] == [(shas[2:5], 0), (shas[5:], 3)]
    assert [r[0] for r in reader.read(parts[1])] == shas[5:]
    assert reader.partitions(reader.latestOffset(), reader.latestOffset()) == []
    gone = {"heads": f"{'0' * 40} {shas[4]}"}
    assert [p.shas for p in reader.partitions(gone, reader.latestOffset())] == [shas[5:]]
    with pytest.raises(ValueError):
        git.GitStream({"path": repo.at, "refs": "--all"})


SCHEMA = "k string, seq long, v string, ts timestamp"


def log(spark, path, *rows):
    base = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    spark.createDataFrame([(k, seq, v, base + dt.timedelta(minutes=m)) for k, seq, v, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_latest_of_a_log(spark, tmp_path):
    path, table, at = f"{tmp_path}/log", f"{tmp_path}/t", f"{tmp_path}/c"
    run = lambda **more: latest.run_now(latest.latest_rows(spark.readStream.schema(SCHEMA).parquet(path), ["k"], **more), table, at)
    told = lambda batch: sorted((r["k"], r["seq"], r["outcome"]) for r in spark.read.parquet(f"{table}/batch={batch}").collect())
    known = spark.createDataFrame([("old", 5, "before", None), ("old", 4, "older", None)], SCHEMA)
    log(spark, path, ("a", 1, "x", 0), ("a", 3, "y", 0), ("a", 2, "z", 0), ("old", 5, "same", 0), ("b", 1, None, 0))
    run(initial=known)
    assert told(0) == [("a", 1, "late"), ("a", 2, "late"), ("a", 3, "new"), ("b", 1, "new"), ("old", 5, "late")]
    log(spark, path, ("a", 2, "late", 0), ("b", 2, "w", 0), ("b", 2, "again", 0), ("old", 6, "now", 0))
    run(initial=known)
    assert told(1)[0] == ("a", 2, "late") and [x for x in told(1) if x[2] != "late"] == [("b", 2, "changed"), ("old", 6, "changed")]
    run(initial=known)  # nothing new, nothing done
    got = {r["k"]: (r["seq"], r["v"]) for r in latest.current(spark, table, ["k"]).collect()}
    assert got["a"] == (3, "y") and got["old"] == (6, "now") and got["b"][0] == 2 and got["b"][1] in ("w", "again") and len(got) == 3


def test_keys_are_dropped_after_a_time(spark, tmp_path):
    path, table, at = f"{tmp_path}/log", f"{tmp_path}/t", f"{tmp_path}/c"

    def run(*rows):
        log(spark, path, *rows)
        out = latest.latest_rows(spark.readStream.schema(SCHEMA).parquet(path), ["k"], at="ts", late="1 minute", ttl_ms=10 * 60_000)
        latest.run_now(out, table, at)
        return {r["k"]: r["seq"] for r in latest.current(spark, table, ["k"]).collect()}

    assert run(("a", 1, "x", 0), ("b", 1, "x", 5)) == {"a": 1, "b": 1}
    assert run(("b", 2, "y", 9)) == {"a": 1, "b": 2}
    assert run(("c", 1, "z", 14)) == {"b": 2, "c": 1}  # a's ten minutes are over, b's last record is younger
    assert run(("a", 2, "back", 15)) == {"a": 2, "b": 2, "c": 1}
    outcomes = {(r["k"], r["outcome"]) for r in spark.read.parquet(table).select("k", "outcome").where(F.col("k") == "a").collect()}
    assert outcomes == {("a", "new"), ("a", "dropped")}
    with pytest.raises(ValueError):
        latest.latest_rows(spark.readStream.schema(SCHEMA).parquet(path), ["k"], ttl_ms=1)
