"""Transactions over several tables: two writers, crashes, snapshots, compaction and clearing, and the fold against writes one by one."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from prospector.operators import state
from prospector.sources import ledger


def rows(spark, name, values):
    table = spark.createDataFrame([], state.TABLES[name].schema)
    df = spark.createDataFrame(values, "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields if f.name in values[0]))
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in values[0]})


def walk(spark, *values):
    return rows(spark, "run_commits", [{"seq": k, "run": "r", "repository": "o", "sha": sha, "status": status, "triage_status": told} for k, (sha, status, told) in enumerate(values)])


def flat(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_the_fold_equals_writes_one_by_one(spark, tmp_path):
    r = random.Random(2)
    store = state.Store(spark, f"{tmp_path}/s")
    made = {
        "run_commits": lambda k: {"seq": k, "run": r.choice("ab"), "repository": "o", "sha": r.choice("cdef"), "position": r.choice([None, k]), "status": r.choice(["x", None]), "triage_status": r.choice(["YES", "NO", None]), "adjudication_status": r.choice(["NO", None])},
        "commits": lambda k: {"seq": k, "repository": "o", "sha": r.choice("cde"), "message": r.choice(["m", None, "n"]), "patch_id": r.choice([None, f"p{k}"])},
        "errors": lambda k: {"seq": k, "stage": r.choice("st"), "kind": "k", "message": r.choice("mn"), "repository": "o", "sha": r.choice(["c", None]), "run": "r", "config_hash": "h", "details": f"d{k}"},
    }
    by_hand = {n: spark.createDataFrame([], state.TABLES[n].schema) for n in made}
    for step in range(4):
        new = {n: rows(spark, n, [f(10 * step + k) for k in range(6)]) for n, f in made.items()}

        def work(w, new=new):
            for n, rs in new.items():
                w.write(n, rs)

        store.transact(work)
        by_hand = {n: state.written(n, by_hand[n], new[n]) for n in made}
        if step == 1:
            assert store.ledger.compact("run_commits") and store.ledger.compact("errors")
    for n in made:
        assert flat(store.read(n)) == flat(by_hand[n])


def test_two_writers(spark, tmp_path):
    store = state.Store(spark, f"{tmp_path}/s")
    other = state.Store(spark, f"{tmp_path}/s")
    tries, gate = [], threading.Barrier(2)

    def count_up(w):
        n = w.read("run_commits").count()
        tries.append(n)
        if len(tries) <= 2:
            gate.wait(60)  # both have read before either writes
        w.write("run_commits", walk(spark, (f"s{n}", "x", None)))

    both = [threading.Thread(target=s.transact, args=(count_up,)) for s in (store, other)]
    for t in both:
        t.start()
    for t in both:
        t.join(120)
    assert sorted(tries) == [0, 0, 1] and {r["sha"] for r in store.read("run_commits").collect()} == {"s0", "s1"}
    # appends that read nothing don't conflict, and the later commit wins
    a, b = store.ledger.transaction(), other.ledger.transaction()
    a.append("run_commits", walk(spark, ("s0", "first", "YES")))
    b.append("run_commits", walk(spark, ("s0", "second", None)))
    assert b.commit() + 1 == a.commit()
    assert [(r["status"], r["triage_status"]) for r in store.read("run_commits").where("sha = 's0'").collect()] == [("first", "YES")]
    # a table put whole must be the one that was seen
    a, b = store.ledger.transaction(), store.ledger.transaction()
    a.put("run_commits", walk(spark, ("z", "whole", None)))
    b.append("run_commits", walk(spark, ("y", "more", None)))
    b.commit()
    with pytest.raises(ledger.Conflict):
        a.commit()
    assert store.read("run_commits").count() == 3


def test_a_crash_between_tables_shows_nothing(spark, tmp_path):
    store = state.Store(spark, f"{tmp_path}/s")
    store.write("run_commits", walk(spark, ("a", "x", None)))

    def work(w):
        w.write("run_commits", walk(spark, ("b", "x", None)))
        raise OSError("lost")

    with pytest.raises(OSError):
        store.transact(work)
    with pytest.raises(OSError), store.ledger.transaction() as t:
        t.append("run_commits", walk(spark, ("b", "x", None)))
        raise OSError("lost")
    assert store.ledger.version() == 1 and store.read("run_commits").count() == 1
    assert store.ledger.vacuum(seconds=0) == 2  # what the two left behind
    assert store.read("run_commits").count() == 1


def test_snapshots_compaction_and_vacuum(spark, tmp_path):
    store = state.Store(spark, f"{tmp_path}/s")
    for k in range(3):
        store.write("run_commits", walk(spark, ("a", f"v{k}", None), (f"n{k}", "x", "NO")))
    before = store.read("run_commits", 1)
    late = store.ledger.transaction()  # a compaction that another writer runs ahead of
    late.put("run_commits", late.ledger.rows("run_commits", late.seen), whole=True, same=True)
    assert store.ledger.compact("run_commits")
    with pytest.raises(ledger.Conflict):
        late.commit()
    store.write("run_commits", walk(spark, ("a", "v3", None)))
    assert len(store.ledger.commit(store.ledger.version())["tables"]["run_commits"]["parts"]) == 2
    assert {(r["sha"], r["status"]) for r in store.read("run_commits").collect()} == {("a", "v3"), ("n0", "x"), ("n1", "x"), ("n2", "x")}
    assert {(r["sha"], r["status"]) for r in before.collect()} == {("a", "v0"), ("n0", "x")}  # its folders are still there
    assert store.ledger.vacuum(seconds=3600) == 4  # commit files; folders are too young
    assert store.ledger.vacuum(seconds=0) == 4 and store.read("run_commits").count() == 4
    monkey = state.FOLDERS
    try:
        state.FOLDERS = 2
        store.write("run_commits", walk(spark, ("a", "v4", None)))
    finally:
        state.FOLDERS = monkey
    last = store.ledger.commit(store.ledger.version())["tables"]["run_commits"]["parts"]
    assert len(last) == 1 and store.read("run_commits").where("sha = 'a'").first()["status"] == "v4"


def test_a_name_is_taken_once_on_any_file_system(spark, tmp_path):
    files = ledger.Files(spark, f"{tmp_path}/l")
    assert files.claim(f"{tmp_path}/l/c", "1.json", "{}") and not files.claim(f"{tmp_path}/l/c", "1.json", "[]")
    files.local = None  # the way of other file systems
    assert files.claim(f"{tmp_path}/l/c", "2.json", "{}") and not files.claim(f"{tmp_path}/l/c", "2.json", "[]")
    assert files.text(f"{tmp_path}/l/c/2.json") == files.text(f"{tmp_path}/l/c/1.json") == "{}"
    assert sorted(n for n, _ in files.names(f"{tmp_path}/l/c") if n[0] != ".") == ["1.json", "2.json"]
