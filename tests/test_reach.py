"""The chain index and what merges bring in, against walks commit by commit."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospector.operators import reach


def reached(parents, x):
    todo, seen = [x], set()
    while todo:
        y = todo.pop()
        if y not in seen:
            seen.add(y)
            todo += parents[y]
    return seen


def brute(parents, merge):
    return reached(parents, merge) - reached(parents, parents[merge][0]) - {merge}


def frames(spark, parents, name=lambda k: k):
    kind = "int" if isinstance(name(0), int) else "string"
    edges = spark.createDataFrame([(name(k), i, name(p)) for k, ps in parents.items() for i, p in enumerate(ps)], f"child {kind}, k int, parent {kind}")
    merges = spark.createDataFrame([(name(k), name(ps[0])) for k, ps in parents.items() if len(ps) > 1], f"merge {kind}, first_parent {kind}")
    return edges, merges, spark.createDataFrame([(name(k), k - 100) for k in parents], f"node {kind}, place int")


def any_history(seed, n):
    r = random.Random(seed)
    parents = {0: []}
    for k in range(1, n):
        near = lambda: r.randrange(max(0, k - r.choice([2, 6, 30, 90])), k)  # noqa: E731, B023
        parents[k] = list(dict.fromkeys(near() for _ in range(r.choice([0 if k % 41 == 0 else 1, 1, 2, 3]))))
    return parents


def branches(seed, n):
    """Long branches that merge into each other both ways."""
    r = random.Random(seed)
    parents, tips = {0: []}, [0]
    for k in range(1, n):
        at = r.randrange(len(tips))
        other = r.choice(tips)
        if len(tips) < 5 and r.random() < 0.05:
            parents[k] = [tips[at]]
            tips.append(k)
        else:
            parents[k] = [tips[at], other] if other != tips[at] and r.random() < 0.15 else [tips[at]]
            tips[at] = k
    return parents


@pytest.mark.parametrize("make, seed, block, width, most", [(any_history, 4, 500_000, 4096, 6), (any_history, 5, 13, 8, None), (branches, 6, 40, 16, None), (branches, 7, 500_000, 4096, 25)])
def test_brought_in_of_any_history(spark, make, seed, block, width, most, monkeypatch):
    monkeypatch.setattr(reach, "WIDTH", width)
    parents = make(seed, 220)
    edges, merges, order = frames(spark, parents, lambda k: f"c{k}" if seed % 2 else k)
    got = {}
    for row in reach.brought_in(edges, merges, order, most, block).collect():
        got.setdefault(row["merge"], []).append(row["node"])
    name = lambda k: f"c{k}" if seed % 2 else k
    want = {name(k): sorted(map(name, brute(parents, k))) for k, ps in parents.items() if len(ps) > 1}
    want = {k: v if most is None or len(v) <= most else [None] for k, v in want.items() if v}
    assert {k: sorted(v) if None not in v else v for k, v in got.items()} == want and len(want) > 10


def test_chains_are_ways_of_first_parents(spark):
    parents = any_history(9, 300)
    edges, _, order = frames(spark, parents)
    small, crossings = reach.index(edges, order, block=23)
    one, same = reach.index(edges, order)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, one.collect()))
    assert sorted(map(tuple, crossings.collect())) == sorted(map(tuple, same.collect()))
    at = {r["node"]: (r["chain"], r["pos"]) for r in one.collect()}
    assert len(set(at.values())) == len(parents)
    deep = {}
    for k, ps in parents.items():
        deep[k] = deep[ps[0]] + 1 if ps else 0
        assert at[k][1] == deep[k]
    for p in parents:  # of the commits that follow one, that with the deepest way is in its chain, and no other
        below = [k for k, ps in parents.items() if ps[:1] == [p]]
        if below:
            best = max(below, key=lambda k: (deep[at[k][0] + 100], at[k][0]))
            assert [k for k in below if at[k][0] == at[p][0]] == [best]
    assert {(r["chain"], r["to_chain"]) for r in crossings.collect()} == {(at[k][0], at[p][0]) for k, ps in parents.items() for p in ps if at[k][0] != at[p][0]}


def test_a_long_branch_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    parents = {0: []}
    for k in range(1, n + 1):
        parents[k] = [k - 1]  # the branch
    parents[n + 1] = [0]
    for k in range(n + 2, n + 400):
        parents[k] = [k - 1]  # main goes on from the root
    merge = n + 400
    parents[merge] = [merge - 1, n]
    parents[merge + 1] = [merge, n - 5]  # brings in nothing
    rounds, real = [], reach.cut
    monkeypatch.setattr(reach, "cut", lambda df: rounds.append(1) or real(df))
    edges, merges, order = frames(spark, parents)
    got = reach.brought_in(edges, merges, order, None, block=700).groupBy("merge").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).collect()
    assert [tuple(r) for r in got] == [(merge, n, 1, n)]
    assert len(rounds) < 20
    assert [tuple(r) for r in reach.brought_in(edges, merges, order, 25).collect()] == [(merge, None)]


def test_unknown_parents_and_no_merges(spark):
    edges, merges, order = frames(spark, {0: [], 1: [0], 2: [0], 3: [1, 2]})
    known = order.where("node <> 2")
    assert reach.brought_in(edges, merges, known, None).count() == 0
    assert reach.brought_in(edges, merges.limit(0), order, 5).count() == 0
    assert reach.brought_in(edges.limit(0), merges.limit(0), order.limit(0), 5).count() == 0


def test_a_block_is_arrays_only():
    """One chain of a whole block: what a task holds is some numbers a commit, not Python objects."""
    n = 100_000
    up = pa.array([None, *range(n - 1)], pa.int64())
    none = pa.nulls(n, pa.int64())
    block = pa.table({"place": np.arange(n), "up": up, "depth": np.arange(n), "leaf_depth": none, "leaf": none})
    tracemalloc.start()
    out = reach.deepest(block)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["chain"].unique().to_pylist() == [n - 1] and out["pos"].to_pylist() == list(range(n)) and most < 130 * n
    more = pa.table({"place": [5], "up": pa.nulls(1, pa.int64()), "depth": pa.nulls(1, pa.int64()), "leaf_depth": [2 * n], "leaf": [3 * n]})
    assert reach.deepest(pa.concat_tables([block, more.cast(block.schema)]))["chain"].to_pylist() == [3 * n] * 6 + [n - 1] * (n - 6)
