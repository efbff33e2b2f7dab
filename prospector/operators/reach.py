"""An index of a commit graph by long chains of first parents, and what merges bring in, by intervals of chains.

Along a chain each commit is the first parent of the next one, so whatever reaches a commit reaches the whole chain below it, and a
history is one interval a chain. Chains follow the longest way down from each commit. A walk goes from chain to chain, not from commit to
commit: a branch of any length is one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.operators.graph import cut

#: Commits of one block, whose chains a task follows; only what leaves a block is followed between tasks.
BLOCK = 250_000
#: Rows of a batch that a task sends back.
SENT = 50_000
#: Places of a bucket in which intervals and what lies in them are joined.
WIDTH = 4096


def parents_here(place: np.ndarray, up: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """For each of a block's ascending places the number of its parent there, -1 for none."""
    at = np.searchsorted(place, up.fill_null(0).to_numpy()[order])
    here = up.is_valid().to_numpy()[order] & (at < len(place))
    here &= place[np.where(here, at, 0)] == up.fill_null(0).to_numpy()[order]
    return np.where(here, at, -1)


def within(batches):
    """For each commit of a block (place, up), up the place of its first parent or null: the commit that its chain of first parents leaves
    the block at, and the steps to it."""
    table = pa.Table.from_batches(list(batches)) if batches else None
    if table is None or not table.num_rows:
        return
    order = np.argsort(table["place"].to_numpy())
    place = table["place"].to_numpy()[order]
    up = parents_here(place, table["up"], order)
    base, steps = np.where(up >= 0, up, np.arange(len(up))), (up >= 0).astype(np.int64)
    while not np.array_equal(further := base[base], base):
        steps += steps[base]
        base = further
    for at in range(0, len(place), SENT):
        some = slice(at, at + SENT)
        own = [pa.array(place[some]), table["up"].take(pa.array(order[some])).combine_chunks(), pa.array(place[base[some]]), pa.array(steps[some])]
        yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(own[0]), TaskContext.get().partitionId()))], names=["place", "up", "base", "steps", "block"])


def deepest(block: pa.Table) -> pa.Table:
    """For each commit of a block (place, up, depth, leaf_depth, leaf): the deepest commit that reaches it over first parents. Rows of
    depth null say what a child in another block brings to place."""
    own = block.filter(pa.compute.is_valid(block["depth"]))
    order = np.argsort(own["place"].to_numpy())
    place, depth = own["place"].to_numpy()[order], own["depth"].to_numpy()[order]
    brought = block.filter(pa.compute.is_null(block["depth"]))
    leaves = np.concatenate([place, brought["leaf"].to_numpy()])
    by = np.lexsort((leaves, np.concatenate([depth, brought["leaf_depth"].to_numpy()])))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))  # of all (depth, leaf)
    best = rank[: len(place)].copy()
    np.maximum.at(best, np.searchsorted(place, brought["place"].to_numpy()), rank[len(place) :])
    at, to = np.arange(len(place)), parents_here(place, own["up"], order)
    up = to
    while len(at := at[to >= 0]):  # what is up to twice as far down reaches each commit a round
        to = to[to >= 0]
        np.maximum.at(best, to, best[at])
        up = np.where(up >= 0, up[up], -1)
        to = up[at]
    return pa.table({"place": place, "chain": leaves[by[best]], "pos": depth})


def index(edges: DataFrame, order: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, crossings) of edges (child, parent, and k, a parent's number, where the first parent is to be followed) and order (node,
    place), places whole numbers, each after those of all parents.

    nodes (node, place, chain, pos): a commit's chain, named by its last commit's place, and its place there, growing by one a commit.
    crossings (chain, place, to_chain, to_place, to_pos): edges that leave a chain. Parents without a place are left out.

    Blocks of places are followed in tasks. What is left is one row for each way out of a block; its ways are doubled until all end, so
    the rounds grow with the logarithm of the number of blocks, whatever the depth of the history.
    """
    spots = order.select(F.col("node"), F.col("place").cast("long").alias("place"))
    numbered = edges if "k" in edges.columns else edges.withColumn("k", F.lit(0))
    child, parent = spots.toDF("child", "place"), spots.toDF("parent", "up")
    lines = cut(numbered.join(child, "child").join(parent, "parent").select("place", "up", "k"))
    first = lines.groupBy("place").agg(F.min_by("up", F.struct("k", -F.col("up"))).alias("up"))
    blocks = max(1, -(-spots.count() // block))
    local = cut(spots.select("place").join(first, "place", "left").repartitionByRange(blocks, "place").mapInArrow(within, "place long, up long, base long, steps long, block long"))
    ways = local.where("place = base AND up IS NOT NULL").select("base", "up")
    out = local.select(F.col("place").alias("up"), F.col("base").alias("to"), F.col("steps") + 1)
    ways = cut(ways.join(out.toDF("up", "to", "far"), "up").select("base", "up", "to", "far"))
    tops = local.groupBy("base").agg(F.max(F.struct("steps", "place")).alias("top"))
    state = cut(tops.join(ways.drop("up"), "base", "left").select("base", "to", F.coalesce("far", F.lit(0)).alias("far"), F.col("top.steps").alias("deep"), F.col("top.place").alias("leaf")))
    while state.where("to IS NOT NULL").limit(1).count():
        # deep counts from base; one that comes from below is as much deeper as its way is long
        below = state.where("to IS NOT NULL").groupBy(F.col("to").alias("base")).agg(F.max(F.struct(F.col("far") + F.col("deep"), "leaf")).alias("below"))
        above = state.select(F.col("base").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        both = state.join(below, "base", "left").join(above, "to", "left")
        best = F.greatest(F.struct(F.col("deep").alias("a"), F.col("leaf").alias("b")), F.struct(F.col("below.col1").alias("a"), F.col("below.leaf").alias("b")))
        best = F.when(F.col("below").isNull(), F.struct(F.col("deep").alias("a"), F.col("leaf").alias("b"))).otherwise(best)
        state = cut(both.select("base", F.col("next").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), best["a"].alias("deep"), best["b"].alias("leaf")))
    facts = state.select("base", "far", "deep", "leaf")
    none = F.lit(None).cast("long")
    full = local.join(facts.select("base", "far"), "base").select("block", "place", "up", (F.col("far") + F.col("steps")).alias("depth"), none.alias("leaf_depth"), none.alias("leaf"))
    brought = ways.select("base", "up").join(facts, "base").select(F.col("up").alias("place"), (F.col("far") + F.col("deep")).alias("leaf_depth"), "leaf")
    brought = brought.join(local.select("place", "block"), "place").select("block", "place", none.alias("up"), none.alias("depth"), "leaf_depth", "leaf")
    placed = cut(full.unionByName(brought).groupBy("block").applyInArrow(deepest, "place long, chain long, pos long"))
    nodes = spots.join(placed, "place").select("node", "place", "chain", "pos")
    to = placed.toDF("up", "to_chain", "to_pos")
    crossings = lines.select("place", "up").distinct().join(placed.select("place", "chain"), "place").join(to, "up").where("chain <> to_chain")
    return cut(nodes), cut(crossings.select("chain", "place", "to_chain", F.col("up").alias("to_place"), "to_pos"))


def bucketed(spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """spans with a row for each bucket that (lo, hi] lies in."""
    return spans.withColumn("bucket", F.explode(F.sequence(F.floor((F.col(lo) + 1) / width), F.floor(F.col(hi) / width))))


def spans_brought_in(nodes: DataFrame, crossings: DataFrame, merges: DataFrame, others: DataFrame) -> DataFrame:
    """(merge, chain, lo, hi): the positions lo < pos <= hi of chains that a merge's other parents (merge, node) reach and its first
    parent (merge, first_parent) does not.

    All merges are walked at once, from chain to chain. What other parents reach alone is followed wherever it goes; on the first
    parent's side only what lies above the lowest of that, and of it first the nearest WIDTH places, then twice as many a round. A merge
    is done when a round changes nothing. Rounds grow with the number of chains on a way and the logarithm of the places to look
    through, not with commits.
    """
    starts = nodes.groupBy("chain").agg(F.min(F.struct("place", "pos")).alias("start"))
    edges = crossings.join(starts.select(F.col("chain").alias("to_chain"), "start"), "to_chain").withColumn("bucket", F.floor(F.col("place") / WIDTH))
    edges = cut(edges)
    own = merges.select("merge", F.col("first_parent").alias("node"), F.lit(True).alias("own"))
    begun = own.unionByName(others.select("merge", "node", F.lit(False).alias("own"))).join(nodes, "node").join(starts, "chain")
    spot = F.struct("place", "pos")
    state = begun.groupBy("merge", "chain").agg(F.max(F.when(F.col("own"), spot)).alias("own"), F.max(F.when(~F.col("own"), spot)).alias("other"), F.first("start").alias("start"))
    state = cut(state.withColumn("done", F.lit(False)))
    finished, turn = None, 0
    while True:
        alone = F.col("other").isNotNull() & (F.col("own").isNull() | (F.col("other.place") > F.col("own.place")))
        below = F.coalesce(F.col("own.place"), F.col("start.place") - 1)
        facts = state.groupBy("merge").agg(F.min(F.when(alone, below + 1)).alias("low"), F.max("own.place").alias("top"))
        known = state.join(facts, "merge")
        floor = F.col("top") - F.lit(WIDTH << min(turn, 40))
        wide = known.where(alone).select("merge", "chain", below.alias("lo"), F.col("other.place").alias("hi"), F.lit(False).alias("side"))
        near = known.where("own IS NOT NULL AND low IS NOT NULL").select("merge", "chain", (F.greatest("low", floor) - 1).alias("lo"), F.col("own.place").alias("hi"), F.lit(True).alias("side"))
        spans = bucketed(wide.unionByName(near).where("hi > lo"), "lo", "hi", WIDTH)
        to = F.struct(F.col("to_place").alias("place"), F.col("to_pos").alias("pos"))
        step = spans.join(edges, ["chain", "bucket"]).where((F.col("place") > F.col("lo")) & (F.col("place") <= F.col("hi")))
        step = step.select("merge", F.col("to_chain").alias("chain"), F.when(F.col("side"), to).alias("own"), F.when(~F.col("side"), to).alias("other"), "start", F.lit(False).alias("was"))
        both = state.select("merge", "chain", "own", "other", "start", F.lit(True).alias("was")).unionByName(step)
        grown = both.groupBy("merge", "chain").agg(
            F.max("own").alias("own"), F.max("other").alias("other"), F.first("start").alias("start"), F.max("was").alias("was"),
            F.max(F.when(F.col("was"), F.col("own"))).alias("own_was"), F.max(F.when(F.col("was"), F.col("other"))).alias("other_was"),
        )
        same = F.col("was") & F.col("own").eqNullSafe(F.col("own_was")) & F.col("other").eqNullSafe(F.col("other_was"))
        still = grown.groupBy("merge").agg(F.bool_and(same).alias("still")).join(facts.select("merge", (F.col("low").isNull() | F.col("top").isNull() | (floor <= F.col("low"))).alias("seen")), "merge")
        state = cut(grown.select("merge", "chain", "own", "other", "start").join(still, "merge").withColumn("done", F.col("still") & F.col("seen")).drop("still", "seen"))
        over = state.where("done").select("merge", "chain", "own", "other", "start")
        finished = over if finished is None else finished.unionByName(over)
        state = state.where("NOT done")
        turn += 1
        if not state.limit(1).count():
            break
    lo = F.coalesce(F.col("own.pos"), F.col("start.pos") - 1)
    return finished.where("other IS NOT NULL").select("merge", "chain", lo.alias("lo"), F.col("other.pos").alias("hi")).where("hi > lo")


def brought_in(edges: DataFrame, merges: DataFrame, order: DataFrame, most: int | None = 25, block: int = BLOCK) -> DataFrame:
    """(merge, node): commits that a merge (merge, first_parent) reaches and its first parent does not; a null node for a merge that
    brings in more than `most`, and no row for one that brings in nothing. edges and order are as for index(); merges without a place
    have no row. How many a merge brings in follows from its intervals, before any commit is looked up."""
    nodes, crossings = index(edges, order, block)
    others = merges.join(edges, F.col("merge") == F.col("child")).where("parent <> first_parent").select("merge", F.col("parent").alias("node"))
    spans = cut(spans_brought_in(nodes, crossings, merges.join(others.select("merge").distinct(), "merge", "left_semi"), others))
    sizes = spans.groupBy("merge").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
    few = spans if most is None else spans.join(sizes.where(F.col("n") <= most).select("merge"), "merge")
    width = 256
    placed = nodes.withColumn("bucket", F.floor(F.col("pos") / width)).select("node", "chain", "pos", "bucket")
    found = bucketed(few, "lo", "hi", width).join(placed, ["chain", "bucket"]).where((F.col("pos") > F.col("lo")) & (F.col("pos") <= F.col("hi"))).select("merge", "node")
    if most is None:
        return found
    return found.unionByName(sizes.where(F.col("n") > most).select("merge", F.lit(None).cast(found.schema["node"].dataType).alias("node")))
