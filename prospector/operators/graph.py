"""Linked groups and splits by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospector.functions.text import stable_score


#: Links that a task holds at once.
LINKS = 1_000_000
#: Rows of values that a task links before anything is shuffled, and rows of a batch that it sends back.
HELD, SENT = 250_000, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where none is named and all runs on one machine, as in tests."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prospector-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n numbers is linked to by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)  # roots that meet are joined, not only the two ends
        np.minimum.at(root, before[b], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """All values of columns in ascending order, and each column as their numbers."""
    one = pa.chunked_array([c for x in columns for c in x.chunks])
    values = one.unique()
    values = values.take(pa.compute.sort_indices(values))
    return values, [pa.compute.index_in(x, values).to_numpy() for x in columns]


def in_chunks(batches, rows: int):
    """Tables of at least `rows` rows, the last one shorter."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def linked_here(rows: int):
    """For chunks of (item, k, v): each item with the smallest that it is linked to there, and each value once, with that of its items."""

    def link(batches):
        for t in in_chunks(batches, rows):
            items, (at,) = coded(t["item"])
            names, (name,) = coded(t["k"])
            _, (value,) = coded(t["v"])
            _, first, same = np.unique(value * np.int64(len(names)) + name, return_index=True, return_inverse=True)
            del name, value
            root = roots(len(items), at, at[first][same])
            top, same = root[at[first]], None
            for k in range(0, len(items), SENT):
                some = items[k : k + SENT]
                own = pa.nulls(len(some), pa.string())
                yield pa.RecordBatch.from_arrays([some, items.take(pa.array(root[k : k + SENT])), own, own], names=["item", "root", "k", "v"])
            for k in range(0, len(first), SENT):
                some = t.take(pa.array(first[k : k + SENT]))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), items.type), items.take(pa.array(top[k : k + SENT])), some["k"].combine_chunks(), some["v"].combine_chunks()], names=["item", "root", "k", "v"])

    return link


def forest(rows: int):
    """Links (a, b) of a chunk as each end with the smallest that it is linked to there."""

    def grow(batches):
        for t in in_chunks(batches, rows):
            values, (a, b) = coded(t["a"], t["b"])
            root = roots(len(values), a, b)
            own = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([values.take(pa.array(own)), values.take(pa.array(root[own]))], names=["a", "b"])

    return grow


def spread(links: DataFrame, kind: str, rows: int) -> DataFrame:
    """(node, group) of all ends of links (a, b): the smallest node that each is linked to.

    Tasks turn their links to stars first; what is more than one task's goes on by minima over neighbours and the label's own label, in
    rounds that grow with the logarithm of the longest way in practice.
    """
    few = cut(links.where("a <> b").mapInArrow(forest(rows), f"a {kind}, b {kind}"))
    parts = -(-few.count() // rows)
    e = cut(few.coalesce(max(1, parts)).mapInArrow(forest(rows), f"a {kind}, b {kind}"))
    labels = e.select(F.col("a").alias("node"), F.col("b").alias("group")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("group"))).groupBy("node").agg(F.min("group").alias("group"))
    if parts <= 1:
        return labels
    both = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    while True:
        labels = cut(labels)
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("group", F.coalesce("m", "group")).alias("g"), F.col("group").alias("was"))
        jump = step.select(F.col("node").alias("g"), F.col("g").alias("gg"))
        after = cut(step.join(jump, "g", "left").select("node", F.least("g", F.coalesce("gg", "g")).alias("group"), "was"))
        labels = after.select("node", "group")
        if not after.where("group <> was").limit(1).count():
            return labels


def linked_groups(records: DataFrame, item: str, keys: list[str], rows: int = LINKS) -> DataFrame:
    """(item, group): records that share a value of any key, directly or over others, get the smallest item of all as group.

    Each task first links what it holds, HELD values at a time or `rows` if fewer, so a value that any number of records share leaves it as one row, and
    its records as rows of their smallest one. Only values and records that several chunks hold are linked between tasks.
    """
    kind = records.schema[item].dataType.simpleString()
    values = [F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]
    pairs = records.select(F.col(item).alias("item"), F.explode(F.array(*values)).alias("link")).where("link.v IS NOT NULL AND item IS NOT NULL").select("item", "link.k", "link.v")
    held = cut(pairs.mapInArrow(linked_here(min(rows, HELD)), f"item {kind}, root {kind}, k string, v string"))
    own, shared = held.where("v IS NULL").select("item", "root"), held.where("v IS NOT NULL").select("k", "v", "root")
    low = shared.groupBy("k", "v").agg(F.min("root").alias("b"), F.count("*").alias("n")).where("n > 1")
    apart = own.groupBy("item").agg(F.min("root").alias("b"), F.max("root").alias("top"), F.count("*").alias("n")).where("n > 1 AND b <> top").select("item", "b")
    links = shared.join(low, ["k", "v"]).select(F.col("root").alias("a"), "b").unionByName(own.join(apart, "item").select(F.col("root").alias("a"), "b"))
    labels = spread(links.distinct(), kind, rows)
    first = own.groupBy("item").agg(F.min("root").alias("root"))
    found = first.join(labels, F.col("root") == F.col("node"), "left").select("item", F.coalesce("group", "root").alias("_g"))
    every = records.select(item).distinct()
    return every.join(found, F.col(item) == F.col("item"), "left").select(every[item], F.coalesce("_g", every[item]).alias("group"))


def grouped_holdout(groups: DataFrame, fraction: float, seed: str) -> DataFrame:
    """Whole groups to holdout where the group's stable score is below the fraction."""
    return groups.withColumn("split", F.when(stable_score(seed, F.col("group").cast("string")) < fraction, "holdout").otherwise("development"))


def temporal_holdout(rows: DataFrame, group: str, at: str, target: int | None = None, cutoff=None) -> DataFrame:
    """(group, split): groups whose newest row is at or after a cutoff go to holdout, or the newest groups until `target` rows are in.

    Groups are laid out newest first in ranges; totals of the ranges give each its offset, and running sums stay within a range.
    """
    sizes = rows.groupBy(group).agg(F.max(at).alias("latest"), F.count("*").alias("n"))
    if (target is None) == (cutoff is None):
        raise ValueError("either a target or a cutoff")
    if cutoff is not None:
        return sizes.select(group, F.when(F.col("latest") >= cutoff, "holdout").otherwise("development").alias("split"))
    order = (F.col("latest").desc(), F.col(group).desc())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(sizes.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    offsets, total = [], 0
    for r in laid.groupBy("_part").agg(F.sum("n").alias("n")).orderBy("_part").collect():  # one row a range
        offsets.append((r["_part"], total))
        total += r["n"]
    base = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part int, _base long"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_base") + F.coalesce(F.sum("n").over(w), F.lit(0))
    return laid.join(base, "_part").select(group, F.when(taken < target, "holdout").otherwise("development").alias("split"))
