"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.llm.common import components, cut, in_batches, local_roots, sorted_groups, table, tiled

COSINE = 0.93
#: Bits of a pass's code, and the neighbours in code order that a vector is compared with.
BITS, WINDOW = 48, 32
#: Chance to miss a pair at COSINE in all passes that sets their number.
MISS = 0.001
#: Passes that every label has at least. Bits of codes at which runs are measured, over the first PROBES passes.
FEWEST, LEVELS, PROBES = 4, tuple(range(0, BITS + 1, 4)), 2
#: Vectors of a component that one task compares; larger components are cut into tiles.
TILE = 4_096
SEED = 20_240_229


def passes(bits: float, cosine: float = COSINE) -> int:
    """Passes after which a pair at `cosine`, seen from the centre, is missed with chance MISS, where `bits` bits of a code part vectors
    into runs of half a window: two vectors at angle t agree in a random sign bit with chance 1 - t/pi, and their codes lie within WINDOW
    of each other once they agree in so many bits."""
    hit = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return FEWEST if hit >= 1 - MISS else max(FEWEST, math.ceil(math.log(MISS) / math.log1p(-max(hit, 1e-12))))


def plan(rows: int, spread: float, bits: float, cosine: float) -> tuple[int, bool]:
    """(passes, all pairs as well) for `rows` vectors at mean square distance `spread` from their centre, whose codes need `bits` bits.

    A pair at `cosine` is at a wider angle from the centre the less the vectors spread. Passes always run. Where as many as leave a chance
    of MISS would be more work than all pairs, the fewest run, and all pairs are compared exactly after them.
    """
    number = passes(bits, 1 - (1 - cosine) / spread if spread > 0 else -1.0)
    full = 2 * WINDOW * number >= rows
    return FEWEST if full else number, full


def prefix_runs(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `bits` bits of codes, and how many have each."""
    return np.unique(code >> (BITS - bits), return_counts=True)


def codes(vectors: np.ndarray, number: int) -> np.ndarray:
    """The code of a pass: signs of BITS random projections, the first one highest."""
    planes = np.random.default_rng([SEED, number, vectors.shape[1]]).standard_normal((vectors.shape[1], BITS))
    return (((vectors @ planes) > 0).astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines between rows of a and b; rows are of length 1."""
    return a @ b.T


def unit(blobs, kind) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors are linked if their labels are equal and not null, they are as long, and their cosine in double precision reaches
    `cosine`. A vector that is null, empty, zero, or holds null or non-finite components has no links and is its own component.
    Equal vectors of a label meet first and travel as one. Each pass orders them by a code of random projections, seen from the mean
    of their label and length, and compares each with its WINDOW next, also over the edges of the ranges that tasks hold. How many bits part
    the codes of a label into runs of half a window is measured on its first passes, so tight topics get more passes. Where as many as are
    needed would be more work than all pairs, all pairs are compared in tiles after the passes. What any of these links becomes one
    component. Inside a component all pairs are then counted, in tiles, so
    that n_links is exact there however large a group of copies is. Repeated rows count as vectors. Null id: never the smallest.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    zero = F.forall("embedding", lambda x: x == 0)
    rows = vectors.select("vec_id", "label", "embedding")
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(False)) & ~zero
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    kind = np.float32 if "float" in vectors.schema["embedding"].dataType.simpleString() else np.float64
    grouped = rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("m"))
    reps = cut(grouped.withColumn("rep", F.monotonically_increasing_id()))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.size("embedding").alias("size")
    kinds = cut(reps.groupBy("label", size).agg(F.count("*").alias("n")).withColumn("kind", F.monotonically_increasing_id()))
    placed = reps.select("label", "rep", "embedding", size).join(kinds, ["label", "size"]).select("kind", "n", F.col("label").cast("string").alias("label"), "rep", "embedding")

    def sums(batches):
        for b in batches:
            own = b.column(0).to_numpy()
            for kind_ in np.unique(own):
                at = pa.array(np.flatnonzero(own == kind_))
                u = unit([np.array(x, kind).tobytes() for x in b.column(2).take(at).to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([pa.array([kind_]), pa.array([b.column(1)[int(at[0].as_py())].as_py()]), pa.array([u.sum(axis=0).tobytes()], pa.binary())], names=["kind", "n", "v"])

    def centre(batches):
        for (kind_,), t in sorted_groups(batches, 1):
            rows_ = t.column(1)[0].as_py()
            mean = sum(np.frombuffer(x.as_py(), np.float64) for x in t.column(2)) / rows_
            yield pa.RecordBatch.from_arrays([pa.array([kind_]), pa.array([mean.tobytes()], pa.binary()), pa.array([1 - float(mean @ mean)])], names=["kind", "centre", "spread"])

    added = placed.select("kind", "n", "embedding").mapInArrow(sums, "kind long, n long, v binary").repartition(n, "kind").sortWithinPartitions("kind")
    centres = cut(added.mapInArrow(centre, "kind long, centre binary, spread double"))

    def seen_from(b: pa.RecordBatch, lists: int, centre: int):
        """(rows, their vectors, these seen from their centre) for each length of the vectors of a batch."""
        sizes = np.diff(b.column(lists).offsets.to_numpy())
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            v = np.stack([b.column(lists)[int(k)].values.to_numpy(zero_copy_only=False) for k in at]).astype(kind)
            u = unit([x.tobytes() for x in v], kind)
            yield at, v, u - np.stack([np.frombuffer(b.column(centre)[int(k)].as_py(), np.float64) for k in at])

    def measured(batches):
        """How many codes of a kind begin with each prefix, for the lengths LEVELS and the first PROBES passes."""

        def parts():
            for b in batches:
                own = b.column(0).to_numpy()
                for at, _, u in seen_from(b, 1, 2) if b.num_rows else ():
                    for p in range(PROBES):
                        code = codes(u, p)
                        for kind_ in np.unique(own[at]):
                            for bits in LEVELS:
                                prefix, many = prefix_runs(code[own[at] == kind_], bits)
                                yield np.full(len(prefix), kind_), np.full(len(prefix), bits + p * (BITS + 1)), prefix, many

        yield from in_batches(parts(), ["kind", "level", "prefix", "many"])

    runs = placed.join(centres, "kind").select("kind", "embedding", "centre").mapInArrow(measured, "kind long, level long, prefix long, many long")
    runs = runs.groupBy("kind", "level", "prefix").agg(F.sum("many").alias("many"))
    # a vector's run holds so many on average; half a window is enough
    square = F.sum(F.col("many").cast("double") * F.col("many")) / F.sum("many")
    level = (F.col("level") % (BITS + 1)).alias("bits")
    sizes_ = runs.groupBy("kind", level).agg(square.alias("run")).groupBy("kind").agg(F.coalesce(F.min(F.when(F.col("run") <= WINDOW / 2, F.col("bits"))), F.lit(BITS)).alias("bits"))

    def planned(batches):
        for b in batches:
            told = [plan(rows_, spread, bits, cosine) for rows_, spread, bits in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.bool_())], names=["kind", "centre", "rounds", "full"])

    facts_ = centres.join(sizes_, "kind").join(kinds.select("kind", "n"), "kind").select("kind", "centre", "n", "spread", "bits")
    centres = cut(facts_.mapInArrow(planned, "kind long, centre binary, rounds long, full boolean"))
    most = centres.agg(F.max("rounds")).first()[0] or 0
    placed = placed.join(centres, "kind")

    def coded(batches):
        for b in batches:
            if not b.num_rows:
                continue
            for at, v, u in seen_from(b, 2, 3):
                blobs = pa.array([x.tobytes() for x in v], pa.binary())
                label, rep, rounds = (b.column(c).take(pa.array(at)) for c in (0, 1, 4))
                for p in range(max(rounds.to_pylist())):
                    on = pa.array(rounds.to_numpy() > p)
                    whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), label, pa.array(codes(u, p)), rep, blobs], names=["pass", "label", "code", "rep", "v"])
                    yield whole.filter(on)

    text = placed.select("label", "rep", "embedding", "centre", "rounds")
    spread = text.mapInArrow(coded, "pass int, label string, code long, rep long, v binary")
    order = ["pass", "label", "code"]
    spread = spread.repartitionByRange(max(n, most), *order).sortWithinPartitions(*order)

    names = ["a", "b", "edge", "side", "place", "pass", "label", "rep", "v"]

    def edge_rows(t: pa.Table, edge: int, side: int) -> pa.RecordBatch:
        """The rows of t as neighbours of a range's edge; place counts them from there."""
        n = t.num_rows
        place = np.arange(n)[:: 1 if side else -1]
        none = pa.nulls(n, pa.int64())
        facts = [pa.array(np.full(n, edge, np.int64)), pa.array(np.full(n, side, np.int64)), pa.array(place.copy())]
        return pa.RecordBatch.from_arrays([none, none, *facts, *(t.column(k).combine_chunks() for k in (0, 1, 3, 4))], names=names)

    def windows(batches):
        """Links between neighbours in a range of the order, and the first and last WINDOW rows of the range."""
        from pyspark import TaskContext

        part, tail, head, seen = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b])
            if seen < WINDOW:
                head = own.slice(0, WINDOW - seen) if head is None else pa.concat_tables([head, own.slice(0, WINDOW - seen)])
            seen += b.num_rows
            t = own if tail is None else pa.concat_tables([tail, own])
            number, label = t.column(0).to_numpy(), np.array(t.column(1).to_pylist(), object)
            rep, blobs = t.column(3).to_numpy(), t.column(4).to_pylist()
            lengths = np.array([len(x) for x in blobs])
            a, z = [], []
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                u = unit([blobs[k] for k in at], kind)
                for step in range(1, min(WINDOW, len(at) - 1) + 1):
                    near = np.einsum("ij,ij->i", u[:-step], u[step:]) >= cosine
                    near &= (number[at[:-step]] == number[at[step:]]) & (label[at[:-step]] == label[at[step:]])
                    k = np.flatnonzero(near)
                    a.append(at[k])
                    z.append(at[k + step])
            root = local_roots(len(rep), np.concatenate(a), np.concatenate(z)) if a else np.arange(len(rep))
            k = np.flatnonzero(root != np.arange(len(rep)))
            empty = [pa.nulls(len(k), f) for f in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(rep[k]), pa.array(rep[root[k]]), *empty], names=names)
            tail = t.slice(max(0, t.num_rows - WINDOW))
        if head is not None:
            yield edge_rows(head, part - 1, 1)
            yield edge_rows(tail, part, 0)

    def across(batches):
        """Links between the last rows of a range and the first of the next one, as far apart as within a range."""

        def parts():
            for _, t in sorted_groups(batches, 1):
                side, place, number, rep = (t.column(k).to_numpy() for k in (1, 2, 3, 5))
                label, blobs = np.array(t.column(4).to_pylist(), object), t.column(6).to_pylist()
                sizes = np.array([len(x) for x in blobs])
                for size in np.unique(sizes):
                    left, right = (np.flatnonzero((sizes == size) & (side == x)) for x in (0, 1))
                    if len(left) and len(right):
                        near = cosines(unit([blobs[k] for k in left], kind), unit([blobs[k] for k in right], kind)) >= cosine
                        near &= (place[left][:, None] + place[right][None, :] < WINDOW) & (number[left][:, None] == number[right][None, :]) & (label[left][:, None] == label[right][None, :])
                        i, j = np.nonzero(near)
                        yield rep[left[i]], rep[right[j]]

        yield from in_batches(parts(), ["a", "b"])

    def all_pairs(batches):
        def parts():
            for (_, t0, t1), t in sorted_groups(batches, 3):
                mine, rep = t.column(3).to_numpy(), t.column(4).to_numpy()
                u = unit([np.array(x, kind).tobytes() for x in t.column(5).to_pylist()], kind)
                left, right = np.flatnonzero(mine == t0), np.flatnonzero(mine == t1)
                if len(left) and len(right):
                    a, z = np.nonzero(cosines(u[left], u[right]) >= cosine)
                    root = local_roots(len(rep), left[a], right[z])
                    k = np.flatnonzero(root != np.arange(len(rep)))
                    yield rep[k], rep[root[k]]

        yield from in_batches(parts(), ["a", "b"])

    few = ["kind", "t0", "t1"]
    exact = tiled(placed.where("full").select("kind", "rep", "embedding"), "kind", "rep", TILE).select(*few, "mine", "rep", "embedding")
    exact = exact.repartition(n, *few).sortWithinPartitions(*few).mapInArrow(all_pairs, "a long, b long")
    found = cut(spread.mapInArrow(windows, "a long, b long, edge long, side long, place long, pass int, label string, rep long, v binary"))
    edges = found.where("edge IS NOT NULL").select(*names[2:]).repartition(n, "edge").sortWithinPartitions("edge").mapInArrow(across, "a long, b long")
    roots = cut(components(found.where("a IS NOT NULL").select("a", "b").unionByName(edges).unionByName(exact)))
    members = tiled(reps.select("rep", "m", "embedding").join(roots, reps["rep"] == roots["node"]).select("root", "rep", "m", "embedding"), "root", "rep", TILE)
    keys = ["root", "t0", "t1"]
    members = members.select(*keys, "mine", "rep", "m", "embedding")

    def count(batches):
        def parts():
            for (_, t0, t1), t in sorted_groups(batches, 3):
                mine, rep, m = (t.column(k).to_numpy() for k in (3, 4, 5))
                u = unit([np.array(x, kind).tobytes() for x in t.column(6).to_pylist()], kind)
                left, right = np.flatnonzero(mine == t0), np.flatnonzero(mine == t1)
                if t0 == t1:
                    linked = cosines(u, u) >= cosine
                    np.fill_diagonal(linked, False)
                    yield rep, linked @ m
                elif len(left) and len(right):
                    linked = cosines(u[left], u[right]) >= cosine
                    yield rep[left], linked @ m[right]
                    yield rep[right], linked.T @ m[left]

        yield from in_batches(parts(), ["rep", "n"])

    counted = members.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    low = reps.join(roots, reps["rep"] == roots["node"]).groupBy("root").agg(F.min("low").alias("component_low"))
    named = roots.join(low, "root").join(counted, roots["node"] == counted["rep"]).select("node", "component_low", "n")
    facts = reps.join(named, reps["rep"] == named["node"], "left").select(
        F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_low", "low").alias("c")
    )
    same = rows["usable"] & (rows["label"] == facts["_l"]) & (rows["embedding"] == facts["_e"])
    out = rows.join(facts, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
