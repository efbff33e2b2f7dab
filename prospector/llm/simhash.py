"""SimHash near-duplicates: pairs within a Hamming radius by vantage-point trees with overlapping shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from prospector.llm.common import BROADCAST_ROWS, components, cut, fresh, in_batches, local_roots, repeat_rows, row_key, sorted_groups, table, tiled, with_field
from prospector.llm.substring import spans, word_hashes

SHINGLE, RADIUS, SEED = 4, 4, 42
#: (first bit, bits) of the blocks of a 64-bit fingerprint. A pair within RADIUS bits differs in at most NEAR bits of one of them.
BLOCKS, NEAR = ((0, 22), (22, 21), (43, 21)), 1
#: Fingerprints that a shard holds on average, and those of a shard that one task joins; larger shards are cut into tiles.
SHARD_ROWS, LEAF_ROWS = 500, 20_000
#: Share of a set that stays in each half when a vantage point of a block splits it with an overlap of one bit.
HALF = 0.585
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15

#: Similar documents: words of a shingle, least Jaccard similarity of their shingle sets, chance to miss a pair at that similarity.
WORDS, JACCARD, MISS = 5, (4, 5), 0.01
#: 64-bit words of the part of a wide fingerprint that travels with the shards, and the bits that similar documents differ in there
#: at most: 19.4 on average at JACCARD, with a deviation of 4.1; unrelated documents differ in 64, with one of 5.7.
SKETCH, SKETCH_RADIUS = 2, 34
#: Bytes of text whose words are hashed at once, and documents whose shingles are held at once.
HASHED, SLICE = 1 << 19, 500


# --- fingerprints


def fingerprint(text: bytes | None) -> int:
    """Bits set in over half of the hashes of all four-word shingles; unsigned. No words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[: -SHINGLE])).tolist()
    last = (ends[SHINGLE - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(first), CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(first[k : k + CHUNK], last[k : k + CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = (2 * ones > len(first)).astype(np.uint64)
    return int((set_ << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fp") -> DataFrame:
    """All columns of docs but the text, and the fingerprint as a signed long in a column that docs has not."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(len(rest))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(fps)], names=[*rest, into])

    light = docs.select(*rest)
    return docs.select(*rest, F.col(text_col).cast("binary")).mapInArrow(run, with_field(light.schema, into, LongType()))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of WORDS lower-cased words; shorter texts: of the whole; no words: none."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        words = (t or b"").lower().split()
        held.append(b" ".join(words) + b"\n" if words else b"")
        size += len(held[-1])
        if size >= HASHED:
            out += hashed_sets(held)
            held, size = [], 0
    return out + hashed_sets(held)


def hashed_sets(lines: list[bytes]) -> list[np.ndarray]:
    buffer = b"".join(lines)
    if not buffer:
        return [np.zeros(0, np.uint64) for _ in lines]
    arr = np.frombuffer(buffer, np.uint8)
    starts, ends, line = spans(arr)
    h = word_hashes(arr, starts, ends)
    cuts = np.searchsorted(line, np.arange(line[-1] + 2))
    out, k = [], 0
    for text in lines:
        if not text:
            out.append(np.zeros(0, np.uint64))
            continue
        own = h[cuts[k] : cuts[k + 1]]
        k += 1
        n = max(1, len(own) - WORDS + 1)
        mixed = own[:n].copy()
        for j in range(1, min(WORDS, len(own))):
            mixed = mixed * np.uint64(0xD1342543DE82EF95) + own[j : n + j]
        out.append(np.unique(scrambled(mixed)))
    return out


def scrambled(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """`words` 64-bit words whose bits are set in over half of as many mixes of each shingle's hash."""
    ones = np.zeros((words, 64), np.int64)
    for k in range(0, len(shingles), CHUNK):
        part = shingles[k : k + CHUNK]
        whole = np.zeros((-(-len(part) // 255) * 255,), np.uint64)
        for j in range(words):
            whole[: len(part)] = scrambled(part + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
            bits = np.unpackbits(whole.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[j] += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return ((2 * ones > len(shingles)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


# --- vantage-point trees


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of rows of 64-bit words."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def vantage_pairs(fps: np.ndarray, radius: int = RADIUS, small: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, differing bits) of distinct rows of 64-bit words within radius, in pieces.

    A vantage point splits its set at the median distance; the triangle bound leaves between the halves only fingerprints whose
    distances to it differ by at most radius, so a ring on one side meets only the near rings of the other. A set that the bound
    hardly prunes is compared at once.
    """

    def compare(a: np.ndarray, b: np.ndarray):
        for k in range(0, len(a), 512):
            for m in range(0, len(b), 2048):
                d = distances(fps[a[k : k + 512]], fps[b[m : m + 2048]])
                i, j = np.nonzero(d <= radius)
                yield a[k + i], b[m + j], d[i, j]

    stack = [np.arange(len(fps))]
    while stack:
        at = stack.pop()
        if len(at) < 2:
            continue
        d = distances(fps[at], fps[at[:1]])[:, 0].astype(np.int64)
        mid = int(np.median(d))
        if (d <= mid).all():
            mid = int(d.max()) - 1
        meet = [(at[d == ring], at[(d > mid) & (d <= ring + radius)]) for ring in range(max(0, mid - radius + 1), mid + 1)]
        if len(at) <= small or 4 * sum(len(a) * len(b) for a, b in meet) > len(at) * len(at) // 2:
            for a, b, x in compare(at, at):
                keep = a < b
                yield a[keep], b[keep], x[keep]
            continue
        stack += [at[d <= mid], at[d > mid]]
        for a, b in meet:
            yield from compare(a, b)


def spanning(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest of n nodes: in each round every component takes its shortest edge out."""
    order = np.argsort(d, kind="stable")
    root, kept = np.arange(n), []
    while len(order):
        ra, rb = root[a[order]], root[b[order]]
        order = order[differ := ra != rb]
        if not len(order):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, ra[differ], np.arange(len(order)))
        np.minimum.at(best, rb[differ], np.arange(len(order)))
        picked = order[np.unique(best[best < len(order)])]
        kept.append(picked)
        root = local_roots(n, np.concatenate((np.arange(n), a[picked])), np.concatenate((root, b[picked])))
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def leaf_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest edges that connect what is linked within one shard, as places and lengths; a large set's pairs are thinned on the way."""
    held, size = [], 0
    for piece in vantage_pairs(fps, radius):
        if len(piece[0]):
            held.append(piece)
            size += len(piece[0])
        if size > 4_000_000:
            held = [thinned(len(fps), held)]
            size = len(held[0][0])
    return thinned(len(fps), held) if held else (np.zeros(0, np.int64),) * 3


def thinned(n: int, parts: list) -> tuple:
    a, b, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = spanning(n, a, b, d)
    return a[keep], b[keep], d[keep]


def block_values(bits: np.ndarray, blocks) -> np.ndarray:
    """(rows, blocks): the bits of each block of rows of 64-bit words, as numbers; no block is wider than 32 bits."""
    out = np.empty((len(bits), len(blocks)), np.uint64)
    for k, (first, width) in enumerate(blocks):
        word, shift = divmod(first, 64)
        x = bits[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (bits[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = x & np.uint64((1 << width) - 1)
    return out


def vantage(block: int, level: int, width: int) -> np.uint64:
    """The vantage point of a level of a block's tree."""
    return np.uint64(xxhash.xxh64_intdigest(f"{block} {level}", SEED) & ((1 << width) - 1))


def levels_for(rows: int) -> int:
    return max(0, math.ceil(math.log(max(rows, 1) / SHARD_ROWS) / -math.log(HALF)))


def links(points: DataFrame, blocks, near: int, radius: int, words: int, sketch: int) -> DataFrame:
    """Edges (a, b, d) that connect what pairs within `radius` bits of the first `sketch` words connect, for pairs that are within
    `near` bits in one of the blocks.

    points: (id, bits), bits of `words` 64-bit words. Each block has a tree of vantage points, one a level, as many levels as its
    shards need to hold about SHARD_ROWS. A point goes to the half that its distance names, and a point up to `near` bits beyond the
    median also visits the inner half: by the triangle bound two points within `near` bits then share a half at every level.
    """
    spark = points.sparkSession
    depth = levels_for(points.count())

    def bits_of(b: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, words)

    def count(batches):
        seen = np.zeros((len(blocks), max(depth, 1), 65), np.int64)
        for b in batches:
            values = block_values(bits_of(b), blocks)
            for k, (_, width) in enumerate(blocks):
                for level in range(depth):
                    seen[k, level] += np.bincount(np.bitwise_count(values[:, k] ^ vantage(k, level, width)), minlength=65)
        k, level, d = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, level, d, seen[k, level, d])], names=["k", "level", "d", "n"])

    middle = np.zeros((len(blocks), max(depth, 1)), np.int64)
    if depth:  # distances of all points to the vantage points: at most 65 rows for each of these
        seen = np.zeros((len(blocks), depth, 65), np.int64)
        for r in points.mapInArrow(count, "k long, level long, d long, n long").groupBy("k", "level", "d").agg(F.sum("n").alias("n")).collect():
            seen[r["k"], r["level"], r["d"]] = r["n"]
        middle = (2 * seen.cumsum(axis=2) >= seen.sum(axis=2, keepdims=True)).argmax(axis=2)

    def place(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                bits = bits_of(b)
                values = block_values(bits, blocks)
                rows, keys = [], []
                for k, (_, width) in enumerate(blocks):
                    row, key = np.arange(len(bits)), np.full(len(bits), k, np.int64)
                    for level in range(depth):
                        d = np.bitwise_count(values[:, k] ^ vantage(k, level, width)).astype(np.int64)[row]
                        outer = d > middle[k, level]
                        visits = outer & (d <= middle[k, level] + near)
                        key = 2 * key + outer
                        row, key = np.concatenate((row, row[visits])), np.concatenate((key, key[visits] - 1))
                    rows.append(row)
                    keys.append(key + (k << 48))
                row = np.concatenate(rows)
                parts = [pa.array(bits[row, j].view(np.int64)) for j in range(sketch)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), b.column(0).take(pa.array(row)), *parts], names=["leaf", "id", *[f"s{j}" for j in range(sketch)]])

    sketches = [f"s{j}" for j in range(sketch)]
    placed = points.mapInArrow(place, "leaf long, id long, " + ", ".join(f"{x} long" for x in sketches))
    keys = ["leaf", "t0", "t1"]
    leaves = tiled(placed, "leaf", "id", LEAF_ROWS).select(*keys, "id", *sketches)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        def parts():
            for _, t in sorted_groups(batches, 3):
                if t.num_rows > 1:
                    own = np.stack([t.column(4 + j).to_numpy().view(np.uint64) for j in range(sketch)], axis=1)
                    a, b, d = leaf_edges(own, radius)
                    ids = t.column(3).to_numpy()
                    yield ids[a], ids[b], d.astype(np.int32)

        yield from in_batches(parts(), ["a", "b", "d"])

    return leaves.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, d int")


# --- fingerprints within RADIUS


def as_bits(fp: str) -> Column:
    """A long as the eight bytes that numpy reads back."""
    digits = F.lpad(F.hex(fp), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """All columns of docs (doc_id, text, and others) but the text, with fp, root and component_id, for every row; one that docs has in any
    case gets underscores after its name.

    component_id is the smallest doc_id reachable over links of at most RADIUS bits, root the smallest fingerprint. Equal
    fingerprints meet first, so copies never make pairs. Null and empty text: fingerprint zero, linked like any other. A null id
    takes part, but is never the smallest; a component of null ids only has a null id. Long texts count whole. No rows: none.
    """
    fp, root, component = (fresh(docs, n) for n in ("fp", "root", "component_id"))
    fps = cut(fingerprints(docs, into=fp))
    distinct = cut(fps.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("low")))
    points = distinct.select(F.col("fp").alias("id"), as_bits("fp").alias("bits"))
    roots = components(links(points, BLOCKS, NEAR, RADIUS, 1, 1).select("a", "b"))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    own = fresh(fps, "_fp")
    named = named.join(lowest, "root").select(F.col("fp").alias(own), F.col("root").alias(root), F.col("component_id").alias(component))
    return fps.join(named, F.col(fp) == F.col(own)).drop(own)


# --- documents of similar shingle sets


def differs() -> float:
    """Chance that a bit of the fingerprints of two equally large sets at JACCARD differs."""
    shared = 2 * JACCARD[0] / (JACCARD[0] + JACCARD[1])
    return math.acos(shared) / math.pi


def wide_blocks(rows: int) -> tuple[tuple[tuple[int, int], ...], int]:
    """Blocks for `rows` documents and the 64-bit words that hold them.

    A block is so wide that its tree can part the documents into shards of SHARD_ROWS; there are so many that two documents at JACCARD
    are within NEAR bits in none of them with chance MISS.
    """
    width = min(32, max(12, math.ceil(math.log2(max(rows, 2) / SHARD_ROWS)) + 6))
    p = differs()
    hit = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(NEAR + 1))
    number = math.ceil(math.log(MISS) / math.log(1 - hit))
    return tuple((k * width, width) for k in range(number)), max(SKETCH, -(-number * width // 64))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets, from sets (id, shingles), reach JACCARD."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared * JACCARD[1] >= JACCARD[0] * (len(s) + len(t) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, key: str = "row", text_col: str = "text") -> DataFrame:
    """(key, doc_id, root) for every row of docs (key, doc_id, text): rows of one root are connected by documents whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more.

    Wide fingerprints find the pairs: trees over their blocks, then SKETCH words of them. Each shard hands on the shortest edges that
    connect it. The shortest edge of each document is verified first, by the shingles of both texts, then all edges between documents
    that this has not connected. Documents of equal wide fingerprints count as one. Words are lower-cased (A-Z);
    texts of fewer than five words: the whole is one shingle; null and empty texts: all alike. Long texts count whole. No rows: none.
    """
    rows = docs.select(key, "doc_id", F.col(text_col).cast("binary").alias("text"))
    blocks, words = wide_blocks(rows.count())

    def fingerprinted(batches):
        for b in batches:
            parts = [b.column(2).slice(k, SLICE) for k in range(0, b.num_rows, SLICE)]  # few texts' shingles are held at once
            wide = pa.array([wide_fingerprint(s, words).tobytes() for p in parts for s in shingle_sets(p.to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), wide], names=[key, "doc_id", "bits"])

    light = with_field(rows.drop("text").schema, "bits", rows.schema["text"].dataType)
    wide = cut(rows.mapInArrow(fingerprinted, light))
    points = cut(wide.groupBy("bits").agg(F.min(key).alias(key))).withColumn("id", F.monotonically_increasing_id())  # written rows: the ids stay
    edges = links(points.select("id", "bits"), blocks, NEAR, SKETCH_RADIUS, words, SKETCH).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    edges = cut(edges.groupBy("a", "b").agg(F.min("d").alias("d")))
    ends = edges.select("a").unionByName(edges.select(F.col("b").alias("a")))

    def shingled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1).to_pylist())], pa.binary())], names=["id", "shingles"])

    asked = cut(points.join(ends.select(F.col("a").alias("id")).distinct(), "id").select("id", F.col(key).alias("_key")))
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(asked) if few else asked, F.col(key) == F.col("_key")).select("id", "text").mapInArrow(shingled, "id long, shingles binary")
    sets = cut(texts.dropDuplicates(["id"]))  # rows may be repeated whole
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    best = both.groupBy("a").agg(F.min(F.struct("d", "b")).alias("b")).select(F.least("a", "b.b").alias("a"), F.greatest("a", "b.b").alias("b")).distinct()
    best = cut(best)
    true = cut(similar(best, sets))
    roots = cut(components(true))
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    left = edges.join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    left = left.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v"))
    more = cut(similar(left, sets).join(left, ["a", "b"]).select(F.col("u").alias("a"), F.col("v").alias("b")))
    upper = components(more).select(F.col("node").alias("r"), F.col("root").alias("top"))  # of whole components
    nodes = roots.unionByName(upper.select(F.col("r").alias("node"), F.col("r").alias("root"))).distinct()
    roots = nodes.join(upper, nodes["root"] == upper["r"], "left").select("node", F.coalesce("top", "root").alias("root"))
    roots = roots.groupBy("node").agg(F.min("root").alias("root"))
    named = points.join(roots, points["id"] == roots["node"], "left").select(F.col("bits").alias("_bits"), F.coalesce("root", "id").alias("root"))
    return wide.join(named, wide["bits"] == named["_bits"]).select(key, "doc_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of similar_groups(): the row of the smallest doc_id stays, of several the one of
    least hash. Null ids come last; extra columns stay as they are. No rows: none."""
    key = fresh(docs, "row")
    keyed = docs.withColumn(key, row_key(docs))
    grouped = similar_groups(keyed.select(F.col(key).alias("row"), "doc_id", "text"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("b"))
    return repeat_rows(keyed, key, best.select(F.col("b.row").alias(key), F.lit(1).alias("n")))


def op8(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
