"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

#: A word is a run of anything but the six ASCII white-space characters; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of names of large groups that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Edges that one task joins to components.
LOCAL_EDGES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="prospector-"))
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return named or at.get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there: lost executors recompute nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a table written to the shared folder, and its place: smaller than a checkpoint, and it can be dropped once it is used up."""
    at = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def drop(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of jobs that are done with: it does so when the driver's garbage is collected, a while after it.

    Only the disk that a run needs at once depends on this, never its result.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def word_count(col: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_field(schema: StructType, name: str, kind) -> StructType:
    return StructType([*schema.fields, StructField(name, kind)])


def holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and holds_map(kind.elementType)


def row_key(df: DataFrame) -> Column:
    """128 bits of hash over all columns, equal for repeated rows. Maps count as JSON, so maps in another order make another row."""
    own = [F.to_json(F.struct(F.col(f.name)), {"ignoreNullFields": "false"}) if holds_map(f.dataType) else F.col(f.name) for f in df.schema.fields]
    own += [F.col(f.name).isNull() for f in df.schema.fields]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"))


def repeat_rows(df: DataFrame, key: str, times: DataFrame) -> DataFrame:
    """df with each distinct row as often as times (key, n) says; key is row_key() in a column of both.

    Repeated rows fall together before they are shuffled, so a row repeated without end makes no hot task.
    """
    n = fresh(df, "n")
    one = df.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))).where(F.col(n) == 1).drop(n)
    counted = times.groupBy(key).agg(F.sum("n").cast("int").alias(n)).where(F.col(n) > 0)
    return one.join(counted, key).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n, key)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a-b, all within one batch."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(jumped := root[root], root):
            root = jumped
    return root


def forest(batches):
    """The edges (u, v) of one partition as stars: each node but the smallest of its group, and that smallest node."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root the smallest node; nodes without edges are absent.

    First each task joins what is linked within LOCAL_EDGES edges, which leaves a forest; edges that fit one task are done then. The
    others go through alternating large-star and small-star steps: each step is a map-side combined minimum and a join with it, so that
    a hub's edges are never gathered in one task, and the number of rounds is logarithmic in practice.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    parts = -(-e.count() // LOCAL_EDGES)
    e = cut(e.coalesce(max(1, parts)).mapInArrow(forest, "u long, v long"))
    before = None
    while parts > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def sorted_groups(batches, keys: int):
    """(key, table) for each run of equal values in the first `keys` long columns of sorted record batches; holds one run at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)])
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [b.num_rows]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = tuple(key[:, lo].tolist())
            if now != held_key:
                if held:
                    yield held_key, pa.Table.from_batches(held)
                held, held_key = [], now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held_key, pa.Table.from_batches(held)


def in_batches(parts, names: list[str], rows: int = 50_000):
    """Record batches of about `rows` rows from tuples of equally long arrays."""
    held, n = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)


def tiled(df: DataFrame, group: str, member: str, rows: int) -> DataFrame:
    """df with (group, t0, t1, mine): groups over `rows` rows are dealt into tiles, and a row goes to every pair of tiles it is in.

    Any two rows of a group meet in one (group, t0, t1); the group itself never meets in one task.
    """
    big = cut(df.groupBy(group).count().where(F.col("count") > rows).select(group, F.ceil(F.col("count") / rows).cast("int").alias("tiles")))
    many = big.limit(BROADCAST_ROWS + 1).count()
    if not many:
        return df.withColumns({k: F.lit(0) for k in ("mine", "t0", "t1")})
    out = df.join(F.broadcast(big) if many <= BROADCAST_ROWS else big, group, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    out = out.withColumn("mine", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.withColumn("t0", F.least("mine", "other")).withColumn("t1", F.greatest("mine", "other")).drop("tiles", "other")
