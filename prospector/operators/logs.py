"""Append-only logs, state tables, label queues and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return pick(rows, keys, F.col(seq).desc())


def earliest(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return pick(rows, keys, F.col(seq))


def ordinals(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Place within the key from 0, and the key's row count."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(seq)) - 1).withColumn("n_in_key", F.count("*").over(Window.partitionBy(key)))


def merge(old: DataFrame, new: DataFrame, keys: list[str], replace: list[str] = (), keep_first: list[str] = (), keep_if_null: list[str] = ()) -> DataFrame:
    """Upsert by keys: replace takes the new value, keep_first the first that is not null, keep_if_null the new one unless null."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    fresh = F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys[:1]])
    out = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    out += [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in replace]
    out += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep_first]
    out += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in keep_if_null]
    return joined.select(*out)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old and the first new row of each key that it lacks; null never equals null, so rows of null keys always come in."""
    first = pick(new.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, seq)
    nulls = new.where(" OR ".join(f"{k} IS NULL" for k in keys))
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns)).unionByName(nulls.select(*old.columns))


def disagreements(log: DataFrame, keys: list[str], annotator: str, fields: list[str], seq: str = "seq") -> DataFrame:
    """Keys with two or more annotators, and the fields that their latest records differ in; null is a value."""
    last = latest(log, [*keys, annotator], seq)
    differs = [F.count_distinct(F.coalesce(F.to_json(F.struct(f)), F.lit(""))).alias(f"_{f}") for f in fields]
    out = last.groupBy(*keys).agg(F.count("*").alias("annotators"), *differs).where("annotators >= 2")
    names = F.filter(F.array(*[F.when(F.col(f"_{f}") > 1, F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return out.select(*keys, "annotators", F.array_join(names, ",").alias("fields"), (F.size(names) > 0).alias("disagrees"))


def adjudicated(log: DataFrame, keys: list[str], kind: str = "kind", seq: str = "seq") -> DataFrame:
    """A key is settled if its last adjudication comes after its last annotation."""
    out = log.groupBy(*keys).agg(F.max(F.when(F.col(kind) == "adjudication", F.col(seq))).alias("a"), F.max(F.when(F.col(kind) == "annotation", F.col(seq))).alias("n"))
    return out.select(*keys, F.coalesce(F.col("a") > F.col("n"), F.col("a").isNotNull()).alias("settled"))


def queue(items: DataFrame, labels: DataFrame, keys: list[str], annotator: str, wanted: list[str]) -> DataFrame:
    """Items with the annotators they have and lack; fully covered items go."""
    have = labels.groupBy(*keys).agg(F.array_sort(F.collect_set(annotator)).alias("present"))
    out = items.join(have, keys, "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    out = out.withColumn("missing", F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col("present")))
    return out.where(F.size("missing") > 0).withColumn("present", F.array_join("present", ",")).withColumn("missing", F.array_join("missing", ","))


def sample_by_hash(rows: DataFrame, item: Column, size: int, seed: str) -> DataFrame:
    """The `size` items of least sha256(seed|item): the same on every run."""
    return rows.withColumn("_h", F.sha2(F.concat(F.lit(seed + "|"), item).cast("binary"), 256)).orderBy("_h").limit(size).drop("_h")


def stratified_queue(rows: DataFrame, stratum: str, quotas: dict[str, int], item: Column, seed: str, size: int) -> DataFrame:
    """Quotas of each stratum in hash order, then the rest in hash order until `size` rows are in.

    Only the first `size` rows of each stratum with a quota, and of all others together, can get in; only those are ranked.
    """
    r = rows.withColumn("_h", F.sha2(F.concat(F.lit(seed + "\0"), item).cast("binary"), 256))
    firsts = r.where(~F.coalesce(F.col(stratum).isin(*quotas), F.lit(False))).orderBy("_h").limit(size)
    for name in quotas:
        firsts = firsts.unionByName(r.where(F.col(stratum) == name).orderBy("_h").limit(size))
    ranked = firsts.withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy("_h")))
    quota = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum)), F.lit(0))
    return ranked.withColumn("_late", (F.col("_k") > quota).cast("int")).orderBy("_late", "_h").limit(size).drop("_h", "_k", "_late")


def best_per_patch(rows: DataFrame) -> DataFrame:
    """Rows (sha, patch_id, anchors, moved) without lesser copies of a patch: most anchors, not moved, least sha. Null patch ids all stay."""
    best = pick(rows.where("patch_id IS NOT NULL"), ["patch_id"], F.col("anchors").desc(), "moved", "sha")
    return best.unionByName(rows.where("patch_id IS NULL"))


def export(rows: DataFrame, path: str, order: list[str]) -> None:
    """One canonical JSON object a line, in order; readers see the old or the new files."""
    from prospector.functions.text import canonical_json

    rows.orderBy(*order).select(canonical_json(*rows.columns).alias("value")).write.mode("overwrite").text(path)
