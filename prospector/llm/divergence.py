"""Audit how sources of a language differ in their terms: groups stay where they are while packed vectors of their peers go round."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospector.llm.common import drop, stored, table

#: Documents of a language that a kept term is in at least, and terms named for a group.
LEAST_DOCS, TOP = 10, 10
#: Entries of a task's tallies before they are sent on.
FLUSH = 1_000_000
#: Terms of one slice of a language's vocabulary, on average; a vector holds a group's terms of one slice.
SLICE = 16_384
#: Rows of a file of the result.
FILE_ROWS = 1_000_000
#: Cells into which the groups of a language are dealt, at least, and groups of a cell at most.
CELLS, CELL_GROUPS = 4, 64
#: ASCII bytes other than letters part terms; all other bytes, A-Z as a-z, make them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
TALLY = "lang string, term binary, docs long, by array<struct<source:string,n:long>>"


def tallies(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, by): documents of a task that hold the term, and its occurrences in each source; one row a language and term."""

    def flushed(by, held):
        for lang, counted in held.items():
            words = list(counted)
            number = dict(zip(words, range(len(words)), strict=True))
            own = [(s, c) for (other, s), c in by.items() if other == lang]
            at = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for _, c in own])
            n = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in own])
            source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
            order = np.argsort(at, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(words)))))
            in_docs = np.fromiter(counted.values(), np.int64, len(words))
            names = pa.array([s for s, _ in own], pa.string())
            for lo in range(0, len(words), 50_000):
                hi = min(lo + 50_000, len(words))
                some = order[ends[lo] : ends[hi]]
                pairs = pa.StructArray.from_arrays([names.take(pa.array(source[some])), pa.array(n[some])], names=["source", "n"])
                lists = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (hi - lo), pa.string()), pa.array(words[lo:hi], pa.binary()), pa.array(in_docs[lo:hi]), lists], names=["lang", "term", "docs", "by"])

    def tally(batches):
        by, held = defaultdict(Counter), defaultdict(Counter)
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = text.as_py().translate(FOLD).split()
                if words:
                    by[lang, source].update(words)
                    held[lang].update(set(words))
            if sum(map(len, by.values())) > FLUSH:
                yield from flushed(by, held)
                by, held = defaultdict(Counter), defaultdict(Counter)
        yield from flushed(by, held)

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(tally, TALLY)


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, all, first): occurrences of each kept term in each source that has it and in its language; first marks one
    row a term. One shuffle of the tallies; all that follows of a term stays in its partition."""
    word = Window.partitionBy("lang", "term")
    common = tallies(docs).repartition("lang", "term").withColumn("in_docs", F.sum("docs").over(word)).where(F.col("in_docs") >= least)
    each = common.select("lang", "term", F.explode("by").alias("s")).groupBy("lang", "term", "s.source").agg(F.sum("s.n").alias("n"))
    return each.withColumn("all", F.sum("n").over(word)).withColumn("first", F.row_number().over(word.orderBy("source")) == 1)


def scaled(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)); without terms 1. Exact for any counts."""
    whole = lambda c: c.cast("decimal(20,0)")
    top, below = (whole(count) + 2) * F.lit(10**9).cast("decimal(10,0)"), whole(total) + whole(terms) * 2
    return F.when(terms > 0, 1 + F.call_function("div", top, F.when(below > 0, below))).otherwise(F.lit(1)).cast("long")


def apart(p, q):
    """How far two scaled shares are apart."""
    return (p - q) * (p - q) // (p + q)


def packed(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), np.int64)


def vector(t: pa.Table) -> pa.Table:
    """A group's terms of one slice as one packed row, with the heap of those that are most over the language's share."""
    t = t.filter(pa.compute.is_valid(t["id"])) if t["id"].null_count < t.num_rows else t.slice(0, 1)
    some = t["id"].null_count == 0
    order = np.argsort(t["id"].to_numpy()) if some else np.zeros(0, np.int64)
    ids, p, q = (t[c].to_numpy()[order].astype(np.int64) if some else order for c in ("id", "p", "q"))
    over = np.flatnonzero(p > q)
    far = apart(p[over], q[over])
    if len(far) > TOP:
        enough = far >= np.partition(far, len(far) - TOP)[len(far) - TOP]
        over, far = over[enough], far[enough]
    named = t["term"].take(pa.array(order[over])).to_pylist() if some else []
    top = heapq.nsmallest(TOP, zip((-far).tolist(), named, strict=True))
    row = {c: t[c][0].as_py() for c in ("lang", "slice", "source", "cell", "v", "p0")}
    row |= {"ids": packed(np.diff(ids, prepend=0)), "ps": packed(p), "top": [{"term": w, "value": -x} for x, w in top]}
    return pa.Table.from_pylist([row], VECTOR)


VECTOR = pa.schema(
    [("lang", pa.string()), ("slice", pa.int32()), ("source", pa.string()), ("cell", pa.int32()), ("v", pa.int64()), ("p0", pa.int64()), ("ids", pa.binary()), ("ps", pa.binary())]
    + [("top", pa.list_(pa.struct([("term", pa.binary()), ("value", pa.int64())])))]
)
VECTOR_DDL = "lang string, slice int, source string, cell int, v long, p0 long, ids binary, ps binary, top array<struct<term:binary,value:long>>"
MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("v", pa.int64()), ("value", pa.int64()), ("terms", pa.int64()), ("rest", pa.int64())])
MET_DDL = "lang string, source string, item string, v long, value long, terms long, rest long"


def opened(t: pa.Table) -> list[tuple]:
    rows = t.select(["source", "p0", "ids", "ps"]).to_pylist()
    return [(r["source"], r["p0"], np.cumsum(unpacked(r["ids"])), unpacked(r["ps"])) for r in rows]


def met(a: tuple, others: list[tuple]):
    """For a group and each of others: what the terms of either add up to, how many they are, and what any other term adds.

    The group's shares are laid out once; each peer costs as much as it has terms, and the group's own.
    """
    _, p0, ids, p = a
    wide = 1 + max([int(x[-1]) for _, _, x, _ in [a, *others] if len(x)], default=-1)
    mine, has, theirs = np.full(wide, p0), np.zeros(wide, bool), np.zeros(wide, np.int64)
    mine[ids], has[ids] = p, True
    for _, q0, jds, q in others:
        theirs[:] = q0
        theirs[jds] = q
        alone = ~has[jds]
        value = apart(p, theirs[ids]).sum() + apart(mine[jds[alone]], q[alone]).sum()
        yield int(value), int(len(ids) + alone.sum()), int(apart(p0, q0))


def pairs(lang: str, v: int, home: list[tuple], guests: list[tuple] | None) -> pa.Table:
    """Both directions of each pair of a home group and a guest, or of two home groups."""
    out = []
    for k, a in enumerate(home):
        others = home[k + 1 :] if guests is None else guests
        for b, (value, terms, rest) in zip(others, met(a, others), strict=True):
            out += [{"lang": lang, "source": x[0], "item": y[0], "v": v, "value": value, "terms": terms, "rest": rest} for x, y in ((a, b), (b, a))]
    return pa.Table.from_pylist(out, MET)


def at_home(t: pa.Table) -> pa.Table:
    return pairs(t["lang"][0].as_py(), t["v"][0].as_py(), opened(t), None)


def meeting(home: pa.Table, guests: pa.Table) -> pa.Table:
    if not home.num_rows or not guests.num_rows:
        return MET.empty_table()
    return pairs(home["lang"][0].as_py(), home["v"][0].as_py(), opened(home), opened(guests))


def partner(cell: Column, cells: Column, turn: int) -> Column:
    """Whom a cell meets in a turn of a tournament of an even number of cells: the last one stays, the others go round, and after
    cells - 1 turns each has met each once."""
    ring = cells - 1
    other = F.pmod(F.lit(2 * turn) - cell, ring)
    return F.when(cell == ring, F.pmod(F.lit(turn), ring)).when(other == cell, ring).otherwise(other).cast("int")


def rotate(spark, vectors_at: str, cells: DataFrame) -> tuple[DataFrame, list[str]]:
    """Meetings of all groups of each (lang, slice), from written vectors and the number of cells of each language.

    Each cell stays in its partition. In a turn only the guests' packed vectors are shuffled, to the partition of the cell they meet, and
    the turn's sums are written before the next one. A lost partition is read again from the written vectors. Returns the sums and the
    places where they are written.
    """
    key = ["lang", "slice", "cell"]
    read = lambda: spark.read.parquet(vectors_at).drop("top")
    # as many partitions as cells of slices, so that none waits for another
    places = max(2, read().select(*key).distinct().count())
    places = min(places, 2000)
    home = read().repartition(places, *key).persist()
    turns = (cells.agg(F.max("cells")).first()[0] or 1) - 1
    out, at = stored(home.groupBy(*key).applyInArrow(at_home, MET_DDL).coalesce(places))
    written = [at]
    for turn in range(turns):
        met_by = partner(F.col("cell"), F.col("cells"), turn)
        going = read().join(F.broadcast(cells), "lang").where(F.col("cells") - 1 > turn).withColumn("host", met_by)
        # the lower cell is host in even sums, the higher one in odd ones
        even = F.pmod(F.col("host") + F.col("cell"), F.lit(2)) == 0
        going = going.where(F.when(even, F.col("host") < F.col("cell")).otherwise(F.col("host") > F.col("cell"))).drop("cell", "cells").withColumnRenamed("host", "cell")
        seen, at = stored(home.groupBy(*key).cogroup(going.groupBy(*key)).applyInArrow(meeting, MET_DDL).coalesce(places))
        out, written = out.unionByName(seen), [*written, at]
    home.unpersist()
    return out, written


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source), nulls as ''.

    A group is a language and a source; it exists with its first document, whatever its text. A language keeps the terms in at least
    `least` of its documents. Shares are scaled to whole numbers with 2 added to every count, so all sums are exact, and counts of any
    size fit. Part pair: every other source of the language by how far it is, all of them; terms that neither has are added as one
    product. Part term: up to `top` (10 at most) terms that the group has more of than its language. Ties go by item, in UTF-8 order.

    Empty tables give no rows, a language of one source has no pairs, one without kept terms has pairs of value 0 and no terms.
    Repeated rows count each; other columns, doc_id among them, are not looked at. The result has a row for every two sources of a
    language, so it grows with their square by what is asked.
    """
    if top > TOP:
        raise ValueError(f"at most {TOP} terms")
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept, kept_at = stored(kept_terms(docs, least))
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    groups = docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "v"]).withColumn("p0", scaled(F.lit(0), F.col("total"), F.col("v")))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("of", F.count("*").over(Window.partitionBy("lang")))
    wanted = F.greatest(F.lit(CELLS), F.ceil(F.col("of") / CELL_GROUPS))
    groups = groups.withColumn("cells", (wanted + wanted % 2).cast("int")).withColumn("cell", (F.col("place") % F.col("cells")).cast("int"))
    groups, groups_at = stored(groups.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("v") / SLICE)).cast("int")).coalesce(8))  # one row a group
    langs = groups.groupBy("lang").agg(F.max("slices").alias("slices"), F.max("cells").alias("cells"))

    # within a language and slice terms are numbered from 0, so that shares can be laid out in arrays
    one = kept.where("first").select("lang", "term").join(langs, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    numbered = one.select("lang", "term", "slice", (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).alias("id"))
    facts = groups.select("lang", "source", "cell", "v", "p0", "total", "lang_total")
    full = kept.drop("first").join(numbered, ["lang", "term"]).join(facts, ["lang", "source"])
    full = full.select("lang", "slice", "source", "cell", "v", "p0", "id", "term", scaled(F.col("n"), F.col("total"), F.col("v")).alias("p"), scaled(F.col("all"), F.col("lang_total"), F.col("v")).alias("q"))
    grid = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "source", "cell", "v", "p0")
    for c, kind in full.dtypes[6:]:
        grid = grid.withColumn(c, F.lit(None).cast(kind))
    vectors, vectors_at = stored(full.unionByName(grid).groupBy("lang", "slice", "source").applyInArrow(vector, VECTOR_DDL))

    seen, written = rotate(docs.sparkSession, vectors_at, langs.select("lang", "cells"))
    pair = seen.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("rest").alias("rest"), F.max("v").alias("v"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + (F.col("v") - F.col("terms")) * F.col("rest")).alias("value"))
    term = vectors.select("lang", "source", F.lit("term").alias("part"), F.explode("top").alias("t")).select("lang", "source", "part", F.col("t.term").cast("string").alias("item"), "t.value")
    both = pair.unionByName(term).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    rows = groups.agg(F.sum(F.col("of") + top)).first()[0] or 0
    out, _ = stored(both.where((F.col("part") == "pair") | (F.col("rank") <= top)).coalesce(1 + rows // FILE_ROWS))
    for at in (kept_at, groups_at, vectors_at, *written):
        drop(docs.sparkSession, at)
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT lang, source, r, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS n, CAST(count(*) AS HUGEINT) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 10
"""
