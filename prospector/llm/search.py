"""Ranked lexical search: postings in windows of documents by id, scores scattered into small arrays, best rows harvested into heaps."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospector.llm.common import drop, fresh, stored, table

#: Documents of a window: its scores, 64 KB, stay in a core's cache.
WINDOW = 8192
#: Documents of one scoring task.
TASK_ROWS = 8 * WINDOW
#: Bytes of queries whose terms are searched in one pass over the documents; more queries take more passes.
BLOCK = 4 << 20
TOP = 20
#: ASCII bytes other than letters and digits part terms; all other bytes, A-Z as a-z, make them.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def postings(docs: DataFrame, known) -> DataFrame:
    """(doc_id, n, terms, times) of each row of docs (doc_id, text): its length in terms, and numbers of the broadcast terms `known` that
    it holds, ascending, and how often, both as packed 32-bit integers."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        number = known.value
        for b in batches:
            n, own, times = [], [], []
            for i in range(b.num_rows):
                ts = terms(b.column(1)[i].as_py())
                found = Counter(map(number.get, ts))
                found.pop(None, None)
                at = np.fromiter(found.keys(), np.int32, len(found))
                order = np.argsort(at)
                n.append(len(ts))
                own.append(at[order].tobytes())
                times.append(np.fromiter(found.values(), np.int32, len(found))[order].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(times, pa.binary())], names=["doc_id", "n", "terms", "times"])

    return rows.mapInArrow(count, f"doc_id {kind}, n long, terms binary, times binary")


def numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit integers packed in a column of blobs, and how many each row has."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), np.int32), np.array([len(x) // 4 for x in held], np.int64)


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term. A task sends one number a term, which tasks sum up before it is shuffled."""

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            df += np.bincount(numbers(b.column(0))[0], minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in index.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # terms of one block of queries
        out[r["term"]] = r["df"]
    return out


def windows(batches):
    """Record batches of WINDOW rows from a task's sorted ones, the last one shorter."""
    held, rows = [], 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, WINDOW - rows)
            b = b.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == WINDOW:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def best(index: DataFrame, queries, weight: np.ndarray, n_docs: int, length: int, top: int) -> DataFrame:
    """(query, doc_id, score) rows of the `top` best documents of each task for each of the broadcast queries, term numbers and their
    repeats. A task goes over its part of the index, sorted by doc_id, in windows of WINDOW documents."""
    kind = index.schema["doc_id"].dataType

    def search(batches):
        asked = queries.value
        heaps: list[list] = [[] for _ in asked]
        scores = np.zeros(WINDOW, np.int64)
        there = np.zeros(WINDOW, bool)
        eights = there.view(np.uint64)  # eight documents a word
        ids, seen = [], 0
        for t in windows(batches):
            own, each = numbers(t["terms"])
            times = numbers(t["times"])[0].astype(np.int64)
            doc = np.repeat(np.arange(t.num_rows), each)
            m = 100 - 25 + (25 * t["n"].to_numpy() * n_docs) // length
            gain = weight[own] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
            order = np.argsort(own, kind="stable")
            own, doc, gain = own[order], doc[order], gain[order]
            at = np.searchsorted(own, np.arange(len(weight) + 1)).tolist()
            for q, (numbered, repeats) in enumerate(asked):
                for k, r in zip(numbered, repeats, strict=True):
                    lo, hi = at[k], at[k + 1]
                    if lo < hi:
                        there[doc[lo:hi]] = True
                        scores[doc[lo:hi]] += gain[lo:hi] * r if r > 1 else gain[lo:hi]
                heap = heaps[q]
                least = heap[0][0] if len(heap) == top else 0
                words = np.flatnonzero(eights)
                hit = (words[:, None] * 8 + np.arange(8)).ravel()
                hit = hit[scores[hit] > least]  # ids ascend, so a later document loses a tie
                if len(hit) > top:
                    cut = np.partition(scores[hit], len(hit) - top)[len(hit) - top]
                    hit = hit[scores[hit] >= cut]
                for i in hit.tolist():
                    row = (int(scores[i]), -(seen + i))
                    if len(heap) < top:
                        heapq.heappush(heap, row)
                    elif row > heap[0]:
                        heapq.heapreplace(heap, row)
                scores[:] = 0
                eights[:] = 0
            ids.append(t["doc_id"].combine_chunks())
            seen += t.num_rows
        found = [(q, -place, score) for q, heap in enumerate(heaps) for score, place in heap]
        if found:
            q, place, score = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([q, pa.chunked_array(ids).take(place).combine_chunks(), score], names=["query", "doc_id", "score"])

    return index.mapInArrow(search, f"query long, doc_id {kind.simpleString()}, score long")


def ranked(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """The `top` best rows of each query with their rank: of each of several shares of the tasks first, so that the rows of all tasks
    don't meet in one."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "tie"]
    share = rows.withColumn("tie", F.monotonically_increasing_id()).withColumn("share", F.spark_partition_id() % salts)
    few = share.withColumn("rank", F.row_number().over(Window.partitionBy("query", "share").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top).select("query", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """The `top` best documents (doc_id, text) for each row of items (item_id, text): (item_id, rank, doc_id, score).

    Queries go in blocks of about `block` bytes. For a block, one pass over all whole texts packs the postings of its terms into a row a
    document, and documents are dealt by ranges of doc_id, so only postings are shuffled. Each task keeps a heap of `top` rows a query.
    Weights follow the number of documents that hold the term, and scores are integers, so they equal any other order of summing up.
    Below 2**63: score, and 25 * a document's terms * documents.

    Null and empty texts hold no terms: such a document is never found, and such an item has no row. Documents without terms count for
    nothing. Equal scores go by ascending doc_id, null last; repeated rows are documents of their own, and repeated items get their rows
    each. Other columns are not looked at. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    uid = fresh(items, "uid")
    asked, asked_at = stored(items.select("item_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias(uid)))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block)
    out = None
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(uid), F.lit(blocks)) == k).orderBy(uid).collect()  # about `block` bytes
        counted = [Counter(terms(r["text"])) for r in rows]
        number = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        index, index_at = stored(postings(docs, spark.sparkContext.broadcast(number)))
        n_docs, length, n_rows = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        df = frequencies(index, len(number))
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        queries = spark.sparkContext.broadcast([([number[t] for t in c], list(c.values())) for c in counted])
        tasks = -(-n_rows // TASK_ROWS)
        dealt = index.where(F.length("terms") > 0).repartitionByRange(max(tasks, 1), F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"))
        found = ranked(best(dealt, queries, weight, n_docs, max(length, 1), top), top, max(1, math.isqrt(tasks)))
        names = spark.createDataFrame([(q, r[uid]) for q, r in enumerate(rows)], f"query long, {uid} long")
        part, _ = stored(found.join(F.broadcast(names), "query").select(uid, "rank", "doc_id", "score"))
        drop(spark, index_at)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return asked.join(docs.select("doc_id"), F.lit(False)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out.join(asked.select(uid, "item_id"), uid).select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS ts FROM documents),
i AS (SELECT item_id, row_number() OVER () AS i, {_TERMS} AS ts FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
c AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
g AS (SELECT r, doc_id, 100 - 25 + ((25 * CAST(len(ts) AS BIGINT) * n) // l) AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN g USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
