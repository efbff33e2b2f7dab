"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths, and base rules on words, symbols and lines."""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.llm.common import table

#: Most percent of a text's word characters that may lie in n-grams seen earlier in it, for each n, and in lines seen earlier in it.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
#: Words of a window of the base rule, fewest words, and most percent of words in repeated windows.
BASE_N, MIN_WORDS, BASE_LIMIT = 3, 50, 50
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that are measured at once; one longer text is measured alone.
CHUNK = 4 << 20


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of each number that look random."""
    x = x.astype(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Those of the window starts `at` whose n words stand at another of them in the same document, and which of them come later than the
    first. Windows are told apart by a rolling hash; equal hashes are compared word by word, and a collision takes another seed."""
    with np.errstate(over="ignore"):
        value, factor = mixed(ids, seed), np.uint64(2 * seed + 0x5851F42D4C957F2D)
        h = mixed(doc[at], seed + 1)
        for k in range(n):
            h = h * factor + value[at + k]
        h = mixed(h, seed)
    low = np.sort(h)
    twice = low[1:][low[1:] == low[:-1]]
    if not len(twice):
        return at[:0], np.zeros(0, bool)
    there = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    at, h = at[there], h[there]
    order = np.argsort(h, kind="stable")  # at ascends, so the first of equal hashes is the first in the text
    same = h[order][1:] == h[order][:-1]
    a, b = at[order][:-1][same], at[order][1:][same]
    if (doc[a] != doc[b]).any() or any((ids[a + k] != ids[b + k]).any() for k in range(n)):
        return repeated(ids, doc, at, n, seed + 1)
    later = np.zeros(len(at), bool)
    later[order[1:][same]] = True
    return at, later


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n words at any of starts."""
    edge = np.zeros(words + 1, np.int32)
    edge[starts] = 1
    edge[1:] -= np.concatenate((np.zeros(n - 1, np.int32), edge[: words + 1 - n]))[:words] if words >= n else 0
    return np.cumsum(edge[:words]) > 0


def lines_of(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and the word characters in them."""
    own = [x for x in text.split(b"\n") if x and not x.isspace()]
    if len(own) == len(set(own)):
        return 0, 0
    seen: set[bytes] = set()
    n = chars = 0
    for x in own:
        if x in seen:
            n += 1
            chars += points(b"".join(x.split()))
        seen.add(x)
    return n, chars


def points(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def figures(texts: list[bytes], lengths) -> list[np.ndarray]:
    """For each text: words, characters in words, symbols, repeated lines, words in repeated windows of BASE_N, characters in repeated
    lines, and characters in later windows for each length."""
    split = [t.split() for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    flat = list(chain.from_iterable(split))
    known = dict(zip(dict.fromkeys(flat), count()))
    ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
    joined = np.frombuffer(b"".join(known), np.uint8)
    size = np.fromiter(map(len, known), np.int64, len(known))
    own = np.add.reduceat(((joined & 0xC0) != 0x80).astype(np.int64), np.cumsum(size) - size) if len(known) else size
    chars = own[ids]
    doc = np.repeat(np.arange(len(texts)), n_words)
    total = lambda x: np.bincount(doc, weights=x, minlength=len(texts)).astype(np.int64)  # noqa: E731  below 2**53: exact
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(ids))  # words from here to the end of the text
    lines = [lines_of(t) for t in texts]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    dup, at = {}, np.arange(len(ids))
    for n in range(BASE_N, max(lengths) + 1):
        # a repeated window begins with a repeated shorter one
        at, later = repeated(ids, doc, at[left[at] >= n], n)
        if n == BASE_N:
            repeat_words = total(covered(at, n, len(ids)))
        if n in lengths:
            dup[n] = total(covered(at[later], n, len(ids)) * chars)
    return [n_words, total(chars), np.array(symbols), np.array([x[0] for x in lines]), repeat_words, np.array([x[1] for x in lines]), *[dup[n] for n in lengths]]


def chunks(texts):
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def rules(docs: DataFrame, limits: dict[int, int] | None = None, line_limit: int = LINE_LIMIT) -> DataFrame:
    """What the rules say on each row of docs (doc_id, text): one row each, in no shuffle and by whole texts.

    A text fails the base rules if it has under MIN_WORDS words or over BASE_LIMIT percent of them in windows of BASE_N words that stand
    in it twice or more, the first included. Else it is kept if, for each n of limits, no more than that percent of its word characters
    lie in n-grams that stand earlier in the text, each character counted once, and no more than line_limit percent in lines that stand
    earlier. n-grams go over ends of lines. Null and empty texts have no words, so they fail. Repeated rows and ids are measured one by
    one, a null id is kept, and other columns are not looked at. No rows: none. A long text is measured whole, in one task.
    """
    limits = dict(sorted((limits or LIMITS).items()))
    if min(limits) < BASE_N:
        raise ValueError(f"n-grams of at least {BASE_N} words")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in limits]]

    def measured(batches):
        for b in batches:
            found = [figures(part, list(limits)) for part in chunks(t or b"" for t in b.column(1).to_pylist())]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]], names=["doc_id", *names])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(measured, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_LIMIT * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for n, most in limits.items():
        fine &= 100 * F.col(f"dup_chars_{n}") <= most * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)


def op13(spark, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_KEPT = " AND ".join(["100 * dup_line_chars <= 20 * word_chars", *[f"100 * coalesce(c{n}, 0) <= {most} * word_chars" for n, most in LIMITS.items()]])
_SUMS = ", ".join([f"sum(len) FILTER (n = {n} AND later) AS c{n}" for n in LIMITS])

#: The same rules by joined words and windows, for small tables.
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM w),
g AS (SELECT p.r, k, word, n, CASE WHEN k + n - 1 <= len(ws) THEN array_to_string(ws[k : k + n - 1], ' ') END AS gram
      FROM p JOIN w USING (r), (VALUES (3), (5), (6), (7), (8), (9), (10)) l(n)),
t AS (SELECT r, k, word, n, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, n, gram) > 1 AS twice,
        gram IS NOT NULL AND row_number() OVER (PARTITION BY r, n, gram ORDER BY k) > 1 AS later FROM g),
c AS (SELECT r, n, length(word) AS len, bool_or(twice) OVER s AS twice, bool_or(later) OVER s AS later FROM t
      WINDOW s AS (PARTITION BY r, n ORDER BY k RANGE BETWEEN n - 1 PRECEDING AND CURRENT ROW)),
f AS (SELECT r, count(*) FILTER (n = 3) AS n_words, sum(len) FILTER (n = 3) AS word_chars, count(*) FILTER (n = 3 AND twice) AS n_repeat_words, {_SUMS} FROM c GROUP BY r),
l AS (SELECT r, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
e AS (SELECT r, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
      FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY k) AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE again > 1 GROUP BY r),
a AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(e.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(e.chars, 0) AS dup_line_chars, f.* EXCLUDE (r, n_words, word_chars, n_repeat_words)
      FROM d LEFT JOIN f USING (r) LEFT JOIN e USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_KEPT} AS kept FROM b
"""
