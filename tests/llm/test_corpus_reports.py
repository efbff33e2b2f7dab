"""Search, source audit and quality rules against brute force on small tables with nulls, empty and long texts, ties, repeated rows and
clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospector.llm import divergence, quality, search

DOCS = "doc_id long, text string, lang string, source string, rank long, score long, n long, slice long, uid long, kept long"
ALNUM, ALPHA, WORD = (re.compile(p) for p in (r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"))


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def corpus(seed=3, n=150):
    r = random.Random(seed)
    words = ["".join(r.choices("abcÉßé1", k=r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choices(words, weights=[1 / (k + 1) for k in range(300)], k=r.randint(0, 120))) for _ in range(n)]
    texts += [None, "", "\n \t", "A-B_c!É9", "x" * 4000, "same " * 400, "Line one\nLine one\n" * 40, " ".join(r.choices(words, k=20_000)), texts[3], texts[3], "a\x85b\xa0c d"]
    return texts


def table(spark, texts, ids=None):
    r = random.Random(5)
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, r.choice(["en", "de", None]), r.choice(["a", "É", "b", None, "Z"]), 1, 2, 3, 4, 5, 6) for i, t in zip(ids, texts, strict=True)], DOCS)


def ranks(docs, items, top):
    """docs: (doc_id, text) with null ids last; items: texts."""
    ts = [ALNUM.findall(lower(t)) for _, t in docs]
    n, length = sum(map(bool, ts)), sum(map(len, ts))
    df = Counter(w for t in ts for w in set(t))
    out = []
    for q, item in enumerate(items):
        found = []
        for (i, _), t in zip(docs, ts, strict=True):
            tf = Counter(t)
            m = 75 + (25 * len(t) * n) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in ALNUM.findall(lower(item)) if tf[w])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(q, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, block", [(search.WINDOW, search.BLOCK), (16, 25_000)])
def test_search(spark, window, block, monkeypatch):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "TASK_ROWS", window * 2)
    texts = corpus()
    ids = [7 * (k % 50) + k for k in range(len(texts))]
    ids[-1] = ids[-2]
    ids[4] = None
    asked = [texts[0], "É9 c c C", None, "", "!!", texts[-4], "nowhere", texts[3]]
    items = spark.createDataFrame([(k, t, k) for k, t in enumerate(asked)], "item_id long, text string, UID long")
    got = search.search(table(spark, texts, ids), items, top=5, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == ranks(list(zip(ids, texts, strict=True)), asked, 5)
    assert got.where("item_id = 7").count() == 5


def test_search_counts_repeated_items_and_empty_tables(spark):
    docs, items = table(spark, ["b a", "a b", "a"]), spark.createDataFrame([(1, "a b"), (1, "a b")], "item_id long, text string")
    assert sorted(map(tuple, search.search(docs, items, top=2).select("item_id", "rank", "doc_id").collect())) == [(1, 1, 0), (1, 1, 0), (1, 2, 1), (1, 2, 1)]
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def audited(rows, least):
    """rows of (lang, source, text)."""
    by, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        ts = ALPHA.findall(lower(text))
        by[lang or "", source or ""].update(ts)
        docs[lang or ""].update(set(ts))
    out = []
    for (lang, source), own in by.items():
        kept = [w for w, n in docs[lang].items() if n >= least]
        total = lambda c: sum(c[w] for w in kept)  # noqa: B023, E731
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (total(c) + 2 * len(kept))  # noqa: B023, E731
        far = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum((c for (other, _), c in by.items() if other == lang), Counter())
        peers = [(-sum(far(share(own, w), share(c, w)) for w in kept), s) for (other, s), c in by.items() if other == lang and s != source]
        terms = [(-far(share(own, w), share(whole, w)), w) for w in kept if own[w] and share(own, w) > share(whole, w)]
        for part, found in (("pair", sorted(peers)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("cells, flush, size", [(4, 10**6, 10**5), (2, 50, 20)])
def test_audit(spark, cells, flush, size, monkeypatch):
    for name, v in (("CELLS", cells), ("FLUSH", flush), ("SLICE", size), ("CELL_GROUPS", 2)):
        monkeypatch.setattr(divergence, name, v)
    docs = table(spark, corpus() * 2)
    docs = docs.unionByName(docs.where("lang = 'de'").limit(3).withColumn("lang", F.lit("few"))).unionByName(docs.limit(1).withColumn("lang", F.lit("one")))
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(rows, 10)


def test_audit_of_nothing(spark):
    docs = table(spark, ["a"])
    assert divergence.audit(docs.limit(0)).count() == 0
    assert divergence.audit(docs).count() == 0  # one source, no kept term


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 7 * 10**12, 9 * 10**14, 3 * 10**8
    got = spark.range(1).select(divergence.scaled(F.lit(n), F.lit(total), F.lit(v))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_tournament_lets_each_pair_meet_once(spark):
    for cells in (2, 4, 10):
        met = Counter()
        for turn in range(cells - 1):
            df = spark.range(cells).select(F.col("id").cast("int").alias("c"), divergence.partner(F.col("id").cast("int"), F.lit(cells), turn).alias("p"))
            at = {r["c"]: r["p"] for r in df.collect()}
            assert all(at[at[c]] == c != at[c] for c in at)
            met.update(tuple(sorted((c, p))) for c, p in at.items() if c < p)
        assert set(met.values()) == {1} and len(met) == cells * (cells - 1) // 2


def test_homes_are_not_shuffled_again(spark):
    df = spark.range(100).selectExpr("id % 4 AS k", "id")
    home = df.repartition(7, "k").persist()
    going = spark.range(100).selectExpr("id % 4 AS k", "id")
    assert home.count() == 100
    plan = home.groupBy("k").cogroup(going.groupBy("k")).applyInArrow(lambda a, b: a, "k long, id long")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryTableScan")[0] and plan.count("Exchange") > 1
    home.unpersist()


def measured(text):
    ws = WORD.findall(text or "")
    windows = lambda n: [tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)]
    def inside(n, first):
        seen, words = Counter(), set()
        full = Counter(windows(n))
        for k, w in enumerate(windows(n)):
            if (full[w] > 1) if first else seen[w]:
                words |= set(range(k, k + n))
            seen[w] += 1
        return words
    chars = sum(map(len, ws))
    lines, seen, dup, dup_chars = (text or "").split("\n"), set(), 0, 0
    for x in lines:
        if WORD.search(x):
            dup, dup_chars = (dup + 1, dup_chars + sum(map(len, WORD.findall(x)))) if x in seen else (dup, dup_chars)
            seen.add(x)
    again = len(inside(3, True))
    failed = len(ws) < 50 or 100 * again > 50 * len(ws)
    far = [100 * sum(len(ws[k]) for k in inside(n, False)) > most * chars for n, most in quality.LIMITS.items()]
    return len(ws), chars, sum(map((text or "").count, "#*$%&|<>")), dup, again, failed, not failed and not any(far) and 100 * dup_chars <= 20 * chars


@pytest.mark.parametrize("chunk", [quality.CHUNK, 100])
def test_quality(spark, chunk, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    r = random.Random(8)
    words = [f"w{k}#" if k % 9 == 0 else f"wé{k}" for k in range(3000)]
    texts = corpus()
    for k in range(80):  # passages that stand twice, of many lengths, on both sides of the limits
        own = r.sample(words, r.randint(60, 140))
        part = own[: r.randint(2, 30)]
        texts.append(r.choice([" ", "\n"]).join([*own, *part] if k % 2 else [*part, *own, r.choice(["&", "\r\n"]), *part]))
        texts.append("\n".join([" ".join(own[j : j + 6]) for j in range(0, 60, 6)] + [" ".join(own[:6])] * r.randint(0, 4)))
    ids = list(range(len(texts)))
    ids[-1], ids[2] = ids[-2], None
    out = quality.rules(table(spark, texts, ids)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted([(i, *measured(t)) for i, t in zip(ids, texts, strict=True)], key=repr)
    assert {(x[6], x[7]) for x in got} == {(True, False), (False, True), (False, False)}


def test_quality_of_nothing(spark):
    assert quality.rules(table(spark, ["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.rules(table(spark, ["a"]), {2: 10})


def test_equal_hashes_are_told_apart():
    ids = np.array([0, 1, 2, 3, 0, 1, 2, 4])
    doc = np.zeros(8, np.int64)
    seen = []

    def same(x, seed):
        seen.append(seed)
        return np.zeros(len(x), np.uint64) if seed < 2 else real(x, seed)

    real, quality.mixed = quality.mixed, same
    try:
        at, later = quality.repeated(ids, doc, np.arange(6), 3)
    finally:
        quality.mixed = real
    assert at.tolist() == [0, 4] and later.tolist() == [False, True] and max(seen) >= 2
