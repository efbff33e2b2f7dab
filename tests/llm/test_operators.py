"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prospector.llm import chat, common, decontaminate, embeddings, lines, lm, mixing, sharding, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, shard string"


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages, odd white space, an empty, a null and a long text."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(400)]
    passage = r.choices(vocabulary, k=40)
    texts = []
    for k in range(n):
        words = r.choices(vocabulary, k=r.randint(1, 150))
        if k % 5 == 0:
            at = r.randrange(len(words))
            words[at:at] = passage[r.randrange(10) :]
        if k % 7 == 0 and texts and texts[-1]:
            words = texts[-1].split()
            if len(words) > 60:
                words[r.randrange(len(words))] = "Zz"
        texts.append("".join(w + r.choice([" ", " ", " ", "\n", "\t ", "\r\n", "\x0b"]) for w in words))
    texts += ["", None, "one", "word joined", "same " * 30, " \n ", "x" * 5000, " ".join(r.choices(vocabulary, k=30_000)), texts[3], texts[3]]
    return texts


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", [None, "b", "a", "c"][k % 4], 1, 7, "r", "s") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def words(t):
    return (t or "").encode().split()


def test_substring(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    ids[-1] = ids[-2]  # a repeated row
    ids[5] = None
    got = sorted(map(tuple, substring.dedup(table(spark, texts, ids)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    low = {}
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                low[tuple(w[k : k + 13])] = min(low.get(tuple(w[k : k + 13]), 1 << 60), i)
    want = []
    for i, t in zip(ids, texts, strict=True):
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and low[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(x[2] for x in want) > 500


def test_substring_tells_texts_of_one_id_apart(spark):
    a = " ".join(f"w{k}" for k in range(20))
    got = substring.dedup(table(spark, [a, "x " + a, "y y " + a], [1, 2, 2])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 20, 0), (2, 21, 20), (2, 22, 20)]


def test_hash_neighbours_are_compared_by_bytes():
    one = b"a b c d e f g h i j k l m\nz b c d e f g h i j k l m\n"
    _, _, low = substring.repeated(one, np.array([1, 1]), np.array([4, 9]))
    assert low.tolist() == [4, 9]
    original = substring.word_hashes
    substring.word_hashes = lambda arr, starts, ends: np.zeros(len(starts), np.uint64)  # all windows collide
    try:
        _, _, low = substring.repeated(one + one, np.array([1, 1, 1, 1]), np.array([4, 9, 7, 2]))
    finally:
        substring.word_hashes = original
    assert low.tolist() == [4, 2, 4, 2]


def test_sharding(spark):
    texts = corpus(2, 300)
    rows = sharding.shard(table(spark, texts), shards=7).collect()
    assert len(rows) == len(texts)
    size = {i: len((t or "").encode()) + 16 for i, t in enumerate(texts)}
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in per.values())
    small = [x for s, x in per.items() if max(b for _, b in x) < 10_000]
    assert all(abs(sum(b for _, b in x) - sum(size.values()) / 7) < sum(size.values()) / 7 for x in small)


def test_sharding_layout(spark):
    texts = [f"text {k // 3} " + "y" * (k % 90) for k in range(2000)] + ["z" * 60_000, None, ""]
    ids = [*range(len(texts) - 2), 7, None]
    docs = table(spark, texts, ids)
    rows = sharding.shard(docs, shards=8).collect()
    hashed = {r["doc_id"]: [] for r in rows}
    for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").collect():
        hashed[r["doc_id"]].append((r["h"], zlib.crc32((r["text"] or "").encode()), r["doc_id"] is not None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 16))
    layout = sorted(x for own in hashed.values() for x in own)
    total, start, want, slots = sum(x[-1] for x in layout), 0, [], Counter()
    for *_, has_id, doc_id, size in layout:
        k = sum(start >= total * j // 8 for j in range(1, 8))
        want.append((doc_id if has_id else None, size, k, slots[k]))
        slots[k] += 1
        start += size
    assert sorted(((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in rows), key=repr) == sorted(want, key=repr)


def vectors(seed=3, n=300):
    r = np.random.default_rng(seed)
    base = r.standard_normal((20, 16))
    v = base[r.integers(0, 20, n)] + r.standard_normal((n, 16)) * r.choice([0.0, 0.1, 0.3], n)[:, None]
    rows = [(k, [float(np.float32(x)) for x in v[k]], int(k % 3)) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, rows[0][1][:8], 0), (n + 7, [float("inf")] * 16, 1)]
    return rows + [(n + 8, *rows[0][1:]), (n + 8, *rows[0][1:])]


@pytest.mark.parametrize("tile", [4096, 7])
def test_embeddings(spark, tile):
    rows = vectors()
    old, embeddings.TILE = embeddings.TILE, tile
    try:
        got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    finally:
        embeddings.TILE = old
    good = lambda e, y: y is not None and e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e) and any(e)
    ok = [k for k, (_, e, y) in enumerate(rows) if good(e, y)]
    linked = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    linked[a].append(b)
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in linked[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        low = min(rows[b][0] for b in seen)
        want.append((i, len(linked[k]), low, i == low))
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(w[1] for w in want) > 1000


def test_embeddings_with_a_shared_direction(spark):
    """Vectors of one label at a mean cosine of about 0.5: all planted pairs at 0.935 are found."""
    r = np.random.default_rng(11)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    a = unit(np.eye(64)[:1] + unit(r.standard_normal((6000, 64))))
    side = r.standard_normal((1500, 64))
    side = unit(side - (side * a[:1500]).sum(axis=1, keepdims=True) * a[:1500])
    v = np.concatenate((a, 0.935 * a[:1500] + math.sqrt(1 - 0.935**2) * side))
    rows = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(rows).collect()}
    assert sum(got[k] != got[6000 + k] for k in range(1500)) == 0


def test_embeddings_do_not_depend_on_ranges(spark, monkeypatch):
    """Neighbours in the order are compared whether or not a range of it ends between them."""
    monkeypatch.setattr(embeddings, "WINDOW", 3)
    monkeypatch.setattr(embeddings, "plan", lambda rows, spread, bits, cosine: (2, False))
    r = np.random.default_rng(8)
    angle = np.sort(r.uniform(0, 2 * np.pi, 400))
    rows = [(k, [float(np.cos(x)), float(np.sin(x)), 0.01], k % 2) for k, x in enumerate(angle)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = []
    for parts in ("1", "3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({row["vec_id"]: row["component_id"] for row in embeddings.near_duplicates(docs).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) < 30


def edit(pattern, text):
    """Least edit distance of pattern to any stretch of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(5)
    for _ in range(300):
        p, t = r.choices("abc", k=r.randint(1, 70)), r.choices("abc", k=r.randint(0, 90))
        distance, end = decontaminate.myers(p, t)
        assert distance == edit(p, t) == edit(p, t[:end])


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_decontamination(spark, block):
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 40)))) for k in range(12)] + [(12, None), (13, ""), (14, "..."), (None, "x y z")]
    texts = []
    for k in range(80):
        w = r.choices(vocabulary, k=r.randint(5, 80))
        item = r.choice(items[:12])[1].split()
        for _ in range(r.choice([0, 0, 1, 3, 8])):
            item[r.randrange(len(item))] = r.choice(vocabulary)
        at = r.randrange(len(w))
        texts.append(" ".join(w[:at]) + " \n" + ", ".join(item).upper() + ". " + " ".join(w[at:]))
    texts += ["", None]
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, block
    try:
        docs = table(spark, texts).withColumnRenamed("row", "leaks")
        found = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), "found").collect()
    finally:
        decontaminate.BLOCK_BYTES = old
    got = {(r["doc_id"], x["item_id"]): x["distance"] for r in found for x in r["found"]}
    want = {}
    for k, t in enumerate(texts):
        w = decontaminate.WORDS.findall((t or "").lower())
        for i, item in items[:12]:
            p = item.lower().split()
            d = edit(p, w)
            if d <= int(0.2 * len(p)):
                want[k, i] = d
    assert got == want and len(want) > 40
    for row in found:
        w = decontaminate.WORDS.findall((row["text"] or "").lower())
        for x in row["found"]:
            p = items[x["item_id"]][1].lower().split()
            assert edit(p, w[x["first_word"] : x["last_word"] + 1]) == x["distance"]


def test_mixing(spark):
    texts = corpus(7, 400)
    rows = mixing.mix(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    total = sum(r["size"] for r in rows)
    assert all(r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    target = {r["source"]: r["target"] for r in rows}
    assert sum(target.values()) == pytest.approx(1.5 * total)
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["target"] <= 2 * r["source_size"] + 1e-6
    assert all(abs(taken[s] - t) <= 30_000 for s, t in target.items()) and sum(taken.values()) <= 1.5 * total
    again = mixing.mix(table(spark, texts)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixing_shares_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # by hand: a stops at 20; 3745 are left for weights 2, 1, 5; the last stops at 1000; b at 2000 leaves 1745 - ... for c
    assert got["a"] == 20 and got[None] == 1000 and got["b"] == pytest.approx(2745 * 2 / 3) and got["c"] == pytest.approx(2745 / 3)


def test_chat_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 2, 1, "delta", None, "ll"), (1, 3, 1, "delta", None, "o"),
        (1, 4, 2, "message", "user", "more"), (1, 5, 3, "message", "assistant", "old"), (1, 6, 3, "regenerate", None, None), (1, 7, 3, "delta", None, "new"),
        (2, 0, 0, "message", "user", "a"), (2, 1, 1, "message", "assistant", "b"), (2, 2, 0, "edit", "user", "A"), (2, 3, 1, None, "assistant", "B"), (2, 4, 2, "delta", None, "tail"),
        (3, 0, 0, "message", "user", "x"), (3, 1, 1, "message", "assistant", "y"), (3, 2, 0, "edit", None, "z"),
    ]
    out = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string"))
    got = sorted(map(tuple, out.collect()))
    assert got == [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "new"), (2, 0, "user", "A"), (2, 1, "assistant", "B"), (2, 2, "", "tail"), (3, 0, "user", "z")]


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>", "<\\|", "\\", "<", "|", "<|", "\\\\<|im_start|>", "", "a\nb", "é\U0001f600", "<\\", "\n", "<|im_end|>\n<|im_start|>assistant\nx"]
    rows = [(c, k, role, t) for c, role in enumerate(["assistant", "us\ner", "<|im_end|>", ""]) for k, t in enumerate(nasty)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(messages).withColumn("turns", chat.read_back(chat.F.col("formatted"))).collect()
    for r in out:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, t) for c, _, role, t in rows if c == r["conv_id"]]
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert [s.replace("<\\|", "<|").replace("\\\\", "\\") for s in spans] == (nasty if r["conv_id"] == 0 else [])


def test_chat_log_and_mask(spark):
    rows = [(1, 1, "user", "aé\U0001f600b"), (1, 2, "assistant", "<|im_end|>x\\"), (1, 3, "assistant", ""), (1, 4, "", "odd"), (None, 1, "assistant", "q")]
    messages = spark.createDataFrame(rows, "conv_id long, at long, role string, text string")
    log = chat.logged(messages)
    assert {r["kind"] for r in log.collect()} == {"message", "edit", "delta", "regenerate"}
    folded = chat.fold(log)
    assert sorted(map(tuple, folded.collect()), key=repr) == sorted(rows, key=repr)
    out = chat.render(folded)
    loss = {r["conv_id"]: r["loss"] for r in out.select("conv_id", chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert loss == {1: "<|im_end|>x\\", None: "q"}
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length")))
    assert {r["loss"] for r in out.select(chat.masked(F.col("formatted"), moved).alias("loss")).collect()} != set(loss.values())


def test_bytes_that_are_no_text(spark):
    docs = spark.createDataFrame([(k, bytearray(b" ".join(b"w%d\xff" % j for j in range(20)))) for k in (1, 2)], "doc_id long, text binary")
    docs = docs.select("doc_id", F.expr("cast(text as string)").alias("text"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.dedup(docs).collect()}
    assert got == {1: (20, 0), 2: (20, 20)} and simhash.near_duplicates(docs).count() == simhash.keep_one(docs).count() + 1


def simhash_of(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        ones = [o + (h >> k & 1) for k, o in enumerate(ones)]
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def test_simhash(spark):
    texts = corpus(8, 150)
    ids = list(range(len(texts)))
    ids[4] = None
    rows = simhash.near_duplicates(table(spark, texts, ids).select("doc_id", "text", "lang")).collect()
    fps = [simhash_of(t) for t in texts]
    want = []
    for k, f in enumerate(fps):
        seen, todo = {k}, [f]
        while todo:
            g = todo.pop()
            for j, x in enumerate(fps):
                if j not in seen and (g ^ x).bit_count() <= 4:
                    seen.add(j)
                    todo.append(x)
        want.append((ids[k], f, min((ids[j] for j in seen if ids[j] is not None), default=None)))
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows), key=repr) == sorted(want, key=repr)


def shingle_words(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar_roots(texts):
    """Smallest place that each text reaches over Jaccard similarities of 0.8 or more, by comparing all."""
    sets, root = [shingle_words(t) for t in texts], list(range(len(texts)))
    for k, s in enumerate(sets):
        for j in range(k):
            shared = len(s & sets[j])
            if (not s and not sets[j]) or (s and sets[j] and 5 * shared >= 4 * (len(s) + len(sets[j]) - shared)):
                a, b = sorted((root[k], root[j]))
                root = [a if x == b else x for x in root]
    return root


def near_copies(seed=12):
    """Texts that differ from one of a few by up to two words in ten; no pair within 0.01 of the similarity that counts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(3_000)]
    texts = []
    for _ in range(60):
        base = r.choices(vocabulary, k=r.randint(60, 300))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            w = list(base)
            for j in r.sample(range(len(w)), int(len(w) * r.choice([0, 0.01, 0.04]))):
                w[j] = r.choice(vocabulary)
            texts.append(r.choice(["  ", "\n"]).join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("shard", [500, 20])
def test_keep_one(spark, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    texts = near_copies() + corpus(8, 40)
    ids = list(range(len(texts)))
    kept = sorted(r["doc_id"] for r in simhash.keep_one(table(spark, texts, ids)).collect())
    want = sorted({r for r in similar_roots(texts)})
    assert kept == want and 60 < len(want) < len(texts) - 40


def test_keep_one_keeps_columns_and_nulls(spark):
    docs = table(spark, ["a b c d e f", None, "a b c d e f", "", "a  b c d e F"], [None, 5, 7, 3, 9]).withColumn("m", F.create_map(F.lit("k"), "doc_id"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["m"]["k"]) for r in kept.collect()) == [(3, 3), (7, 7)]


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_components(spark, most, monkeypatch):
    monkeypatch.setattr(common, "LOCAL_EDGES", most)
    r = np.random.default_rng(6)
    a, b = r.integers(0, 400, 330), r.integers(0, 400, 330)
    a[:60], b[:60] = np.arange(60), np.arange(1, 61)  # a long chain
    want = common.local_roots(400, a, b)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a long, b long")).collect()}
    linked = set(a[a != b].tolist()) | set(b[a != b].tolist())
    assert got == {k: int(want[k]) for k in linked}


def test_spanning_forest_joins_by_the_shortest_edges():
    r = np.random.default_rng(5)
    a, b, d = r.integers(0, 60, 400), r.integers(0, 60, 400), r.integers(0, 9, 400)
    keep = simhash.spanning(60, a, b, d)
    for most in range(9):
        want = simhash.local_roots(60, a[d <= most], b[d <= most])
        assert (simhash.local_roots(60, a[keep][d[keep] <= most], b[keep][d[keep] <= most]) == want).all()
    assert len(keep) <= 59


@pytest.mark.parametrize("leaf, shard", [(20_000, 500), (50, 500), (20_000, 30)])
def test_simhash_links(spark, leaf, shard, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    r = np.random.default_rng(9)
    centre = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = centre[r.integers(0, 40, 1500)]
    for _ in range(5):
        fps = fps ^ (np.uint64(1) << r.integers(0, 64, 1500, dtype=np.uint64))
    fps = np.unique(np.concatenate((fps, r.integers(0, 2**63, 3000, dtype=np.uint64))))
    root = np.arange(len(fps))
    a, b = np.nonzero(simhash.distances(fps[:, None], fps[:, None]) <= 4)
    want = simhash.local_roots(len(fps), a, b)
    points = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "id long").select("id", simhash.as_bits("id").alias("bits"))
    edges = simhash.links(points, simhash.BLOCKS, simhash.NEAR, simhash.RADIUS, 1, 1).collect()
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    x, y = np.array([at[e["a"]] for e in edges]), np.array([at[e["b"]] for e in edges])
    assert (simhash.local_roots(len(fps), x, y) == want).all() and len(set(want)) < len(root)
    assert all(e["d"] == ((e["a"] ^ e["b"]) % 2**64).bit_count() for e in edges)
    found = {(min(i, j), max(i, j)) for x, y, _ in simhash.vantage_pairs(fps[:, None], small=64) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j}


def test_lines(spark):
    r = random.Random(10)
    vocabulary = ["".join(r.choices("abcde", k=r.randint(1, 6))) for _ in range(150)]
    pool = [r.choices(vocabulary, k=r.randint(1, 25)) for _ in range(60)]
    texts = []
    for _ in range(100):
        doc = []
        for _ in range(r.randint(0, 8)):
            w = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            doc.append(r.choice([" ", "\t", "  "]).join(w))
        texts.append("\n".join(doc))
    texts += [None, "", "\n\n", texts[0]]
    ids = [*range(len(texts) - 1), None]
    got = {r["doc_id"]: (r["n_lines"], list(r["removed"])) for r in lines.dedup(table(spark, texts, ids)).collect()}
    earlier, want = [], {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0])):
        removed = []
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(line.split())
            if s and i is not None:
                if any(len(s & x) / len(s | x) >= 0.8 for x in earlier):
                    removed.append(k)
                earlier.append(s)
        want[i] = (len((t or "").split("\n")), removed)
    assert got == want and sum(len(x[1]) for x in want.values()) > 50


def test_long_lines_and_many_near_copies(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(5_000)]
    pool = [r.sample(vocabulary, k) for k in (40, 66, 95, 100, 130, 190, 200, 260, 300, 1500)]
    texts = []
    for k in range(150):
        w = list(pool[0] if k % 2 else r.choice(pool))
        for j in r.sample(range(len(w)), int(len(w) * r.choice([0, 0.02, 0.05, 0.08, 0.11, 0.15]))):
            w[j] = r.choice(vocabulary)
        r.shuffle(w)
        texts.append(" ".join(w))
    got = {r["doc_id"]: list(r["removed"]) for r in lines.dedup(table(spark, texts)).collect()}
    sets = [frozenset(t.split()) for t in texts]
    want = {k: [0] if any(9 * len(s & x) >= 4 * (len(s) + len(x)) for x in sets[:k]) else [] for k, s in enumerate(sets)}
    assert got == want and 40 < sum(map(len, want.values())) < 140


def test_near_copies_are_looked_at_one_by_one(spark, monkeypatch):
    """A group in which all pairs are candidates takes a few pairs a line, and a line whose nearest candidates aren't similar meets all others."""
    texts = [" ".join([f"w{k}" for k in range(30)] + [f"own{i}"]) for i in range(60)] + [" ".join(f"v{k}" for k in range(30))]
    n = len(texts)
    # the last candidate of line 61, a copy of line 60 in other order, is the farthest
    texts.append(" ".join(reversed(texts[-1].split())))
    docs = table(spark, texts)
    first = docs.select(F.col("doc_id").alias("num"), *lines.identity(F.col("text")), "doc_id", F.lit(0).alias("line_no"))
    pairs = spark.createDataFrame([(i, j, j) for i in range(n + 1) for j in range(i)], "num long, other long, d int")
    seen, similar = [], lines.similar

    def counted(pairs, texts):
        seen.append(pairs.count())
        return similar(pairs, texts)

    monkeypatch.setattr(lines, "similar", counted)
    of = lambda ids: lines.lines_of(docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text")
    got = sorted(r["num"] for r in lines.verified(pairs, first, of, lines.NEAREST).collect())
    assert got == [*range(1, 60), 61]
    assert sum(seen) <= n + 2 * n + 10 and len(seen) == lines.NEAREST + 1


def test_toxicity(spark):
    r = random.Random(11)
    clean = ["".join(r.choices("lmnoprst", k=r.randint(2, 6))) for _ in range(300)]
    texts, labels = [], []
    for k in range(600):
        w = r.choices(clean, k=r.randint(5, 60))
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(["zzblah", "zzblahen", "quork", "vexal"]))
        texts.append(" ".join(w))
        labels.append((k, 1, int(toxic)))
    docs = table(spark, [*texts, None, ""])
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = {x["doc_id"]: x["tox"] for x in toxicity.score(docs, scorer, "tox").collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((rows[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert rows[600] == rows[601] < 0.5
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {x["tox"] for x in toxicity.score(docs, none, "tox").collect()} == {0.0}


def test_toxicity_scores_clauses():
    s = toxicity.Scorer({"fool": 4.0})
    plain, aimed, denied, said, apart = (s.features(t)[0] for t in ("a fool went", "you fool went", "not a fool", "they said a fool", "you went. fool"))
    assert aimed > plain == apart > said > denied > 0


def test_lm(spark):
    texts = corpus(12, 80)
    ids = list(range(len(texts)))
    ids[6] = None
    got = lm.score(table(spark, texts, ids)).collect()
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i in ids]
    split = [[w.lower() for w in words(t)] for t in texts]
    c, ends = Counter(), sum(train)
    for w, t in zip(split, train, strict=True):
        c.update(w if t else [])
    n, v = sum(c.values()) + ends, len(c) + 1
    want = sorted((repr(i), len(w) + 1, 1 + sum(x in c for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1))), 3)) for i, w in zip(ids, split, strict=True))
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)


def test_lm_learns_from_all_documents(spark, monkeypatch):
    """What only the last documents in hash order hold is learned too, and how rows are dealt to tasks changes nothing."""
    monkeypatch.setattr(lm, "BUCKET", 1 << 16)
    rows = spark.range(1600).selectExpr("id AS doc_id", "row_number() OVER (ORDER BY xxhash64(id)) AS k")
    docs = rows.selectExpr("doc_id", "repeat(if(k <= 1450, 'one two three ', 'zig zag '), 12) AS text")
    late = {r["doc_id"] for r in rows.where("k > 1450").collect()}
    got = {r["doc_id"]: r for r in lm.score(docs.repartition(3)).collect()}
    own = [got[i] for i in late if got[i]["held_out"]]
    assert own and all(r["score"] > r["base_score"] / 2 for r in own)
    again = lm.score(docs.orderBy("doc_id").coalesce(1)).collect()
    assert all(r["score"] == pytest.approx(got[r["doc_id"]]["score"], rel=1e-3) for r in again)


def test_lm_sees_all_documents_in_each_round(spark, monkeypatch):
    """However many tokens they have: the weights after a round tell how many documents were in it."""
    import pyarrow as pa

    rounds = []

    def count_round(w, end, number):
        rounds.append(float(next(iter(w.values())).flat[0]))
        shapes = [v.shape for v in w.values()]

        def run(batches):
            n = sum(b.num_rows for b in batches)
            if n:
                blobs = [np.full(x, n, np.float32).tobytes() for x in shapes]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(shapes))), pa.array([n] * len(shapes)), pa.array(blobs, pa.binary())], names=["piece", "tokens", "total"])

        return run

    monkeypatch.setattr(lm, "train_round", count_round)
    vocabulary = lm.vocabulary_at()
    end = lm.Subwords(*vocabulary).end
    tree = lm.Tree(np.full(end + 1, 1e9))
    docs = spark.range(50).selectExpr("id AS doc_id", "CAST('one two' AS binary) AS text")
    last = lm.train_all(docs, vocabulary, tree, int(tree.leaf[end]), 1)
    assert rounds[1:] == [50.0] * (lm.EPOCHS - 1) and next(iter(last.values())).flat[0] == 50


def test_lm_workers_have_tasks_of_their_own(spark, monkeypatch):
    """The weights after a round tell how many workers a task had on average."""
    import pyarrow as pa

    def count_workers(w, end, number):
        shapes = [v.shape for v in w.values()]

        def run(batches):
            seen = {k for b in batches for k in b.column(0).to_pylist()}
            if seen:
                blobs = [np.full(x, len(seen), np.float32).tobytes() for x in shapes]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(shapes))), pa.array([1] * len(shapes)), pa.array(blobs, pa.binary())], names=["piece", "tokens", "total"])

        return run

    monkeypatch.setattr(lm, "train_round", count_workers)
    vocabulary = lm.vocabulary_at()
    end = lm.Subwords(*vocabulary).end
    tree = lm.Tree(np.full(end + 1, 1e9))
    docs = spark.range(400).selectExpr("id AS doc_id", "CAST('one two' AS binary) AS text")
    assert next(iter(lm.train_all(docs, vocabulary, tree, int(tree.leaf[end]), 12).values())).flat[0] == 1


def test_lm_steps_in_stretches():
    """Steps over all weights in stretches are those over each array of weights."""
    rng = np.random.default_rng(3)
    w = {k: v.copy() for k, v in lm.fresh_weights().items()}
    trainer, one = lm.Trainer(w, 0), np.float32(1)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for _ in range(3):
        g = {k: rng.standard_normal(v.shape).astype(np.float32) for k, v in w.items()}
        trainer.go(np.concatenate([x.ravel() for x in g.values()]), one)
        for k, x in g.items():
            mean[k] = mean[k] * np.float32(0.9) + np.float32(0.1) * x
            square[k] = square[k] * np.float32(0.99) + np.float32(0.01) * (x * x)
            w[k] -= mean[k] / (np.sqrt(square[k]) + np.float32(1e-8))
    assert all(np.allclose(trainer.w[k], v, rtol=1e-5, atol=1e-5) for k, v in w.items())


def test_lm_is_a_distribution():
    """Over all ids, next-token probabilities sum to 1, and scoring in one batch or alone agrees."""
    rng = np.random.default_rng(0)
    tree = lm.Tree(rng.integers(0, 50, 3000).astype(float))
    end = 2999
    w = lm.train_model([tree.leaf[rng.integers(0, 3000, 200)] for _ in range(4)], int(tree.leaf[end]))
    scorer = lm.Scorer(w, tree, end)
    texts = [rng.integers(0, 3000, k) for k in (0, 1, 15, 16, 17, 50, 700)]
    whole = scorer.score(texts)
    assert np.allclose(whole, [scorer.score([t])[0] for t in texts], atol=1e-3)
    start = rng.integers(0, 3000, 20)
    leaves = tree.leaf[np.concatenate(([end], start))]
    now, at = lm.blocks_of([leaves])
    h = scorer.states(now).reshape(-1, lm.WIDTH)[[len(leaves) - 1]]
    every = scorer.leaves(np.repeat(h, 3000, axis=0), tree.leaf[np.arange(3000)]) + tree.inside
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_lm_score_is_the_attention_formula():
    """Every token one by one: softmax over the tokens of its window before it, the states' sum, and the two levels of the tree."""
    rng = np.random.default_rng(1)
    tree, end = lm.Tree(rng.integers(0, 50, 2500).astype(float)), 2499
    w = lm.train_model([tree.leaf[rng.integers(0, 2500, 150)] for _ in range(3)], int(tree.leaf[end]))
    scorer = lm.Scorer(w, tree, end)

    def log_softmax(x):
        return x - np.log(np.exp(x - x.max()).sum()) - x.max()

    for length in (0, 1, 16, 33, 90):
        text = rng.integers(0, 2500, length)
        seen, total = np.concatenate(([end], text)), 0.0
        for k, target in enumerate([*text.tolist(), end]):
            now = tree.leaf[seen[k]]
            window = range(max(0, (k // lm.BLOCK - 1) * lm.BLOCK), k + 1)
            logits = np.array([w["query"][now].astype(float) @ w["key"][tree.leaf[seen[j]]] / math.sqrt(lm.WIDTH) + w["distance"][k - j] for j in window])
            share = np.exp(log_softmax(logits))
            h = w["token"][now] + sum(s * w["value"][tree.leaf[seen[j]]].astype(float) for s, j in zip(share, window, strict=True))
            group, place = divmod(int(tree.leaf[target]), lm.GROUPS)
            total += log_softmax(h @ w["up"] + w["up0"])[group] + log_softmax(h @ w["low"][group] + w["low0"][group])[place] + tree.inside[target]
        assert scorer.score([text])[0] == pytest.approx(total / math.log(10), rel=1e-4)


def test_lm_gradients():
    """The gradients are those of the mean loss, by finite differences."""
    rng = np.random.default_rng(2)
    w = {k: v * 3 for k, v in lm.fresh_weights().items()}
    now, _ = lm.blocks_of([rng.integers(0, 40, 40)])
    before = np.concatenate((now[:1], now[:-1]))
    target = np.where(now == lm.PAD, lm.PAD, (now * 7 + 3) % 1000)

    def loss(weights):
        h, _ = lm.attend(weights, now, before)
        real = target != lm.PAD
        return -lm.leaf_scores(weights, h[real], target[real])[0].mean()

    grads = lm.gradients(w, now, before, target)
    for name in w:
        for _ in range(4):
            at = tuple(int(rng.integers(0, min(d, 32))) for d in w[name].shape)
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 0.02
            down[name][at] -= 0.02
            assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 0.04, abs=2e-3)


def test_clashing_columns(spark):
    docs = table(spark, ["a b", None, "c"]).withColumn("leaks", F.lit(1)).withColumn("toxicity", F.lit(2))
    with pytest.raises(ValueError):
        decontaminate.leaks(docs, spark.createDataFrame([], "item_id long, text string"))
    with pytest.raises(ValueError):
        toxicity.score(docs, toxicity.Scorer({}))
    for c, f in (("LEAKS", lambda d: decontaminate.leaks(d, spark.createDataFrame([], "item_id long, text string"))), ("Toxicity", lambda d: toxicity.score(d, toxicity.Scorer({})))):
        with pytest.raises(ValueError):
            f(docs.drop("leaks", "toxicity").withColumn(c, F.lit(1)))
    named = docs.withColumns({c: F.lit(7) for c in ("fp", "Root", "component_id", "_fp", "low")})
    got = simhash.near_duplicates(named)
    assert got.columns == [*[c for c in named.columns if c != "text"], "fp_", "root_", "component_id_"] and sorted(r["component_id_"] for r in got.collect()) == [0, 1, 2] and got.where("fp = 7 AND Root = 7").count() == 3
    odd = spark.createDataFrame([(k, [1.0, 0.1 * k], 1, "x", 5) for k in range(4)], "vec_id long, embedding array<double>, label int, rep string, n long")
    assert embeddings.near_duplicates(odd).select("vec_id", "n_links").count() == 4
    odd = docs.withColumns({c: F.lit(0) for c in ("fp", "root", "bits", "id", "a", "b", "line", "num", "word", "n", "uid", "h")})
    assert simhash.keep_one(odd).columns == odd.columns and lines.dedup(odd).count() == substring.dedup(odd).count() == lm.score(odd.drop("a", "b")).count() == 3


def test_learning_from_odd_labels(spark):
    """An id labelled twice is toxic if any label is, and repeated documents count each; nulls don't, and one class alone teaches nothing."""
    docs = table(spark, [f"{'grob blarg' if k % 2 else 'nice day'} {k} word{k} more" for k in range(80)] + ["x", None], [*range(80), None, 81])
    both = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs.union(docs), both)
    assert scorer.score("grob blarg") > 0.5 > scorer.score("nice day") and scorer.beta is not None
    assert toxicity.fit(docs, both.where("toxic = 1")).score("grob blarg") == 0.0


def test_empty_tables(spark):
    none = table(spark, [])
    assert substring.dedup(none).count() == sharding.shard(none).count() == mixing.mix(none).count() == 0
    assert lines.dedup(none).count() == simhash.near_duplicates(none).count() == simhash.keep_one(none).count() == 0
    assert decontaminate.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert lm.score(none).count() == 0
    assert chat.render(chat.fold(spark.createDataFrame([], "conv_id long, seq long, turn long, kind string, role string, text string"))).count() == 0


@pytest.mark.parametrize("topics, inner", [(1, 0.8), (2, 0.8), (2, 0.88), (5, 0.85), (20, 0.9)])
def test_passes_find_pairs_in_tight_topics(topics, inner):
    """Recall of the passes alone, without all pairs, of 500 pairs just over the threshold among 20,000 vectors of a label."""
    r = np.random.default_rng(topics)
    n, d, planted = 20_000, 64, 500

    def near(v, c):
        noise = r.standard_normal(v.shape)
        noise -= (noise * v).sum(1, keepdims=True) * v
        return c * v + math.sqrt(1 - c * c) * noise / np.linalg.norm(noise, axis=1, keepdims=True)

    middle = r.standard_normal((topics, d))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    if topics == 2:
        middle[1] = -middle[0]
    v = near(middle[np.arange(n) % topics], math.sqrt(inner))
    v[n - planted :] = near(v[:planted], 0.935)
    centre = v.mean(0)
    u = v - centre
    runs = {b: np.mean([(c.astype(float) ** 2).sum() / n for p in range(embeddings.PROBES) for _, c in [embeddings.prefix_runs(embeddings.codes(u, p), b)]]) for b in embeddings.LEVELS}
    bits = min([b for b, x in runs.items() if x <= embeddings.WINDOW / 2], default=embeddings.BITS)
    number = embeddings.passes(bits, 1 - (1 - embeddings.COSINE) / (1 - centre @ centre))
    if embeddings.plan(n, 1 - float(centre @ centre), bits, embeddings.COSINE)[1]:
        assert 2 * embeddings.WINDOW * number >= n  # compared exactly: passes would be more work
        return
    found = np.zeros(planted, bool)
    for p in range(number):
        place = np.empty(n, np.int64)
        place[np.argsort(embeddings.codes(u, p), kind="stable")] = np.arange(n)
        found |= np.abs(place[:planted] - place[n - planted :]) <= embeddings.WINDOW
    assert found.mean() >= 0.99
