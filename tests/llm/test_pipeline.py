"""The corpus pipeline against a brute-force version, stage by stage and whole."""

import hashlib
from collections import Counter

import corpus_pipeline
from prospector.llm import decontaminate, toxicity
from tests.llm.test_operators import similar_roots, words

SF = "/root/testdata/sf0.001"


def brute_mix(docs):
    """docs: (doc_id, text, source); how often each is taken."""
    size = {d: len(words(t)) for d, t, _ in docs}
    sources = sorted({s for _, _, s in docs})
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[d] for d, _, x in docs if x == s) for s in sources}
    left, target, open_ = sum(total.values()) * 1.5, {}, list(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * total[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2 * total[s]
            left -= 2 * total[s]
            open_.remove(s)
    events = []
    for s in sources:
        own = sorted((hashlib.md5(str(d).encode()).hexdigest(), d) for d, _, x in docs if x == s)
        at = 0
        for n in (0, 1):
            for h, d in own:
                at += size[d]
                if size[d]:
                    events.append((at / target[s], s, n, h, d))
    taken, used = Counter(), 0
    for *_, d in sorted(events):
        used += size[d]
        if used > 1.5 * sum(total.values()):
            break
        taken[d] += 1
    return taken


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    scorer = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in rows if scorer.score(r[1]) < 0.5]
    rows.sort()
    kept = [rows[k] for k in sorted(set(similar_roots([t for _, t, _ in rows])))]
    items = [decontaminate.WORDS.findall(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = []
    for d, t, s in kept:
        w = decontaminate.WORDS.findall(t.lower())
        if not any(decontaminate.myers(p, w)[0] <= int(0.2 * len(p)) for p in items if p):
            clean.append((d, t, s))
    taken = brute_mix(clean)
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == taken and 0 < len(clean) < len(kept) < len(rows)
    text = {d: t for d, t, _ in clean}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 16 for r in got)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and max(shards) < 40


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.selectExpr("*", "1 AS toxicity", "2 AS leaks", "3 AS row", "4 AS n", "5 AS fp", "6 AS size", "7 AS h", "8 AS target")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, odd.limit(0), SF).count() == 0
    twice = docs.union(docs)
    kept = corpus_pipeline.drop_near_duplicates(spark, twice, SF)
    assert kept.count() == kept.select("doc_id").distinct().count()
    assert corpus_pipeline.shard(spark, odd, SF).count() == 40
