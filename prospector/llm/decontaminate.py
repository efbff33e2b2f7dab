"""Benchmark decontamination: pigeonhole pieces and Myers bit-parallel edit distance over words."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.llm.common import fresh, table

#: Words that may be inserted, deleted or replaced, as a share of the item's words.
BUDGET = 0.2
#: Bytes of item text in one block; a larger benchmark is matched block after block.
BLOCK_BYTES = 16 << 20
WORDS = re.compile(r"\w+")

LEAK = "array<struct<item_id:bigint,distance:int,first_word:int,last_word:int>>"
LEAK_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance of pattern to any stretch of text, and the index after the first best stretch's last word.

    One machine word per column: vp and vn hold the vertical steps of +1 and -1 of the whole column.
    """
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        peq[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, m, 0
    for at, w in enumerate(text):
        eq = peq.get(w, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, vp & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1) & full, (hn << 1) & full  # a match may begin anywhere
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """Finds items within their budget in a text; a piece is looked up by its longest word."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        self.anchors: dict[str, list] = defaultdict(list)
        for item_id, text in items:
            words = WORDS.findall(text.lower())
            if not words:
                continue
            budget = int(BUDGET * len(words))
            n, k = len(self.items), len(words)
            self.items.append((item_id, words, budget))
            for p in range(budget + 1):
                lo, hi = k * p // (budget + 1), k * (p + 1) // (budget + 1)
                piece = words[lo:hi]
                at = max(range(len(piece)), key=lambda j: len(piece[j]))
                self.anchors[piece[at]].append((n, lo, at, piece))

    def find(self, text: str | None) -> list[dict]:
        words = WORDS.findall((text or "").lower())
        starts: dict[int, set[int]] = defaultdict(set)
        for k, hits in enumerate(map(self.anchors.get, words)):
            if hits:
                for n, lo, at, piece in hits:
                    if words[k - at : k - at + len(piece)] == piece and k >= at:
                        starts[n].add(k - at - lo)
        found = []
        for n, begins in starts.items():
            item_id, pattern, budget = self.items[n]
            best = None
            group: list[int] = []
            for s in [*sorted(begins), None]:
                if group and (s is None or s > group[-1] + budget):
                    lo = max(0, group[0] - budget)
                    part = words[lo : group[-1] + len(pattern) + budget]
                    distance, end = myers(pattern, part)
                    if distance <= budget and (best is None or distance < best["distance"]):
                        # the match's first word: the same search from its end backwards
                        _, back = myers(pattern[::-1], part[:end][::-1])
                        best = {"item_id": item_id, "distance": distance, "first_word": lo + end - back, "last_word": lo + end - 1}
                    group = []
                if s is not None:
                    group.append(s)
            if best:
                found.append(best)
        return sorted(found, key=lambda x: x["item_id"])


def leaks(docs: DataFrame, benchmark: DataFrame, into: str = "leaks", text_col: str = "text") -> DataFrame:
    """All columns of docs and an array of the items found in the text: (item_id, distance, first_word, last_word), the best match of each.

    Words are runs of letters and digits in lower case, so case and punctuation don't count. An item of n words is found where
    at most int(BUDGET * n) words differ. Split into one piece more than that, at least one piece stands unchanged in a match.
    Null and empty texts hold nothing, long ones are searched whole; items without words match nothing. Repeated items are reported each.
    No rows: none. A column named as `into`, in any case, is refused.
    """
    if fresh(docs, into) != into:
        raise ValueError(f"docs has a column {into}")
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = docs.withColumn(into, F.array().cast(LEAK))
    at = docs.columns.index(text_col)
    for block in range(blocks):
        here = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]

        def run(batches, here=sorted(here)):
            matcher = Matcher(here)
            for b in batches:
                k = b.num_columns - 1
                old = b.column(k).to_pylist()
                new = [(o or []) + matcher.find(t.as_py()) for o, t in zip(old, b.column(at), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(new, LEAK_ARROW)], names=b.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.distance", "leak.first_word", "leak.last_word")
