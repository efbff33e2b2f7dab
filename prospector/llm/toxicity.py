"""Toxicity by a weighted finite-state grammar over clauses, with word classes learned from labelled rows."""

from __future__ import annotations

import pickle
import re
from array import array
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from prospector.llm.common import crc_mod, fresh, table, with_field

#: Labelled rows of either class that the fit reads at most, the first by a hash of their id.
SAMPLE_TOXIC, SAMPLE_CLEAN = 2_000, 4_000
#: Word beginnings that may stand for a family of words, in characters, and contexts that a family or word must be seen in.
PREFIXES, LEAST_CONTEXTS = (4, 5, 6, 7), 4
#: Evidence that a word or family needs: the log odds of its contexts, kept low by PRIOR clean ones.
PRIOR, LEAST_WEIGHT = 1.0, 2.5
#: Toxic contexts for each clean one that it needs, and hash classes in which candidates are counted first.
PURITY, HASH_CLASSES = 20, 1 << 22
CACHE = 500_000

TOKEN = re.compile(r"[^\W_]+|[.!?;\n\"“”«»]")
NEUTRAL, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, GAP = range(9)
#: Fixed closed-class words of the grammar, English, German, French and Spanish.
CLOSED = {
    TARGET: "you your yours du dich dein deine euch toi ton vous votre tú usted vosotros",
    NEGATION: "not never isn't nicht kein keine niemals jamais nunca jamás",
    REPORT: "said says saying wrote told called quoted sagte schrieb nannte écrit appelé dijo escribió llamó",
    THREAT: "kill hurt destroy punish töten verletzen tuer frapper matar golpear",
    QUOTE: '" “ ” « »',
    END: ". ! ? ; \n",
}
THREAT_WEIGHT = 0.5


class Transducer:
    """Deterministic: moves[state, symbol] = (state, scale); an absent move stays put at scale 1. END leads back to the start."""

    def __init__(self, states: int, moves: dict):
        self.states, self.moves = states, moves

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.moves.get((state, symbol), (0 if symbol == END else state, 1.0))


def compose(parts: list[Transducer]) -> list[list[tuple[int, float]]]:
    """All run on the same symbols; the scales of what they emit are multiplied. Row: state of the product; column: symbol."""
    names = list(product(*[range(p.states) for p in parts]))
    number = {s: k for k, s in enumerate(names)}
    rows = []
    for s in names:
        row = []
        for symbol in range(9):
            steps = [p.step(x, symbol) for p, x in zip(parts, s, strict=True)]
            row.append((number[tuple(x for x, _ in steps)], float(np.prod([w for _, w in steps]))))
        rows.append(row)
    return rows


GRAMMAR = compose([
    Transducer(2, {(0, INSULT): (1, 1.0), (1, INSULT): (1, 1.2)}),  # an insult, and more of them
    Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5), (1, THREAT): (1, 2.0)}),  # aimed at someone
    Transducer(2, {(0, THREAT): (1, 1.0), (1, INSULT): (1, 1.25)}),  # with a threat
    Transducer(4, {**{(s, NEGATION): (3, 1.0) for s in range(4)}, **{(s, GAP): (max(s - 1, 0), 1.0) for s in range(4)}, **{(s, x): (s, 0.5) for s in (1, 2, 3) for x in (INSULT, THREAT)}}),  # denied
    Transducer(3, {(0, REPORT): (1, 1.0), (1, QUOTE): (2, 1.0), (2, QUOTE): (0, 1.0), **{(s, x): (s, 0.7) for s in (1, 2) for x in (INSULT, THREAT)}}),  # said by others
])


def number_of(*parts: str) -> int:
    """A 63-bit hash, the same in every interpreter."""
    return xxhash.xxh64_intdigest("\0".join(parts)) >> 1


def families(word: str):
    yield word
    for n in PREFIXES:
        if len(word) > n:
            yield word[:n] + "*"


def contexts(words: list[str]):
    """Each word of letters or digits with a hash of its neighbours."""
    for k, w in enumerate(words):
        if w[0].isalnum():
            yield w, number_of(words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "")


def learn_words(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Weights of words and word beginnings that mark toxic texts.

    Evidence is counted in distinct contexts, the words before and after, so that copies of one text count once.
    """
    toxic_texts = [text for text, label in rows if label]
    # features by hash class first, so that only those that may be frequent enough are named
    classes = np.zeros(HASH_CLASSES, np.int32)
    for text in toxic_texts:
        seen = array("q", {number_of(f) % HASH_CLASSES for w in set(TOKEN.findall(text.lower())) if w[0].isalnum() for f in families(w)})
        classes[np.frombuffer(seen, np.int64)] += 1
    number: dict[str, int] = {}
    pairs, sizes = array("q"), [array("q"), array("q")]
    for text in toxic_texts:
        for w, around in contexts(TOKEN.findall(text.lower())):
            sizes[1].append(number_of(w, str(around)))
            for f in families(w):
                if classes[number_of(f) % HASH_CLASSES] >= LEAST_CONTEXTS:
                    pairs.append((number.setdefault(f, len(number)) << 40) | (around & 0xFFFFFFFFFF))
    ids, toxic = np.unique(np.unique(np.frombuffer(pairs, np.int64)) >> 40, return_counts=True) if pairs else (np.zeros(0, int), np.zeros(0, int))
    names = list(number)
    toxic = {names[k]: n for k, n in zip(ids.tolist(), toxic.tolist(), strict=True) if n >= LEAST_CONTEXTS}
    del pairs, number, names, classes
    clean: dict[str, set] = defaultdict(set)
    for text, label in rows:
        if not label:
            for w, around in contexts(TOKEN.findall(text.lower())):
                sizes[0].append(number_of(w, str(around)))
                for f in families(w):
                    if f in toxic:
                        clean[f].add(around)
                        if PURITY * len(clean[f]) > toxic[f]:  # too often in clean texts
                            del toxic[f], clean[f]
    c, t = (max(len(np.unique(np.frombuffer(x, np.int64))), 1) if x else 1 for x in sizes)
    odds = {f: float(np.log((n / t) / ((len(clean[f]) + PRIOR) / c))) for f, n in toxic.items()}
    return {f: x for f, x in odds.items() if x >= LEAST_WEIGHT}


class Scorer:
    def __init__(self, weights: dict[str, float], beta: list[float] | None = None):
        self.weights, self.beta = weights, beta
        self.closed = {w: (k, THREAT_WEIGHT if k == THREAT else 0.0) for k, ws in CLOSED.items() for w in ws.split(" ")}
        self.cache: dict[str, int] = {}
        self.entries: list[tuple[int, float]] = [(NEUTRAL, 0.0)]
        self.numbers: dict[tuple[int, float], int] = {}

    def code(self, word: str) -> int:
        """0 for a neutral word, else the place of its (symbol, weight)."""
        hit = self.closed.get(word)
        if hit is None and word[0].isalnum():
            best = max((self.weights.get(f, 0.0) for f in families(word)), default=0.0)
            hit = (INSULT, best) if best else None
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if hit is None:
            n = 0
        elif hit in self.numbers:
            n = self.numbers[hit]
        else:
            n = self.numbers[hit] = len(self.entries)
            self.entries.append(hit)
        self.cache[word] = n
        return n

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Log of the clause scores' sum, log of the number of clauses that score, and their share in the text's words."""
        words = TOKEN.findall((text or "").lower())
        codes = list(map(self.cache.get, words))
        if None in codes:
            codes = [self.code(w) if c is None else c for w, c in zip(words, codes, strict=True)]
        state, last, clause, score, clauses = 0, -1, 0.0, 0.0, 0
        for k in np.flatnonzero(codes).tolist() if words else ():
            symbol, weight = self.entries[codes[k]]
            for _ in range(min(k - last - 1, 3)):
                state = GRAMMAR[state][GAP][0]
            state, scale = GRAMMAR[state][symbol]
            clause += weight * scale
            last = k
            if symbol == END and clause:
                score, clauses, clause = score + clause, clauses + 1, 0.0
        if clause:
            score, clauses = score + clause, clauses + 1
        return float(np.log1p(score)), float(np.log1p(clauses)), float(np.sqrt(score / (len(words) + 20)))

    def score(self, text: str | None) -> float:
        if self.beta is None:
            return 0.0
        z = self.beta[0] + float(np.dot(self.beta[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge on all but the intercept."""
    x = np.column_stack((np.ones(len(x)), x))
    pull = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def trained(rows: list[tuple[str, int]], counts: dict[int, int]) -> Scorer:
    """Learn from (text, label) rows of both classes; counts of all labels by class set the intercept."""
    scorer = Scorer(learn_words(rows))
    y = np.array([y for _, y in rows], float)
    beta = logistic(np.array([scorer.features(t) for t, _ in rows]), y)
    beta[0] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Scorer(scorer.weights, beta.tolist())


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from documents whose labels' row has toxic and whose crc32(doc_id as text) mod 5 is not 0.

    At most SAMPLE_TOXIC and SAMPLE_CLEAN rows, the first of each class by a hash of the id, meet in one task, and only word weights come
    to the driver. Odds of all such labels set the intercept. Several labels of one id: toxic if any is. Repeated documents of an id all
    count; null texts and ids don't. Without rows of both classes every score is 0.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic <> 1").orderBy(order, "doc_id").limit(SAMPLE_CLEAN))
    ids = F.broadcast(picked.withColumnRenamed("doc_id", "_id"))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(ids, F.col("doc_id") == F.col("_id"))
    rows = rows.select(F.xxhash64("_id", "text").alias("h"), (F.col("toxic") == 1).cast("int").alias("y"), "text")

    def run(batches):
        held = sorted(((h, t, y) for b in batches for h, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        texts = [(t, y) for _, t, y in held]
        if len({y for _, y in texts}) == 2:
            scorer = trained(texts, counts)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((scorer.weights, scorer.beta))], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return Scorer(*pickle.loads(got[0]["model"])) if got else Scorer({})


def score(docs: DataFrame, scorer: Scorer, into: str = "toxicity", text_col: str = "text") -> DataFrame:
    """All columns of docs and the score of the whole text, 0 to 1; null and empty texts score as texts without a matched clause.

    Long texts count whole; rows repeated whole get one score; no rows: none. A column named as `into`, in any case, is refused.
    """
    if fresh(docs, into) != into:
        raise ValueError(f"docs has a column {into}")
    weights, beta = scorer.weights, scorer.beta
    at = docs.columns.index(text_col)

    def run(batches):
        own = Scorer(weights, beta)
        for b in batches:
            yield b.append_column(into, pa.array([own.score(t.as_py()) for t in b.column(at)], pa.float64()))

    return docs.mapInArrow(run, with_field(docs.schema, into, DoubleType()))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), "score")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
