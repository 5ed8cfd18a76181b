"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from labelled texts: words whose document frequency among toxic texts is
significantly and many times higher than among the others (equal texts count once). A word hits the
lexicon if it lies within the edit distance that the term's length allows; the product of the lexicon's
trie and the terms' Levenshtein automata is determinised as far as words need it, so most words die after
a few letters. Misspellings that clean texts use as words of their own are learned too and don't count.
Each hit is judged in its context window: inside quotation marks or after a reporting word it is a
quotation, otherwise abuse. A logistic model over the counts gives the score.

At most TRAIN_ROWS labelled rows (those with the smallest hash of doc_id) are used to fit; everything
else covers all rows. Labels, language, source and doc_id are never inputs of a score.

Defined results: null or empty texts have no hits and get the score of such texts; without labels of both
kinds the lexicon is empty and every score is the share of toxic labels (0.5 without any); rows with a
null doc_id are scored and not held out; repeated rows get equal scores; other columns are ignored, and
pass through `keep_clean`. Texts are read whole."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import Memo, arrow_map, documents, prepare, return_memory, stored, texts

TRAIN_ROWS = 20_000
LEAST_ROOT, LEAST_RATIO, LEAST_TEXTS = 6.0, 8.0, 5  # signed root of the log-likelihood ratio, ratio of frequencies, toxic texts
WINDOW = 5
MEMO_WORDS, STATES = 120_000, 50_000
#: Words that report somebody's speech, marks that open or close a quotation, edges of words.
REPORTING = frozenset("said says say quote quoted quotes quoting wrote writes written called calls tweeted posted commented reported citation dijo dit sagte schrieb".split())
QUOTES = frozenset("\"“”„«»‹›")
EDGES = ".,;:!?()[]{}<>\"'“”„«»‹›‘’*_-…"


def allowed_errors(term: str) -> int:
    """Edits within which a word counts as the term."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """Word -> (term number, edits) or None, by the lazily determinised product of trie and Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.slack: list[int] = [0]  # most edits that any term below a node allows
        for number, term in enumerate(terms):
            node = 0
            self.slack[0] = max(self.slack[0], allowed_errors(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.term)
                    self.children.append({})
                    self.term.append(-1)
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed_errors(term))
            self.term[node] = number
        self.longest = max(map(len, terms), default=0) + 2
        self.reset()

    def reset(self) -> None:
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.result: list[tuple[int, int] | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, least: dict[int, int]) -> frozenset:
        """Add what deletions from the term reach: children at one more edit."""
        stack = list(least)
        while stack:
            node = stack.pop()
            errors = least[node] + 1
            for child in self.children[node].values():
                if errors <= self.slack[child] and errors < least.get(child, 99):
                    least[child] = errors
                    stack.append(child)
        return frozenset(least.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.known:
            self.known[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            ends = [(errors, self.term[node]) for node, errors in pairs if self.term[node] >= 0 and errors <= allowed_errors(self.terms[self.term[node]])]
            self.result.append(min(ends)[::-1] if ends else None)
        return self.known[pairs]

    def _move(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.slack[node] and errors < least.get(node, 99):
                least[node] = errors

        for node, errors in self.sets[state]:
            reach(node, errors + 1)  # a letter too many
            for letter, child in self.children[node].items():
                reach(child, errors + (letter != c))
        to = self._state(self._closed(least)) if least else -1
        self.moves[state][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        if len(word) > self.longest or not self.terms:
            return None
        if len(self.sets) > STATES:
            self.reset()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        return self.result[state]


def bare(chunk: str) -> str:
    return chunk.strip(EDGES)


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    excluded: frozenset = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * 6)

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Features and scores of texts, with a bounded memo of words."""

    def __init__(self, model: ToxicityModel):
        self.model, self.automaton = model, LexiconAutomaton(model.terms)
        self.hit = Memo(self._hit, MEMO_WORDS)

    def _hit(self, chunk: str) -> int:
        """0: no hit, 1: a term, 2: a misspelled term."""
        word = bare(chunk)
        found = self.automaton.find(word)
        if found is None or (found[1] and word in self.model.excluded):
            return 0
        return 2 if found[1] else 1

    def features(self, text: str) -> tuple[float, ...]:
        """1, then log counts of terms and misspelled terms as abuse and as quotation, and the share of hits."""
        words = text.lower().split()
        kinds = set(words)
        hits = {w: h for w in kinds if (h := self.hit[w])}
        if not hits:
            return 1.0, 0.0, 0.0, 0.0, 0.0, 0.0
        counts, quoting = [0, 0, 0, 0], False
        for k, word in enumerate(words):
            marks = sum(c in QUOTES for c in word) if not word.isalnum() else 0
            if word in hits:
                quoted = quoting or marks > 0 or any(bare(w) in REPORTING for w in words[max(0, k - WINDOW) : k])
                counts[(hits[word] - 1) + 2 * quoted] += 1
            if marks % 2:
                quoting = not quoting
        return 1.0, *map(math.log1p, counts), math.sqrt(sum(counts) / len(words))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.features(text), self.model.weights))))))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """At most TRAIN_ROWS rows (doc_id, toxic) that aren't held out, by the smallest hash of doc_id."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna()
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn lexicon, excluded words and weights from docs (doc_id, text) with labels (doc_id, toxic)."""
    chosen = docs.join(F.broadcast(training_labels(labels)), "doc_id")  # TRAIN_ROWS pairs of integers at most
    chosen = chosen.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("key")
    chosen = stored(chosen, "toxicity-texts")
    toxic, clean = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not toxic or not clean:
        share = 0.5 if not toxic + clean else min(0.999, max(0.001, toxic / (toxic + clean)))
        return ToxicityModel(weights=[math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0])
    words = chosen.select("toxic", F.explode(F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, F.lit(EDGES))))).alias("word"))
    counts = stored(words.filter("word != ''").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")), "toxicity-words")
    expected = (F.col("t") + F.col("n")) / (toxic + clean)
    part = lambda seen, size: F.when(seen > 0, seen * F.log(seen / (expected * size))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("t"), toxic) + part(F.col("n"), clean))))
    ratio = (F.col("t") / toxic) / ((F.col("n") + 0.5) / clean)
    found = counts.filter((F.col("t") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & (root >= LEAST_ROOT)).orderBy(root.desc(), "word")  # of the words of TRAIN_ROWS texts at most
    model = ToxicityModel([r["word"] for r in found.select("word").collect()])
    terms = model.terms

    def make():
        automaton = LexiconAutomaton(terms)
        return lambda batch: batch.filter(pa.array([bool((f := automaton.find(w)) and f[1]) for w in batch.column(0).to_pylist()], pa.bool_()))

    near = arrow_map(counts.filter("n > 0").select("word", "n"), "word string, n long", make)
    model.excluded = frozenset(r["word"] for r in near.select("word").collect())

    def featured():
        scorer = model.scorer()
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([scorer.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    rows = arrow_map(chosen.select("text", "toxic"), "x array<double>, toxic int", featured).collect()  # TRAIN_ROWS rows of six numbers at most
    model.weights = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept is free."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs (doc_id, text) to doc_id, score."""

    def make():
        scorer = model.scorer()
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return arrow_map(docs, "doc_id long, score double", make)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all their columns, that score below 0.5."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for strings in batches:
            yield strings.map(lambda t: scorer.score(t or ""))
        del scorer
        return_memory()

    return docs.filter(score(docs["text"]) < 0.5)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op6: a toxicity score for every document."""
    prepare(spark)
    docs = texts(documents(spark, sf_dir))
    out = scored(docs, fit(docs, labels_of(spark, sf_dir)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
