"""Toxicity by weak supervision.

Each word of a seed lexicon and each word, word-beginning pattern and repetition that the training
rows' labels suggest is a voter of its own: it votes toxic where it occurs and abstains elsewhere.
A generative label model sees the votes and the share of toxic rows, but no label: by expectation
maximisation it estimates how often each voter fires on toxic and on clean rows, and from what
the hidden label leaves unexplained the correlations between voters, which share their weight
accordingly. Its posteriors are the labels of a linear classifier over the same features, which
scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Training rows, at most: those with the smallest hash of their id.
MAX_TRAIN = 5000
#: Bytes of training texts, at most: rows are taken in that order while they fit, a longer text is passed over.
MAX_BYTES = 64_000_000
#: Features of the classifier, at most: those with the strongest association.
MAX_FEATURES = 512
THRESHOLD = 0.3
#: Voters share their weight from this correlation on; below it lies the noise of rare voters.
CORRELATED = 0.2
#: Before any votes are seen a voter counts as having cast KNOWN votes with this accuracy.
KNOWN, ACCURACY = 5, 0.98
#: What silence weighs against a vote: words don't occur independently, few of the toxic ones are in any one text.
SILENCE = 0.5
#: Insults that start the lexicon, whatever the training rows hold.
SEED_WORDS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dimwit scumbag crétin abruti imbécile connard trottel vollidiot abschaum dummkopf estúpido imbécil basura".split())
#: The feature of holding any other feature.
ANY = "*"
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 5, 6, 7)
#: A feature counts as repeated from these numbers of occurrences on, if it makes up a word in _DENSITY or more.
_REPEATS = (2, 3)
_DENSITY = 300


def features_of(word: str) -> tuple[str, ...]:
    """A lower-cased word and its beginnings (marked by a *)."""
    return (word, *(word[:k] + "*" for k in _PREFIXES if len(word) >= k))


def words_of(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def features(words: Counter[str]) -> set[str]:
    """The features of a document: its words and their beginnings, and again with #n where they are repeated."""
    n, counts = words.total(), Counter()
    for w, c in words.items():
        for f in features_of(w):
            counts[f] += c
    return {*counts, *(f"{f}#{k}" for f, c in counts.items() if c > 1 and c * _DENSITY >= n for k in _REPEATS if c >= k)}


def near_copy_keys(words: Counter[str]) -> list[int]:
    """The four smallest hashes of the longer words: copies that differ in some words share most of them."""
    some = [w for w in words if len(w) > 8] or list(words)
    return sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in some)[:4]


def associated(texts: list[str | None], toxic: np.ndarray, precision: float = 0.95) -> list[str]:
    """Features that mark toxic rows beyond chance, the strongest first.

    One-sided binomial test against the base rate, at 5 % divided by the number of candidates.
    Only features of at least three toxic rows are held while the clean rows are counted.
    """
    rate = min(max(toxic.mean(), 1e-4), 0.5)
    in_toxic, in_clean = Counter(), Counter()
    for text, label in zip(texts, toxic, strict=True):
        if label:
            in_toxic.update(features(words_of(text)))
    level = math.log(0.05 / max(len(in_toxic), 1))
    in_toxic = {f: a for f, a in in_toxic.items() if a >= 3}
    for text, label in zip(texts, toxic, strict=True):
        if not label:
            in_clean.update(features(words_of(text)) & in_toxic.keys())
    found = []
    for f, a in in_toxic.items():
        n = a + in_clean[f]
        if a >= precision * n:
            p = a / n
            # Chernoff's bound on the binomial tail
            tail = -n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0))
            if tail < level:
                found.append((tail, f))
    return [f for _, f in sorted(found)]


def cast_votes(bags: list[set[str]], voters: list[str]) -> np.ndarray:
    """A row per document and a column per voter: whether it votes toxic; else it abstains."""
    column = {f: k for k, f in enumerate(voters)}
    votes = np.zeros((len(bags), len(voters)), np.float32)
    for r, bag in enumerate(bags):
        votes[r, [column[f] for f in bag if f in column]] = 1
    return votes


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row, accuracy of each voter (the share of toxic rows among its votes) and correlations between voters.

    Expectation maximisation over the hidden label; at first a row with any vote counts as toxic.
    A voter has a rate of votes per label, with a prior that it is right more often than not; its vote speaks for toxic, its silence for clean.
    Correlations are estimated twice, pair by pair, from what the hidden label leaves
    unexplained. Of the voters that fire on a row, correlated ones share their weight, so that the
    many forms of a word speak once; the silence of a voter is shared with all that it is correlated with, as the
    words of one language or family of insults are silent together.
    """
    n, m = votes.shape
    post = np.where(votes.any(axis=1), 0.9, 0.02)
    alike, corr = np.zeros((m, m)), np.eye(m)
    share = np.array([[1 - ACCURACY], [ACCURACY]]) * KNOWN
    for k in range(rounds):
        weight = np.stack([1 - post, post])
        clean, toxic = (weight @ votes + share) / (weight.sum(axis=1, keepdims=True) + KNOWN)
        if k in (1, rounds // 2):
            left = votes - np.outer(1 - post, clean) - np.outer(post, toxic)
            left = left - left.mean(axis=0)
            scale = np.sqrt((left**2).mean(axis=0)) + 1e-9
            corr = (left.T @ left) / max(n, 1) / np.outer(scale, scale)
            alike = np.where(corr > CORRELATED, corr, 0) * (1 - np.eye(m))
        fired = votes / (1 + votes @ alike)
        silent = SILENCE * (1 - votes) / (1 + alike.sum(axis=1))
        base = float(np.clip(post.mean(), 0.5 * prior, min(0.9, 2 * prior)))
        odds = math.log(base / (1 - base)) + fired @ np.log(toxic / clean) + silent @ np.log((1 - toxic) / (1 - clean))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, (post @ votes) / np.maximum(votes.sum(axis=0), 1), corr


def fit_linear(x: np.ndarray, target: np.ndarray, l2: float = 0.02, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method; the intercept is free."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - target) + ridge * w
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(ridge), grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """weights by feature, an intercept, and what the label model found."""

    weights: dict[str, float]
    intercept: float
    accuracies: dict[str, float] | None = None
    correlations: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.stems = {f.partition("#")[0] for f in self.weights}
        #: How the words that have any feature begin; most words are settled by one look at this.
        self.heads = {f.rstrip("*")[: _PREFIXES[0]] for f in self.stems}

    def score(self, text: str | None) -> float:
        counts = Counter()
        words = _WORD.findall((text or "").lower())
        for w, c in Counter(words).items():
            if w[: _PREFIXES[0]] in self.heads:
                for f in features_of(w):
                    if f in self.stems:
                        counts[f] += c
        hits = {*counts, *(f"{f}#{k}" for f, c in counts.items() if c > 1 and c * _DENSITY >= len(words) for k in _REPEATS if c >= k)} & self.weights.keys()
        total = self.intercept + sum(self.weights[f] for f in sorted(hits)) + (self.weights.get(ANY, 0.0) if hits else 0.0)
        return 1 / (1 + math.exp(-max(min(total, 30.0), -30.0)))


def distinct_rows(texts: list[str | None], toxic: list[int]) -> tuple[list[str | None], list[int], list[Counter[str]]]:
    """The rows without near copies of earlier ones: rows whose sets of words have a Jaccard similarity of 0.8 or more.

    Only rows that share two of their keys are compared.
    """
    rows, labels, bags = [], [], []
    by_key: dict[int, list[int]] = {}
    for text, label in zip(texts, toxic, strict=True):
        words = words_of(text)
        keys = near_copy_keys(words)
        shared = Counter(r for k in keys for r in by_key.get(k, ()))
        if any(c >= min(2, len(keys)) and len(words.keys() & bags[r].keys()) >= 0.8 * len(words.keys() | bags[r].keys()) for r, c in shared.items()):
            continue
        for k in keys:
            by_key.setdefault(k, []).append(len(rows))
        rows.append(text)
        labels.append(int(label))
        bags.append(words)
    return rows, labels, bags


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """A model of training texts; without rows of both labels, of the seed words alone."""
    rows, labels, counts = distinct_rows(texts, toxic)
    y = np.array(labels, np.int8)
    if not len(y) or y.min() == y.max():
        return Model(dict.fromkeys(sorted(SEED_WORDS), 4.0), -3.0)
    voters = list(dict.fromkeys([*associated(rows, y)[:MAX_FEATURES], *sorted(SEED_WORDS)]))
    known = set(voters)
    bags = [features(c) & known for c in counts]
    votes = cast_votes(bags, voters)
    post, accuracies, correlations = label_model(votes, float(y.mean()))
    x = np.hstack([votes, votes.any(axis=1, keepdims=True)])
    w, b = fit_linear(x, post)
    return Model({f: float(v) for f, v in zip([*voters, ANY], w, strict=True) if abs(v) > 1e-9}, b, dict(zip(voters, accuracies.tolist(), strict=True)), correlations)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id's text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Train on labelled rows that are not held out, at most max_train of them and max_bytes of text.

    A document with several labels counts as toxic if one of them is; null labels are left out. Of
    rows with equal ids and texts one is taken. Rows come in the order of a hash of their id, then
    of their text, so that reruns agree; only their lengths reach the driver before they are chosen.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = spark.createDataFrame(known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_train).toArrow())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(text).alias("_t_h")).join(F.broadcast(ids), "doc_id")
    order = (F.xxhash64("doc_id", F.lit(11)), "doc_id", "_t_h")
    sizes = rows.select("doc_id", "_t_h", F.octet_length("text").alias("n")).distinct().orderBy(*order).limit(max_train).collect()
    chosen, left = [], max_bytes
    for r in sizes:
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["doc_id"], r["_t_h"]))
    few = spark.createDataFrame(chosen, rows.select("doc_id", "_t_h").schema)
    taken = rows.join(F.broadcast(few), ["doc_id", "_t_h"]).dropDuplicates(["doc_id", "_t_h"]).orderBy(*order).limit(max_train).toArrow()
    return train(taken.column("text").to_pylist(), taken.column("toxic").to_pylist())


def scores(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return of(text)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; null texts score as empty ones."""
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scores(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score below the threshold, with exactly their own columns."""
    return docs.withColumn("_t_score", scores(F.col("text"), model)).filter(F.col("_t_score") < THRESHOLD).select(*docs.columns)
