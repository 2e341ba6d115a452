"""Toxicity scores by a classifier that is regularised on counterfactual sentences.

Features are the words of a text and the prefixes of those words (inflected forms share a prefix), each at the levels one,
two and three or more occurrences. Training minimises the log loss of labelled texts, an L2 penalty, and a penalty on the
squared change of the logit under counterfactual sentences: where a text names groups, their terms are swapped for other
groups' terms; where it names none, a term and its swap are put in and the label is kept. Neutral mentions of a group
therefore carry no weight of their own, whether the labelled texts mention groups or not.

The classifier is fitted on a bounded sample of labelled rows: at most ``PER_CLASS`` rows of each label, those of the
smallest hashes. The sample is small enough to be sent to every task; every text is then scored whole (narrow).

Defined results: null text is the empty text and is scored (the intercept); labels with null id or value are left out, a
doc_id with several labels takes the largest; without labels of both kinds every score is 0.5; repeated rows and extra
columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_of, tune

#: Labelled rows of each class that the fit sees at most.
PER_CLASS = 6000
#: Features the model keeps, and training texts a feature must occur in.
CAPACITY, LEAST = 2000, 10
#: Lengths of word prefixes that are features.
PREFIXES = (4, 5, 6)
L2, COUNTERFACTUAL, STEPS = 0.05, 1.0, 300
#: Occurrences of a feature that are told apart: 1, 2, ... up to this many or more.
LEVELS = 3

# Identity terms in groups; a term is swapped for the next one of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "natives"), ("immigrant", "native"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("disabled", "deaf", "blind"),
    ("mexican", "american", "chinese", "african", "european"), ("old", "young"),
)
_WORD = re.compile(r"[^\W\d_]+")


class Terms:
    """Identity terms in groups, and the counterfactual sentences they make."""

    def __init__(self, groups=IDENTITY):
        self.swap = {t: group[(i + 1) % len(group)] for group in groups for i, t in enumerate(group)}
        self.all = sorted(self.swap)

    def counterfactuals(self, words: Counter) -> list[Counter]:
        """The words with their terms swapped; where there are none, with a term put in, and with its swap."""
        hit = words.keys() & self.swap.keys()
        if hit:
            other = Counter({w: n for w, n in words.items() if w not in hit})
            for w in hit:
                other[self.swap[w]] += words[w]
            return [other]
        if not self.all:
            return []
        term = self.all[zlib.crc32(" ".join(sorted(words)).encode()) % len(self.all)]
        return [words + Counter([term]), words + Counter([self.swap[term]])]


def word_features(word: str) -> tuple[str, ...]:
    """A word and its marked prefixes."""
    return (word, *[f"{word[:n]}~" for n in PREFIXES if len(word) > n])


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def text_features(words: Counter) -> set[str]:
    """Features of a text: a name for the first level, the name and the level for more (words have no digits)."""
    total: Counter = Counter()
    for w, n in words.items():
        for f in word_features(w):
            total[f] += n
    return {f"{f}{i}" if i > 1 else f for f, n in total.items() for i in range(1, min(n, LEVELS) + 1)}


def fit(rows: list[tuple[list[int], list[tuple[list[int], list[int]]], int]], size: int) -> tuple[np.ndarray, float]:
    """Weights and intercept from (features, features that each counterfactual adds and drops, label) by full-batch Adam
    steps."""
    y = np.array([r[2] for r in rows], float)
    index = np.array([f for r in rows for f in r[0]], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    pairs = [b for r in rows for b in r[1]]
    # a counterfactual changes the logit by the weights it adds less those it drops
    moved = [(i, f, s) for i, (plus, minus) in enumerate(pairs) for s, fs in ((1.0, plus), (-1.0, minus)) for f in fs]
    at, feature, sign = (np.array(c) for c in zip(*moved, strict=True)) if moved else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    params, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        logit = np.bincount(owner, params[index], len(rows)) + params[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(rows)
        grad = np.append(np.bincount(index, error[owner], size), error.sum())
        grad[:-1] += L2 * params[:-1] / np.sqrt(len(rows))
        if len(at):
            change = np.bincount(at, sign * params[feature], len(pairs))
            grad[:-1] += 2 * COUNTERFACTUAL * np.bincount(feature, sign * change[at], size) / len(pairs)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return params[:-1], float(params[-1])


def sample_of(docs: DataFrame, labels: DataFrame, column: str, folds: int, out: int, per_class: int) -> DataFrame:
    """text and y of the training sample: the ``per_class`` labelled ids of smallest hash of each class."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))
    known = known.where(crc_mod("doc_id", folds) != out)
    parts = [known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # at most 2 * per_class rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")


def train(docs: DataFrame, labels: DataFrame, column: str, folds: int, out: int, per_class: int = PER_CLASS, terms: Terms | None = None) -> tuple[dict[str, float], float] | None:
    """Feature weights and intercept, or None without both labels."""
    sample = sample_of(docs, labels, column, folds, out, per_class)
    terms = terms or Terms()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                sides[y == 1].update(text_features(words_of(text)))
            both = list(sides[0].keys() | sides[1].keys())
            yield pa.record_batch([pa.array(both, pa.string()), pa.array([sides[0][f] for f in both], pa.int64()), pa.array([sides[1][f] for f in both], pa.int64())], names=["feature", "clean", "toxic"])

    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    counts = sample.mapInArrow(counted, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    gap = (F.col("toxic") / sizes[1]) - (F.col("clean") / sizes[0])
    spread = F.sqrt((F.col("toxic") + F.col("clean") + 1.0) / (sizes[0] + sizes[1]))
    top = counts.where(F.col("toxic") + F.col("clean") >= LEAST).orderBy((F.abs(gap) / spread).desc(), "feature").limit(CAPACITY)
    kept = sorted({r["feature"] for r in top.select("feature").collect()} | {f for t in terms.all for f in word_features(t)})
    number = {f: i for i, f in enumerate(kept)}
    numbers = lambda fs: [number[f] for f in fs if f in number]
    ints = pa.list_(pa.int32())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                own = text_features(words)
                a.append(numbers(own))
                others = [text_features(other) for other in terms.counterfactuals(words)]
                b.append([{"plus": numbers(o - own), "minus": numbers(own - o)} for o in others])
            yield pa.record_batch([pa.array(a, ints), pa.array(b, pa.list_(pa.struct([("plus", ints), ("minus", ints)]))), batch.column("y")], names=["a", "b", "y"])

    collected = sample.mapInArrow(vectors, "a array<int>, b array<struct<plus:array<int>,minus:array<int>>>, y int").collect()  # the bounded sample
    rows = [(r["a"], [(o["plus"], o["minus"]) for o in r["b"]], r["y"]) for r in collected]
    weights, intercept = fit(rows, len(kept))
    return {f: float(w) for f, w in zip(kept, weights, strict=True) if abs(w) > 1e-6}, intercept


def scored(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, out: int = 0, per_class: int = PER_CLASS, terms: Terms | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels whose crc32(doc_id) mod folds is not ``out``.
    ``terms`` are the identity terms, IDENTITY where not given."""
    tune(docs.sparkSession)
    model = train(docs, labels, column, folds, out, per_class, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model or ({}, 0.0)
        levels = {f: np.cumsum([weights.get(f"{f}{i}" if i > 1 else f, 0.0) for i in range(1, LEVELS + 1)]).tolist() for f in {f.rstrip("0123456789") for f in weights}}
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                hit: dict[str, int] = {}
                for w, n in words_of(text).items():
                    fs = known.get(w)
                    if fs is None:
                        fs = tuple(f for f in word_features(w) if f in levels)
                        if len(known) < 300_000:
                            known[w] = fs
                    for f in fs:
                        hit[f] = hit.get(f, 0) + n
                logit = intercept + sum(levels[f][min(n, LEVELS) - 1] for f, n in hit.items())
                scores.append(1 / (1 + np.exp(-min(max(logit, -30.0), 30.0))))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (crc_mod("doc_id", folds) == out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir):
    """op8: toxicity of all ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, labels)
