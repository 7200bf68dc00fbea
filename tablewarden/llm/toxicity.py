"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Each document is the set of its hashed character n-grams. The ratio of a bucket compares in how many
toxic and in how many clean documents of the sample it occurs; a linear support vector machine is trained
on the sets scaled by these ratios, and its weights times the ratios are the model: one number per bucket.
A logistic curve makes the sum a score. It is fitted to the margins that each document of the sample gets
from a model trained without it, and both classes weigh the same in it, however few toxic documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import characters
from tablewarden.llm.common import free_name

BITS = 18
ORDERS = (3, 4, 5, 6)
#: At most so many documents of each class are trained on, those with the smallest hash of their id.
SAMPLE_PER_CLASS = 1500
#: A bucket must occur in so many documents of the sample to have a weight.
LEAST_DOCUMENTS = 3
#: Buckets that are nearly as frequent in either class get no weight.
LEAST_RATIO = 1.0
THRESHOLD = 0.7
#: The curve's margins come from so many models, each trained without its share of the sample.
FOLDS = 5


def gram_set(text: str | None, scratch: np.ndarray) -> np.ndarray:
    stream = characters.letter_stream(text)
    return characters.distinct(characters.hashed_grams(stream, ORDERS, BITS), scratch)


def new_scratch() -> np.ndarray:
    return np.zeros(1 << BITS, np.int32)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, scratch: np.ndarray) -> float:
        margin = self.bias + float(self.weights[gram_set(text, scratch)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40))))


def _ratios(sets: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The logarithm of how much more often a bucket occurs in toxic documents; 0 for rare buckets."""
    size, n_toxic = 1 << BITS, int(toxic.sum())
    in_toxic = np.zeros(size)
    in_clean = np.zeros(size)
    for buckets, is_toxic in zip(sets, toxic):
        (in_toxic if is_toxic else in_clean)[buckets] += 1
    ratio = np.log((in_toxic + 1) / (n_toxic + 2)) - np.log((in_clean + 1) / (len(sets) - n_toxic + 2))
    ratio[(in_toxic + in_clean < LEAST_DOCUMENTS) | (np.abs(ratio) < LEAST_RATIO)] = 0.0
    return ratio


def _machine(sets: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, rounds: int, cost: float) -> tuple[np.ndarray, float]:
    """Linear support vector machine over the scaled sets (dual coordinate descent, squared hinge loss)."""
    sets = [s[ratio[s] != 0] for s in sets]
    values = [ratio[s] for s in sets]
    limit = np.where(toxic, len(sets) / (2 * toxic.sum()), len(sets) / (2 * (~toxic).sum())) * cost
    sign = np.where(toxic, 1.0, -1.0)
    diagonal = 0.5 / limit
    squares = np.array([v @ v + 1.0 for v in values]) + diagonal
    weights, bias, dual = np.zeros(1 << BITS), 0.0, np.zeros(len(sets))
    shuffled = np.random.default_rng(7)
    for _ in range(rounds):
        for i in shuffled.permutation(len(sets)):
            slope = sign[i] * (float(weights[sets[i]] @ values[i]) + bias) - 1.0 + diagonal[i] * dual[i]
            step = max(dual[i] - slope / squares[i], 0.0) - dual[i]
            if step:
                weights[sets[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                dual[i] += step
    return weights * ratio, bias


def _curve(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that turns margins into shares of toxic documents (Newton steps)."""
    # Smoothed targets keep the curve finite where the classes part cleanly.
    target = np.where(toxic, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((~toxic).sum() + 2))
    share = np.where(toxic, len(toxic) / (2 * toxic.sum()), len(toxic) / (2 * (~toxic).sum()))
    x = np.column_stack([margin, np.ones(len(margin))])
    found = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ found, -30, 30)))
        bend = (x * (share * p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(bend, x.T @ (share * (p - target)))
        found -= np.clip(move, -2, 2)
    return float(max(found[0], 1e-3)), float(found[1])


def train(sets: list[np.ndarray], toxic: np.ndarray, rounds: int = 8, cost: float = 0.003) -> ToxicityModel:
    """Fit the weights; with fewer than five documents of a class, every score is the smoothed share of toxic ones."""
    size, toxic = 1 << BITS, np.asarray(toxic, bool)
    share = (toxic.sum() + 0.5) / (len(sets) + 1)
    if min(toxic.sum(), (~toxic).sum()) < FOLDS:
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    fold = np.empty(len(sets), int)  # by place within the class, so that all parts hold both classes
    for kind in (toxic, ~toxic):
        fold[kind] = np.arange(kind.sum()) % FOLDS

    def fitted(rows: np.ndarray) -> tuple[np.ndarray, float]:
        own = [sets[i] for i in np.flatnonzero(rows)]
        return _machine(own, toxic[rows], _ratios(own, toxic[rows]), rounds, cost)

    margin = np.empty(len(sets))
    for out in range(FOLDS):
        weights, bias = fitted(fold != out)
        margin[fold == out] = [weights[sets[i]].sum() + bias for i in np.flatnonzero(fold == out)]
    slope, shift = _curve(margin, toxic)
    weights, bias = fitted(np.ones(len(sets), bool))
    return ToxicityModel((weights * slope).astype(np.float32), float(bias * slope + shift))


def fit(
    docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text",
    label: str = "toxic", per_class: int = SAMPLE_PER_CLASS,
) -> ToxicityModel:
    """Learn from labelled rows where `learnable` (of the label's key) holds.

    A key labelled twice counts as toxic if one of its labels says so; null keys, labels and texts are
    left out. The sample is at most `per_class` texts of `per_class` keys of each class, also with repeated
    keys, and of equal rows one. Only ids and hashes of texts are ranked, and only the sample's bucket
    sets reach the driver.
    """
    known = labels.where(learnable).select(F.col(key).alias("k"), F.col(label).alias("y")).dropna()
    known = known.groupBy("k").agg((F.max("y") == 1).alias("y"))

    def first_of_each_class(rows: DataFrame, *order: Column) -> DataFrame:
        # Each task keeps no more than what is asked for, whatever the share of a class.
        of_class = [rows.where(F.col("y") == kind).orderBy(*order).limit(per_class) for kind in (True, False)]
        return of_class[0].unionByName(of_class[1])

    ids = first_of_each_class(known, F.xxhash64("k"), F.col("k"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).dropna().withColumn("h", F.xxhash64("t"))
    # The sample's ids and rows are bounded by `per_class`, so sending them to all tasks is safe.
    texts = rows.select("k", "h").join(F.broadcast(ids), "k").distinct()
    sample = first_of_each_class(texts, F.xxhash64("k"), F.col("k"), F.col("h"))

    @F.pandas_udf("binary")
    def sets(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scratch = new_scratch()
        for batch in texts:
            yield batch.map(lambda t: gram_set(t, scratch).tobytes())

    chosen = rows.join(F.broadcast(sample), ["k", "h"]).dropDuplicates(["k", "h"])
    got = chosen.select("k", "y", sets("t").alias("x")).collect()
    got.sort(key=lambda r: (r.k, bytes(r.x)))
    return train([np.frombuffer(r.x, np.int32) for r in got], np.array([r.y for r in got], bool))


def scored(text: Column, model: ToxicityModel, threshold: float = THRESHOLD) -> Column:
    """struct(score, predicted) of a text; null and empty texts have the score of no n-grams."""

    @F.pandas_udf("score double, predicted int")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scratch = new_scratch()
        for batch in texts:
            values = np.array([model.score(t, scratch) for t in batch], float)
            yield pd.DataFrame({"score": values, "predicted": (values >= threshold).astype(np.int32)})

    return score.asNondeterministic()(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with a struct column `toxicity` (score, predicted), underscored where the name is taken.

    Rows stand alone: ids may be null or repeated, other columns pass unread, an empty table stays empty.
    """
    return docs.withColumn(free_name(docs, "toxicity"), scored(F.col(text), model, threshold))
