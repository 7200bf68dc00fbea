"""Language identification in two steps: the family first, then languages within it one against one.

Features are square roots of the shares of hashed character 1- to 3-grams of the letters. Linear support
vector machines, trained here by dual coordinate descent on a bounded sample, tell families apart (each
against the rest) and the languages of one family (each pair; most votes win, then the larger margin).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm import characters
from tablewarden.llm.common import free_name

BITS = 13
ORDERS = (1, 2, 3)
#: At most so many documents of each language are trained on, those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 250
UNDETERMINED = "und"
STEEPNESS = 3.0  # of the logistic curve that makes a margin a score

# Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo_aryan": "hi bn mr ne gu pa ur si".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue wuu".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(text: str | None) -> np.ndarray | None:
    """A vector of length 1; None for a text without letters."""
    stream = characters.letter_stream(text)
    if not len(stream):
        return None
    buckets = characters.hashed_grams(stream, ORDERS, BITS)
    return np.sqrt(np.bincount(buckets, minlength=1 << BITS) / len(buckets)).astype(np.float32)


def train_svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine, the last one for the constant 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sign = np.where(positive, 1.0, -1.0)
    # The smaller class counts for more, so that both weigh the same.
    share = np.where(positive, positive.mean(), 1 - positive.mean())
    limit = cost * 0.5 / np.maximum(share, 1e-9)
    squares = np.einsum("ij,ij->i", x, x)
    dual, weights = np.zeros(len(x)), np.zeros(x.shape[1])
    shuffled = np.random.default_rng(7)
    for _ in range(rounds):
        for i in shuffled.permutation(len(x)):
            slope = sign[i] * float(x[i] @ weights) - 1.0
            new = min(max(dual[i] - slope / squares[i], 0.0), limit[i])
            if new != dual[i]:
                weights += (new - dual[i]) * sign[i] * x[i]
                dual[i] = new
    return weights


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray | None = None  # one column for each family
    pair_weights: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)  # positive: the first

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text)
        if x is None or not self.families:
            return UNDETERMINED, 0.0
        family, score = self.families[0], 1.0
        if len(self.families) > 1:
            margins = x @ self.family_weights[:-1] + self.family_weights[-1]
            order = np.argsort(-margins, kind="stable")
            family = self.families[order[0]]
            score = _squash((margins[order[0]] - margins[order[1]]) / 2)
        return self._within(family, x, score)

    def _within(self, family: str, x: np.ndarray, score: float) -> tuple[str, float]:
        languages = self.members[family]
        votes = {code: [0, 0.0] for code in languages}
        margins = {}
        for pair in [(a, b) for i, a in enumerate(languages) for b in languages[i + 1 :]]:
            weights = self.pair_weights[pair]
            margin = float(x @ weights[:-1] + weights[-1])
            margins[pair] = margin
            winner = pair[0] if margin > 0 else pair[1]
            votes[winner][0] += 1
            votes[pair[0]][1] += margin
            votes[pair[1]][1] -= margin
        best = max(languages, key=lambda code: (*votes[code], code))
        own = [_squash(m if pair[0] == best else -m) for pair, m in margins.items() if best in pair]
        return best, float(score * (np.mean(own) if own else 1.0))


def _squash(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-STEEPNESS * margin)))


def train(x: np.ndarray, languages: list[str], family_of: Mapping[str, str] = FAMILY_OF) -> LanguageModel:
    """A model of one feature row and one language for each document; without any it answers `und`."""
    model = LanguageModel()
    labels = np.array(languages, dtype=object)
    for code in sorted(set(languages)):
        model.members.setdefault(family_of.get(code, code), []).append(code)
    model.families = sorted(model.members)
    kin = np.array([family_of.get(code, code) for code in languages], dtype=object)
    if len(model.families) > 1:
        model.family_weights = np.column_stack([train_svm(x, kin == f) for f in model.families]).astype(np.float32)
    for codes in model.members.values():
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                rows = (labels == a) | (labels == b)
                model.pair_weights[a, b] = train_svm(x[rows], labels[rows] == a).astype(np.float32)
    return model


def fit(
    docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the rows where `learnable` holds and key, text and language are there.

    The sample is at most `per_language` rows of each language, also with repeated keys, and of equal rows
    one. Only its ids and hashes of its texts are ranked, so no text is shuffled before, and only feature
    vectors of the sample reach the driver.
    """
    rows = docs.where(learnable).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).dropna().withColumn("h", F.xxhash64("t"))
    own = ["k", "l", "h"]
    ranked = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k", "h")
    sample = rows.select(own).withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= per_language)

    @F.pandas_udf("binary")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if (x := features(t)) is None else x.tobytes())

    # The sample's rows are bounded by `per_language`, so sending them to all tasks is safe.
    chosen = rows.join(F.broadcast(sample.select(own).distinct()), own).dropDuplicates(own)
    got = [r for r in chosen.select("k", "l", vectors("t").alias("x")).collect() if r.x is not None]
    got.sort(key=lambda r: (r.l, r.k, bytes(r.x)))
    if not got:
        return LanguageModel()
    return train(np.array([np.frombuffer(r.x, np.float32) for r in got]), [r.l for r in got])


def predicted(text: Column, model: LanguageModel) -> Column:
    """struct(lang_pred, score) of a text: `und` and 0 for null and for texts without letters."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    # Marked so that the optimizer never copies the call into a filter and a projection.
    return predict.asNondeterministic()(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`docs` with a struct column `language` (lang_pred, score), underscored where the name is taken.

    Rows stand alone: ids may be null or repeated, other columns pass unread, an empty table stays empty.
    """
    return docs.withColumn(free_name(docs, "language"), predicted(F.col(text), model))


def keep_identified(docs: DataFrame, model: LanguageModel, least: float, text: str = "text") -> DataFrame:
    """The documents whose language is told with a score of `least` or more."""
    found = identify(docs, model, text)
    name = found.columns[-1]
    sure = (F.col(name)["lang_pred"] != UNDETERMINED) & (F.col(name)["score"] >= least)
    return found.where(sure).select(*docs.columns)
