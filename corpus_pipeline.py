"""A training corpus from raw documents: five stages, each written to the shared folder and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. The stages take nulls, empty and very long texts, repeated rows and empty tables as their
operators in `tablewarden.llm` say.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.llm import jaccard, language, packing, quality, substring
from tablewarden.llm.common import file_bytes, fold, prepare, stored, table

#: Documents whose language is told with a smaller score go, and so do those without letters.
LEAST_LANGUAGE_SCORE = 0.3


_intermediate: list[str] = []


def _tidy(stage):
    """A stage that first deletes what the stage before it stored on the way.

    A stage's result is written before the next stage is called, as `STAGES` are to be used; after that
    nothing reads the intermediate tables of its operator.
    """

    @functools.wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        session.discard(spark, *_intermediate)
        before = len(session.MADE)
        result = stage(spark, docs, sf_dir)
        _intermediate[:] = session.MADE[before:]
        return result

    return tidied


@_tidy
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; learned from the documents themselves, a third held out."""
    model = language.fit(docs, fold(F.col("doc_id"), 3) != 1)
    return language.keep_identified(docs, model, LEAST_LANGUAGE_SCORE)


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them."""
    return quality.clean(docs)


@_tidy
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return jaccard.keep_smallest(docs)


@_tidy
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return substring.drop_repeats(docs)


@_tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in training sequences."""
    tokenizer = file_bytes(public_tokenizers.path("byte_bpe_50k.json")).decode()
    return packing.pack(packing.tokenised_pieces(docs, tokenizer))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification and packing are beyond SQL; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
