"""Ranked lexical search and exact vector search against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablewarden.llm import ranked_search, vector_search

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def rank_by_hand(documents, items, k):
    """Sorted (item_id, rank, doc_id, score) of every item row."""
    held = [(i, Counter(terms_of(t))) for i, t in documents]
    n = sum(1 for _, c in held if c)
    length = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, counts in held:
            if not counts:
                continue
            m = 100 - 90 + 90 * counts.total() * n // length
            score = 0
            for t in set(terms_of(text)) & counts.keys():
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(rows, key=str)


def ranked(spark, documents, items, k=3):
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    return sorted((tuple(r) for r in ranked_search.search(docs, asked, k).collect()), key=str)


EDGE_DOCUMENTS = [
    (1, "The cat, the CAT"), (2, None), (3, ""), (4, "  ...  "), (5, "the cat, the cat"), (6, "ünïcode Ünïcode 漢字 x1"),
    (7, "dog " * 3000), (7, "dog the"), (None, "the cat"), (None, "the cat"), (8, "ÀB àb Straße"),
]


def test_ranking_by_hand_with_nulls_ties_repeats_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "TEXT_PIECE", 50)
    items = [(1, "cat"), (1, "cat"), (2, "the Ünïcode àb"), (3, None), (4, "?"), (None, "dog the dog"), (5, "absent")]
    got = ranked(spark, EDGE_DOCUMENTS, items)
    assert got == rank_by_hand(EDGE_DOCUMENTS, items, 3)
    assert {r[0] for r in got} == {1, 2, None}


def test_ranking_of_empty_tables(spark):
    assert ranked(spark, [], [(1, "cat")]) == []
    assert ranked(spark, EDGE_DOCUMENTS, []) == []
    assert ranked(spark, [(1, None)], [(1, "cat")]) == []


@pytest.mark.parametrize("small", [False, True])
def test_random_rankings_over_tiles_and_blocks(spark, monkeypatch, small):
    if small:
        for name, size in (("ITEMS_PER_BLOCK", 7), ("ITEM_TILE", 3), ("TERM_TILE", 2), ("DOCUMENT_TILE", 8), ("FAN_IN", 2)):
            monkeypatch.setattr(ranked_search, name, size)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    documents = [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 5, 30])))) for i in range(120)]
    documents += [(200 + i, documents[3][1]) for i in range(30)]
    items = [(i, " ".join(draw.choices(words, k=6))) for i in range(20)]
    assert ranked(spark, documents, items, 10) == rank_by_hand(documents, items, 10)


def test_sums_of_a_tile_stay_exact(monkeypatch):
    weights = np.full(5000, 2**22)
    cuts = list(ranked_search.term_tiles(weights))
    assert all((c.stop - c.start) * 2**22 * ranked_search.MOST_IMPACT < 2**53 for c in cuts)
    assert [c.start for c in cuts][1:] == [c.stop for c in cuts][:-1] and cuts[-1].stop == 5000
    assert all(c.stop - c.start <= ranked_search.TERM_TILE for c in ranked_search.term_tiles(np.ones(9000, np.int64)))


def test_registered_ranking(spark):
    got = sorted((tuple(r) for r in entry.queries()["op11_ranked_search"](spark, SF).collect()), key=str)
    documents = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == rank_by_hand(documents, items, 10)


def nearest_by_hand(vectors, asks, k):
    sound = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in vectors
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    rows = []
    for at, (query, q) in enumerate(sound):
        if not asks(query):
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), i is None, i or 0, i) for j, (i, v) in enumerate(sound) if j != at]
        rows += [(query, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(rows, key=str)


def nearest(spark, vectors, k=3, kind="float"):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("clash")).repartition(3)
    return sorted((tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 5 == 0, k).collect()), key=str)


def asks(i):
    return i is not None and i % 5 == 0


EDGE_VECTORS = [
    (0, [0.5, 0.25, 0.0]), (0, [0.5, 0.25, 0.0]), (0, [0.25, 0.25, 0.125]), (1, None), (2, [0.5, None, 1.0]), (3, [float("nan"), 1.0, 1.0]),
    (4, [float("inf"), 0.0, 0.0]), (5, []), (6, [0.0, 0.0, 0.0]), (7, [-0.5, 0.001, -0.001]), (10, [0.5, 0.25]), (None, [0.5, 0.25, 0.0]),
    (None, [1.0, 1.0, 1.0]), (15, [-1.0, -1.0, -1.0, -1.0]), (8, [0.5, 0.25, 0.0]),
]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_by_hand_with_nulls_ties_and_repeats(spark, k):
    assert nearest(spark, EDGE_VECTORS, k) == nearest_by_hand(EDGE_VECTORS, asks, k)


def test_nearest_in_empty_tables(spark):
    assert nearest(spark, []) == []
    assert nearest(spark, [(1, [1.0])]) == []
    assert nearest(spark, [(5, [1.0])]) == []


@pytest.mark.parametrize("small", [False, True])
def test_random_vectors_over_blocks(spark, monkeypatch, small):
    if small:
        for name, size in (("QUERIES_PER_BLOCK", 9), ("QUERY_GROUP", 4), ("CANDIDATE_BLOCK", 16)):
            monkeypatch.setattr(vector_search, name, size)
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0, 0.1, 12) * (draw.random(12) < 0.5))]) for i in range(150)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]
    assert nearest(spark, rows, 5) == nearest_by_hand(rows, asks, 5)


def test_sums_beyond_float64_are_exact_and_beyond_64_bits_an_error(spark):
    wide = [(0, [2.0**20, 1.0]), (1, [2.0**25, 1.0]), (2, [2.0**25, 2.0]), (3, [2.0**25, 1.5])]
    assert nearest(spark, wide, kind="double") == nearest_by_hand(wide, asks, 3)
    with pytest.raises(Exception, match="beyond 64 bits"):
        nearest(spark, [(0, [2.0**40]), (1, [2.0**40])], kind="double")


def test_registered_search(spark):
    got = sorted((tuple(r) for r in entry.queries()["op12_exact_search"](spark, SF).collect()), key=str)
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got == nearest_by_hand(vectors, lambda i: i % 50 == 0, 5)
