"""Exact top-k by integer inner product: exhaustive, a term at a time.

Components are scaled and rounded down to whole numbers; a vector is a sparse row of its components other
than zero. Candidates come in blocks, each turned into postings: for every dimension the candidates that
hold it, with their weights. For a group of queries, dimension by dimension, the weighted postings are
scattered into a dense array of scores; the array is then cut by partition selection, with all that equal
the last kept score, and merged with what earlier blocks left.

Sums are float64 where a bound shows that they stay below 2^53, and Python's integers otherwise, so they
are exact; a score beyond 64 bits is an error, as overflow is in Spark.

Vectors that are null or hold null or non-finite components take no part. Vectors may differ in length: what
one lacks counts as zero. A query's own row is left out of its answer, other rows with its id are not. Every
row is its own query or candidate, also with a repeated id; null ids come last among equals. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.common import prepare, stored
from tablewarden.llm.ranked_search import best_of

#: Queries, and components of queries, for which the candidates are read once.
QUERIES_PER_BLOCK, COMPONENTS_PER_BLOCK = 8192, 1 << 20
#: Candidates and queries of one dense array of scores.
CANDIDATE_BLOCK, QUERY_GROUP = 2048, 64
EXACT = float(2**53)


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return vector.isNotNull() & ~odd


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    whole = np.floor(scale * values.astype(np.float64))
    if not np.isfinite(whole).all():
        raise OverflowError("a scaled component is beyond float64")
    return whole


def postings(values: np.ndarray, lengths: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows whose component is not zero, and these components."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    dimension = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    held = np.flatnonzero(values)
    held = held[np.argsort(dimension[held], kind="stable")]
    dimensions, starts = np.unique(dimension[held], return_index=True)
    return {int(d): (row[own], values[own]) for d, own in zip(dimensions, np.split(held, starts[1:]))}


def _long(score: int) -> int:
    if not -(2**63) <= score < 2**63:
        raise OverflowError("an inner product is beyond 64 bits")
    return score


class QueryGroup:
    """Some sparse queries: for each dimension the queries that hold it, and their weights."""

    def __init__(self, first: int, values: list[np.ndarray]):
        self.first, self.size = first, len(values)
        self.terms = postings(np.concatenate(values), np.array([len(v) for v in values]))
        self.most = {d: np.abs(w).max() for d, (_, w) in self.terms.items()}

    def scores(self, held: dict[int, tuple[np.ndarray, np.ndarray]], most: dict[int, float], candidates: int) -> np.ndarray:
        """Inner products, candidates by queries."""
        exact = sum(self.most[d] * most[d] for d in self.terms.keys() & held.keys()) < EXACT
        total = np.zeros((candidates, self.size), np.float64 if exact else object)
        for d, (queries, weights) in self.terms.items():
            if d in held:
                rows, own = held[d]
                if not exact:
                    weights, own = (np.array([int(x) for x in a], object) for a in (weights, own))
                share = own[:, None] * weights[None, :]
                if len(queries) == self.size:
                    total[rows] += share
                else:
                    total[np.ix_(rows, queries)] += share
        if exact:
            return total.astype(np.int64)
        return np.array([[_long(s) for s in row] for row in total], np.int64).reshape(total.shape)


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k, self.kept = k, [[] for _ in range(queries)]
        self.least = np.full(queries, np.iinfo(np.int64).min)

    def add(self, first: int, scores: np.ndarray, ids: list) -> None:
        least = self.least[first : first + scores.shape[1]]
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores.T, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero(scores.T >= least[:, None])
        ends = np.searchsorted(query, np.arange(scores.shape[1] + 1))
        for q in np.flatnonzero(np.diff(ends)):
            mine = row[ends[q] : ends[q + 1]].tolist()
            found = self.kept[first + q] + [(-s, ids[r] is None, ids[r]) for s, r in zip(scores[mine, q].tolist(), mine)]
            self.kept[first + q] = found = sorted(found, key=lambda x: x[:2] if x[1] else x)[: self.k]
            if len(found) == self.k:
                self.least[first + q] = -found[-1][0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= CANDIDATE_BLOCK:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _searched(sent, scale: float, k: int) -> Callable:
    """(question, id, score) of each question's k best candidates of a task."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = [scaled(v, scale) for v in sent.value]
        groups = [QueryGroup(at, questions[at : at + QUERY_GROUP]) for at in range(0, len(questions), QUERY_GROUP)]
        best, kind = Best(len(questions), k), None
        for table in _blocks(batches):
            kind, ids = table.schema.field("id").type, table.column("id").to_pylist()
            vectors = table.column("vector").combine_chunks()
            held = postings(scaled(vectors.flatten().to_numpy(), scale), vectors.value_lengths().to_numpy())
            most = {d: np.abs(w).max() for d, (_, w) in held.items()}
            for group in groups:
                best.add(group.first, group.scores(held, most, len(table)), ids)
        found = [(question, i, -s) for question, kept in enumerate(best.kept) for s, _, i in kept]
        if found:
            question, own, score = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(question, pa.int64()), pa.array(own, kind), pa.array(score, pa.int64())], names=["question", "id", "score"]
            )

    return searched


def top_k(vectors: DataFrame, asks: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that `asks`, the k rows, but itself, of the highest scores."""
    spark = prepare(vectors.sparkSession)
    sound = vectors.where(usable(F.col(vector)))
    rows = sound.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    # Equal rows ask the same and are answered once, each with its own row left out.
    questions = sound.where(asks).groupBy(F.col(id_column).alias("id"), F.col(vector).alias("vector")).agg(F.count("*").alias("asked"))
    size = questions.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("components")).first()
    blocks = max(1, -(-size["n"] // QUERIES_PER_BLOCK), -(-size["components"] // COMPONENTS_PER_BLOCK))
    kind = vectors.schema[id_column].dataType
    found_schema = T.StructType(
        [T.StructField("question", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())]
    )
    asked_schema = T.StructType(
        [*(T.StructField(n, T.LongType()) for n in ("question", "asked", "self")), T.StructField("query_id", kind)]
    )
    order, answers = [F.desc("score"), F.asc_nulls_last("id")], []
    for number in range(blocks):
        # A block has as many questions as fit in memory, by the counts above: no whole table of queries gets here.
        block = questions.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == number).orderBy("id", "vector").collect()
        values = [np.array(row["vector"], np.float64) for row in block]
        own = [_long(sum(int(x) * int(x) for x in scaled(v, scale))) for v in values]
        names = spark.createDataFrame([(i, row["asked"], own[i], row["id"]) for i, row in enumerate(block)], asked_schema)
        found = rows.mapInArrow(_searched(spark.sparkContext.broadcast(values), scale, k + 1), found_schema)
        answer = _without_own(best_of(found, ["question"], order, k + 1).join(names, "question"), k).select(
            "query_id", "rank", F.col("id").alias(id_column), "score"
        )
        answers.append(answer if blocks == 1 else stored(answer, "answers"))
    return reduce(DataFrame.unionByName, answers)


def _without_own(ranked: DataFrame, k: int) -> DataFrame:
    """The k first of the k + 1 rows kept for each question, without its own, once for every row that asks it."""
    # A twin of the own row, with its id and score, is as good to leave out.
    twin = F.col("id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("self"))
    kept = ranked.groupBy("question", "query_id", "asked").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("found"), F.min(F.when(twin, F.col("rank"))).alias("own")
    )
    others = F.slice(F.filter("found", lambda f: ~f["rank"].eqNullSafe(F.col("own"))), 1, k)
    hits = kept.select("query_id", "asked", F.posexplode(others).alias("place", "hit"))
    every = hits.select("query_id", (F.col("place") + 1).alias("rank"), "hit.id", "hit.score", F.explode(F.sequence(F.lit(1).cast("long"), "asked")))
    return every.drop("col")
