"""Ranked lexical search: the items' terms against the documents' impacts, as dense float64 matrices.

Only terms that items use are kept of a document. Items go in blocks whose terms fit in memory; within a
block, tiles of some items with the terms those items use are multiplied with tiles of documents. Weights
and impacts are whole numbers and a tile's terms are so few that its sums stay below 2^53, where float64
is exact; sums of several tiles are 64-bit integers. A tile of scores is cut at its k-th highest with all
that equal it, so that equal scores are told apart by document id only once all of them are there.

Null, empty or termless texts count for nothing and are never found; items without terms have no rows.
Every row is a document or an item of its own, also with a repeated or null id: repeated items are each
answered, repeated documents each found. Null document ids come last among equals. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.common import prepare, stored

# The characters between terms, as a class of Java patterns.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Items, and terms of items, for which the documents are read once.
ITEMS_PER_BLOCK, TERMS_PER_BLOCK = 8192, 1 << 18
#: Items, terms and documents of one multiplication, at most.
ITEM_TILE, TERM_TILE, DOCUMENT_TILE = 64, 2048, 1024
#: Bytes of a text that are split at a time.
TEXT_PIECE = 1 << 20
#: A term's impact on a document is below this.
MOST_IMPACT = 10**6

# UTF-8 bytes of other than ASCII characters are all above 127, so bytes can be folded one by one.
_FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def term_counts(text: bytes | None) -> Counter[bytes]:
    """How often each term occurs in a text."""
    counts: Counter[bytes] = Counter()
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + TEXT_PIECE)
        end = len(folded) if end < 0 else end
        counts.update(folded[at:end].split())
        at = end
    return counts


def _counted(vocabulary) -> Callable:
    """(doc, length, terms, counts) of each text: all its terms by number, those of the vocabulary by count."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                found = term_counts(text.as_py())
                lengths.append(found.total())
                own = [(number[t], c) for t, c in found.items() if t in number]
                terms.append([t for t, _ in own])
                counts.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc", "length", "terms", "counts"],
            )

    return counted


#: In the place of a term's number: documents with a term, and all their terms.
_DOCUMENTS, _LENGTH = -1, -2


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of a task's documents: how many hold a term."""
    holders, documents, length = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        documents, length = documents + int((lengths > 0).sum()), length + int(lengths.sum())
        found = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(holders))
        found[: len(holders)] += holders
        holders = found
    held = np.flatnonzero(holders)
    rows = [np.append(held, [_DOCUMENTS, _LENGTH]), np.append(holders[held], [documents, length])]
    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in rows], names=["term", "n"])


def weight(holders: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def impacts(counts: np.ndarray, lengths: list[int], owner: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The impact of each count on the document that owns it."""
    m = np.array([100 - 90 + 90 * n * documents // length for n in lengths], np.int64)  # of exact Python integers
    return 1_000_000_000 * counts // (1000 * counts + 8 * m[owner])


def term_tiles(weights: np.ndarray) -> Iterator[slice]:
    """Cut a rising list of an item tile's terms so that no sum over a cut can reach 2^53."""
    start = 0
    while start < len(weights):
        most = int(weights[start : start + TERM_TILE].max(initial=0))
        end = min(len(weights), start + max(1, min(TERM_TILE, (2**53 - 1) // max(1, most * MOST_IMPACT))))
        yield slice(start, end)
        start = end


class ItemTile:
    """Some items with the terms that they use: for each cut of the terms, a dense matrix of weights."""

    def __init__(self, first: int, items: list[np.ndarray], weights: np.ndarray):
        self.first, self.rows = first, len(items)
        self.terms = np.unique(np.concatenate(items))
        self.cuts = []
        for cut in term_tiles(weights[self.terms]):
            terms = self.terms[cut]
            matrix = np.zeros((len(items), len(terms)))
            for row, item in enumerate(items):
                own = np.flatnonzero(np.isin(terms, item, assume_unique=True))
                matrix[row, own] = weights[terms[own]]
            self.cuts.append((cut.start, matrix))

    def scores(self, terms: np.ndarray, owner: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
        """64-bit scores, items by documents."""
        place = np.searchsorted(self.terms, terms)
        place[place == len(self.terms)] = 0
        held = self.terms[place] == terms
        place, owner, impact = place[held], owner[held], impact[held]
        total = np.zeros((self.rows, documents), np.int64)
        for start, matrix in self.cuts:
            here = (place >= start) & (place < start + matrix.shape[1])
            dense = np.zeros((matrix.shape[1], documents))
            dense[place[here] - start, owner[here]] = impact[here]
            total += (matrix @ dense).astype(np.int64)
        return total


class Best:
    """The k best (score, id) of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.kept = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # what a score must reach to matter

    def add(self, first: int, scores: np.ndarray, ids: list) -> None:
        least = self.least[first : first + len(scores)]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        rows, columns = np.nonzero(scores >= least[:, None])
        ends = np.searchsorted(rows, np.arange(len(scores) + 1))
        for row in np.flatnonzero(np.diff(ends)):
            mine = columns[ends[row] : ends[row + 1]]
            found = self.kept[first + row] + [(-s, ids[c] is None, ids[c]) for s, c in zip(scores[row, mine].tolist(), mine.tolist())]
            self.kept[first + row] = found = sorted(found, key=lambda x: x[:2] if x[1] else x)[: self.k]
            if len(found) == self.k:
                self.least[first + row] = -found[-1][0]


def _tiles_of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= DOCUMENT_TILE:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _ranked(block, documents: int, length: int, k: int) -> Callable:
    """(item, doc, score) of each item's k best documents of a task."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = block.value
        tiles = [ItemTile(at, items[at : at + ITEM_TILE], weights) for at in range(0, len(items), ITEM_TILE)]
        best, kind = Best(len(items), k), None
        for table in _tiles_of_documents(batches):
            kind = table.schema.field("doc").type
            held = table.column("terms").combine_chunks()
            owner = np.repeat(np.arange(len(table)), held.value_lengths().to_numpy())
            terms, counts = held.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy()
            impact = impacts(counts, table.column("length").to_pylist(), owner, documents, length)
            ids = table.column("doc").to_pylist()
            for tile in tiles:
                best.add(tile.first, tile.scores(terms, owner, impact, len(table)), ids)
        found = [(item, i, -s) for item, kept in enumerate(best.kept) for s, _, i in kept]
        if found:
            item, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    return ranked


#: Rows of one item's last ranking come from so many earlier ones, each over a share of all tasks.
FAN_IN = 64


def best_of(found: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The k first rows of each key with their rank, by way of shares, so that no task reads all tasks' rows of a key."""
    share = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
    rank = F.row_number().over(Window.partitionBy(*key, "share").orderBy(*order))
    short = found.withColumn("share", share).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank", "share")
    return short.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    spark = prepare(documents.sparkSession)
    schema = T.StructType([T.StructField("doc", documents.schema[doc_id].dataType)])
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    asked = items.select(
        F.col(item_id).alias("item_id"), F.array_sort(F.array_distinct(F.filter(F.split(folded, BREAKS), lambda t: t != ""))).alias("terms")
    ).where(F.size("terms") > 0)
    asked = asked.select("item_id", "terms", F.sha2(F.array_join("terms", " ").cast("binary"), 256).alias("question"))
    # Items with the same terms have the same answer, which is found once.
    questions = asked.dropDuplicates(["question"])
    size = questions.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-size["items"] // ITEMS_PER_BLOCK), -(-size["terms"] // TERMS_PER_BLOCK))
    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    answers = []
    for number in range(blocks):
        # A block has as many questions as fit in memory, by the counts above: no whole table of items gets here.
        block = questions.where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == number).orderBy("question").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({t.encode() for row in block for t in row["terms"]}))}
        counted = stored(
            rows.mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)), _with(schema, "length long, terms array<int>, counts array<long>")),
            "impacts",
        )
        totals = dict(counted.select("length", "terms").mapInArrow(_totals, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        n, length = totals.get(_DOCUMENTS, 0), totals.get(_LENGTH, 0)
        weights = np.array([weight(totals.get(i, 0), n) for i in range(len(vocabulary))], np.int64)
        held = [np.array(sorted(vocabulary[t.encode()] for t in row["terms"]), np.int32) for row in block]
        sent = spark.sparkContext.broadcast((held, weights))
        names = spark.createDataFrame([(i, row["question"]) for i, row in enumerate(block)], "item long, question string")
        found = counted.where(F.size("terms") > 0).mapInArrow(_ranked(sent, n, length, k), _with(schema, "score long", "item long"))
        ranked = best_of(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc")], k)
        ranked = ranked.join(names, "item").select("question", "rank", "doc", "score")
        answers.append(ranked if blocks == 1 else stored(ranked, "answers"))
    return asked.join(reduce(DataFrame.unionByName, answers), "question").select(F.col("item_id").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def _with(doc: T.StructType, after: str, before: str = "") -> T.StructType:
    """A schema with the document's id, whatever its type, between other columns."""
    fields = [*(T.StructType.fromDDL(before).fields if before else []), *doc.fields, *T.StructType.fromDDL(after).fields]
    return T.StructType(fields)
