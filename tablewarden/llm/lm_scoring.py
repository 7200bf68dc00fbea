"""Scoring documents by a language model of the corpus.

Word counts come from all training documents. The most frequent words are the vocabulary of a gated
recurrent model (see `recurrent`), all others share one symbol there and are told apart by their counts.
Every text is turned into the numbers of its words once; training and scoring read these. The
recurrent model is trained on every training document, in rounds: documents are dealt to shards by a hash of
key and text, each shard goes on from the same weights over its own documents of the round, and the shards'
weights are averaged by their numbers of words. So the model follows from the rows, not from how the table
is split. Counts of frequent words go to every task as a table of fixed size; those of rare words, of
which there may be any number, meet the documents' rare words in a join.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import slots_of, stored
from tablewarden.llm.hashing import xxh64
from tablewarden.llm.recurrent import LanguageModel

#: Words of the recurrent model, and words whose counts every task holds.
VOCABULARY, FREQUENT = 4096, 65_536
#: Training documents are dealt into so many turns; each round trains on some of them, together on all.
TURNS, ROUNDS = 8, ((0, 1), (1, 4), (4, 8))
#: Words of one shard, on average over all rounds.
SHARD_WORDS = 8_000_000
#: Adam's rate; in the last round it falls to the second.
RATE, LAST_RATE = 0.04, 0.001
#: Weights are averaged in so many pieces.
PIECES = 64
#: Counts that a task holds and words it trains on, and words that it scores, at a time.
WORDS_AT_ONCE, SCORED_AT_ONCE = 2_000_000, 8_000_000
END, OTHER = 0, 1  # numbers of the special words


@dataclass
class Corpus:
    """What tasks need of the training corpus; words are named by 64-bit hashes."""

    codes: np.ndarray  # of the frequent words, rising
    counts: np.ndarray
    numbers: np.ndarray  # in the recurrent model; OTHER beyond its vocabulary
    documents: int
    tokens: int
    distinct: int
    other_tokens: int  # outside the recurrent model's vocabulary
    other_distinct: int


def _named(words: pa.Array) -> np.ndarray:
    """The words' 64-bit names."""
    _, ends, data = words.cast(pa.binary()).buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return xxh64(data.to_pybytes() if data else b"", ends).view(np.int64)


def _code(word: bytes) -> int:
    return int(_named(pa.array([word]))[0])


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of words, the names of the different words of all of them, and for each word its place among these.

    Words are parted by ASCII white space, and A-Z, and only these, lower-cased; null texts have none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.values
    # White space at an end of a text leaves an empty word there.
    some = pc.binary_length(words).to_numpy() > 0
    ends = np.append(0, np.cumsum(some))[split.offsets.to_numpy()]
    if not some.all():
        words = words.filter(pa.array(some))
    encoded = words.dictionary_encode()
    return np.diff(ends), _named(encoded.dictionary), encoded.indices.to_numpy()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, count) of every word of the documents; each task counts before anything is shuffled."""

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            codes, counts = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(codes)
            codes, first = np.unique(codes[order], return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.add.reduceat(counts[order], first))], names=["code", "count"])

        for batch in batches:
            _, codes, index = _split(batch.column(0))
            if len(codes):
                held.append((codes, np.bincount(index, minlength=len(codes))))
                size += len(codes)
            if size >= WORDS_AT_ONCE:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select(text).mapInArrow(counts_of, "code bigint, count bigint").groupBy("code").agg(F.sum("count").alias("count"))


def count_corpus(training: DataFrame) -> tuple[Corpus, LanguageModel, DataFrame]:
    """What the counts of the training rows (column `t`) tell, the untrained model, and the table of all counts."""
    counts = stored(word_counts(training, "t"), "counts")
    totals = counts.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("tokens")).first()
    documents = training.count()
    top = counts.orderBy(F.desc("count"), "code").limit(FREQUENT).collect()
    codes, number = np.array([r["code"] for r in top], np.int64), np.array([r["count"] for r in top], np.int64)
    in_model = min(VOCABULARY - 2, len(top))
    numbers = np.full(len(top), OTHER, np.int32)
    numbers[:in_model] = np.arange(2, 2 + in_model)
    order = np.argsort(codes)
    other = totals["tokens"] - int(number[:in_model].sum())
    corpus = Corpus(
        codes[order], number[order], numbers[order], documents, totals["tokens"] + documents,
        totals["distinct"] + (documents > 0), other, totals["distinct"] - in_model,
    )
    model = LanguageModel(np.concatenate(([documents, other], number[:in_model])).astype(float), alone=2, start=END)
    return corpus, model, counts


def train(model: LanguageModel, numbered: DataFrame, corpus: Corpus) -> None:
    """Train the model on every numbered text that is learned from; only weights reach the driver."""
    if not corpus.documents:
        return
    shards = -(-corpus.tokens // SHARD_WORDS)
    turn = F.pmod("name", F.lit(TURNS))
    shard = F.pmod(F.shiftright("name", TURNS.bit_length()), F.lit(shards)).cast("int")
    slots = F.array(*[F.lit(slot) for slot in slots_of(numbered.sparkSession, shards)])
    learned = numbered.where("learned").select(shard.alias("shard"), "name", "n", turn.alias("turn"))
    for low, high in ROUNDS:
        own = learned.where((F.col("turn") >= low) & (F.col("turn") < high)).select("shard", "name", "n")
        # A task for each shard; where one gets several, it trains them one by one, in an order of their own.
        slotted = own.withColumn("slot", F.element_at(slots, F.col("shard") + 1)).repartition(shards, "slot")
        dealt = slotted.sortWithinPartitions("shard", "name").select("shard", "n")
        trained = dealt.mapInArrow(_trained(model, LAST_RATE if high == TURNS else RATE), "piece int, shard int, tokens bigint, weights binary")
        pieces = trained.repartition("piece").sortWithinPartitions("piece", "shard").mapInArrow(_averaged, "piece int, weights binary")
        found = {r["piece"]: np.frombuffer(r["weights"], np.float32) for r in pieces.collect()}
        if found:
            model.set_weights(np.concatenate([found[i] for i in range(PIECES)]))


def _trained(model: LanguageModel, last: float) -> Callable:
    """Each shard's weights, in pieces, after its own documents, and how many words these have."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, n) for batch in batches for s, n in zip(batch.column("shard").to_pylist(), batch.column("n")))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            own, texts, size, tokens = copy.deepcopy(model), [], 0, 0
            for _, value in group:
                texts.append(np.frombuffer(value.as_py(), np.uint16))
                size += len(texts[-1])
                if size >= WORDS_AT_ONCE:
                    own.train(texts, 1, RATE, last)
                    tokens, texts, size = tokens + size, [], 0
            if texts:
                own.train(texts, 1, RATE, last)
                tokens += size
            parts = [p.tobytes() for p in np.array_split(own.weights(), PIECES)]
            columns = [pa.array(c, t) for c, t in ((range(PIECES), pa.int32()), ([shard] * PIECES, pa.int32()), ([tokens] * PIECES, pa.int64()), (parts, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "shard", "tokens", "weights"])

    return train


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean weights of each piece, by words; rows come sorted by piece, and one sum is held at a time."""
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in ("piece", "tokens", "weights"))))
    for piece, own in groupby(rows, key=lambda r: r[0]):
        total, tokens = 0.0, 0
        for _, n, weights in own:
            total, tokens = total + n * np.frombuffer(weights, np.float32).astype(float), tokens + n
        mean = (total / tokens).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([mean], pa.binary())], names=["piece", "weights"])


_NUMBERED = (
    "k {key}, held_out boolean, learned boolean, name bigint, n_tokens bigint, n_known bigint, n_other bigint, frequent_sum double, "
    "other_sum double, codes array<bigint>, times array<bigint>, n binary"
)


def _numbers_of(corpus: Corpus) -> Callable:
    """What the counts tell of each text, and the numbers of its words, from batches of (k, held_out, learned, name, t)."""
    log_counts = np.log10(corpus.counts + 1.0)
    end_sum = float(np.log10(corpus.documents + 1.0))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A place of -1, of words that are not frequent, is the last one here.
        number_at, log_at = np.append(corpus.numbers, OTHER).astype(np.uint16), np.append(log_counts, 0.0)
        for batch in batches:
            lengths, codes, index = _split(batch.column("t"))
            rows, place = len(lengths), np.full(len(codes), -1)
            if len(corpus.codes):
                at = np.minimum(np.searchsorted(corpus.codes, codes), len(corpus.codes) - 1)
                place = np.where(corpus.codes[at] == codes, at, -1)
            owner = np.repeat(np.arange(rows), lengths)
            token, log, rare = number_at[place][index], log_at[place][index], (place < 0)[index]
            outside = token == OTHER

            def of_texts(some: np.ndarray | slice = slice(None), weights: np.ndarray | None = None) -> np.ndarray:
                return np.bincount(owner[some], weights=None if weights is None else weights[some], minlength=rows)

            n_rare = of_texts(rare)
            counted = [
                lengths + 1, lengths - n_rare + (corpus.documents > 0), of_texts(outside),
                of_texts(weights=log) + end_sum, of_texts(outside, log),
            ]
            # The words that are not frequent, each once for its text.
            pairs, times = np.unique(owner[rare] * max(len(codes), 1) + index[rare], return_counts=True)
            of_text, word = np.divmod(pairs, max(len(codes), 1))
            ends = np.searchsorted(of_text, np.arange(rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype(np.int64))) for c in (codes[word], times)]
            # The numbers of all texts, each with its end, as bytes.
            whole = np.full(len(index) + rows, END, np.uint16)
            whole[np.arange(len(index)) + owner] = token
            offsets = np.concatenate(([0], 2 * np.cumsum(lengths + 1))).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
            types = [pa.int64()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *[pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(counted, types)], *lists, texts],
                names=["k", "held_out", "learned", "name", "n_tokens", "n_known", "n_other", "frequent_sum", "other_sum", "codes", "times", "n"],
            )

    return numbers


def _scored(model: LanguageModel) -> Callable:
    """Rows with the model's score instead of the numbers of their words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, texts, size = [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            scores, at = model.score(texts), 0
            for batch in waiting:
                own = pa.array(scores[at : at + len(batch)], pa.float64())
                at += len(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], own], names=[*batch.schema.names[:-1], "model"])

        for batch in batches:
            # Pieces of a batch, so that no more words wait than are scored at once, and one text.
            start = 0
            for i, value in enumerate(batch.column("n")):
                texts.append(np.frombuffer(value.as_py(), np.uint16))
                size += len(texts[-1])
                if size >= SCORED_AT_ONCE or i == len(batch) - 1:
                    waiting.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                if size >= SCORED_AT_ONCE:
                    yield from done()
                    waiting, texts, size = [], [], 0
        if waiting:
            yield from done()

    return score


def learn(docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text") -> tuple[Corpus, LanguageModel, DataFrame, DataFrame]:
    """Corpus, trained model, the table of all counts, and all rows with the numbers of their words.

    The model learns from the rows where `learnable` holds.
    """
    learned = F.coalesce(learnable, F.lit(False))
    own = docs.select(
        F.col(key).alias("k"), F.coalesce(~learnable, F.lit(False)).alias("held_out"), learned.alias("learned"),
        F.xxhash64(key, text).alias("name"), F.col(text).alias("t"),
    )
    corpus, model, counts = count_corpus(own.where("learned").select("t"))
    kind = docs.schema[key].dataType.simpleString()
    numbered = own.mapInArrow(_numbers_of(corpus), _NUMBERED.format(key=kind)).withColumn("row", F.monotonically_increasing_id())
    # Written once, so that a row's number is the same whoever reads it.
    numbered = stored(numbered, "numbers")
    train(model, numbered, corpus)
    return corpus, model, counts, numbered


def score_documents(
    docs: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are lower-cased runs of non-space characters; each text ends with one end token; null texts are
    empty. base_score is the sum of log10((c + 1) / (N + V + 1)). score is the recurrent model's log10
    probability, after training on all rows learned from; a word outside its vocabulary has the probability of that symbol times (c + 1) / (N' +
    V' + 1), counted over such words. Rows where `learnable` is null (null keys) are not learned from and
    not held out. Repeated rows are repeated, other columns not read; an empty table stays empty, and with
    no training document all counts are zero. Words are named by 64-bit hashes.
    """
    corpus, model, counts, numbered = learn(docs, learnable, key, text)
    passed = numbered.select("row", "k", "held_out", "n_tokens", "n_known", "n_other", "frequent_sum", "other_sum", "codes", "times", "n")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in passed.schema.fields[:-1])
    scored = stored(passed.mapInArrow(_scored(model), f"{fields}, model double"), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("codes", "times")).alias("w")).select("row", "w.codes", "w.times")
    rare_counts = counts.withColumnRenamed("code", "codes")
    rare_sums = (
        rare.join(rare_counts, "codes", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 1)).alias("rare_sum"),
            F.sum(F.when(F.col("count") > 0, F.col("times"))).alias("rare_known"),
        )
    )
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    base = F.col("frequent_sum") + rare_sum - F.col("n_tokens") * float(np.log10(corpus.tokens + corpus.distinct + 1))
    other = F.col("other_sum") + rare_sum - F.col("n_other") * float(np.log10(corpus.other_tokens + corpus.other_distinct + 1))
    return scored.join(rare_sums, "row", "left").select(
        F.col("k").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + other).alias("score"),
    )
