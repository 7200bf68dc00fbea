"""Best-fit packing of tokenised documents into sequences under several capacities at once.

Pieces are whole numbers of tokens up to the capacity, so all that packing must know is how many pieces
there are of each length: a table bounded by the capacity, whatever the number of documents. The bins are
planned from these counts, longest first; each step puts as many equal pieces as fit into as many equal
bins as there are. Spark then numbers the pieces of each length and looks up their places in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewarden.llm.common import stored

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that one task numbers, on average.
ROWS_PER_BUCKET = 1000
# Fixed value: how a byte-level tokenizer of this kind splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A run of one kind this long is left to the tokenizer whose merging does not slow down with the run.
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class Encoder:
    """Token ids of texts by a byte-level tokenizer whose JSON is given.

    The vocabulary is read once for two libraries that give the same ids: the ranks of the faster one are
    the ids themselves, as merges are numbered in order. Added tokens in a text are recognised.
    """

    def __init__(self, tokenizer_json: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        data = json.loads(tokenizer_json)
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = {t: i for t, i in data["model"]["vocab"].items() if t not in added}
        merges = [m if isinstance(m, str) else " ".join(m) for m in data["model"]["merges"]]
        alphabet = len(ByteLevel.alphabet())
        if data["normalizer"] or data["pre_tokenizer"].get("add_prefix_space") or any(
            vocab[m.replace(" ", "")] != alphabet + n for n, m in enumerate(merges)
        ):
            raise ValueError("a byte-level tokenizer without normaliser and with merges numbered in order is needed")
        # The byte of each letter of the file's alphabet: printable bytes stand for themselves, the others follow from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        self.fast = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        self.steady = Tokenizer.from_str(tokenizer_json)

    def encode(self, text: str) -> np.ndarray:
        if _LONG_RUN.search(text):
            return np.asarray(self.steady.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    first = n_ids % capacity or capacity
    return [(0, first)] + [(start, capacity) for start in range(first, n_ids, capacity)]


def tokenised_pieces(
    docs: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc key, piece, start, length and ids_crc32 of every piece; a null or empty text is its end id alone."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(tokenizer_json), np.asarray([end_id], "<u4")
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.concatenate((encoder.encode(value.as_py() or ""), end))
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(ids[start : start + length].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(pieces, schema)


@dataclass
class Bins:
    """Equal bins: what each has left, and their sequence numbers."""

    left: tuple[int, int, int]  # tokens, documents, attention cost
    first: int
    count: int


@dataclass
class Allocation:
    """Pieces of a length with these numbers go, `each` by `each`, to the sequences from `first` on."""

    length: int
    number: int
    first: int
    each: int
    offset: int


def plan(
    counts: Mapping[int, int], capacity: int = CAPACITY, max_documents: int | None = None, max_cost: int | None = None,
    select: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
) -> list[Allocation]:
    """Vector best-fit over pieces counted by length, longest first.

    A bin has three capacities: tokens, documents, and attention cost (sum of squared lengths). A piece
    goes to the open bin that fits under all three and, after it, has the smallest weighted norm of what
    is left (`select="norm"`), or whose left-over has the largest weighted dot product with the piece
    (`"dot"`); a new bin is opened only where none fits. A capacity that is None does not bind.
    """
    caps = (capacity, max_documents or capacity, max_cost or capacity * capacity)
    scale = np.array(weights) / np.square(np.array(caps, float))
    open_bins: list[Bins] = []
    left = np.empty((0, 3), np.int64)
    placed, next_sequence = [], 0
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {caps}")
        number, rest = 0, counts[length]
        while rest:
            fits = np.flatnonzero((left >= item).all(axis=1))
            if not len(fits):
                each = int((np.array(caps) // item).min())
                open_bins.append(Bins(caps, next_sequence, -(-rest // each)))
                next_sequence += open_bins[-1].count
                left = np.vstack([left, caps])
                continue
            after = left[fits] - item
            if select == "norm":
                best = int(fits[np.argmin((np.square(after.astype(float)) * scale).sum(axis=1))])
            else:
                best = int(fits[np.argmax((left[fits].astype(float) * item * scale).sum(axis=1))])
            bins = open_bins[best]
            each = int((left[best] // item).min())
            if rest < each:
                each, taken = rest, 1
            else:
                taken = min(bins.count, rest // each)
            placed.append(Allocation(length, number, bins.first, each, capacity - bins.left[0]))
            number, rest = number + taken * each, rest - taken * each
            filled = Bins(tuple(int(x) for x in left[best] - item * each), bins.first, taken)
            if taken == bins.count:
                open_bins[best] = filled
                left[best] = filled.left
            else:
                bins.first, bins.count = bins.first + taken, bins.count - taken
                open_bins.append(filled)
                left = np.vstack([left, filled.left])
    return placed


def _numbered(pieces: DataFrame, key: str, counts: Mapping[int, int]) -> DataFrame:
    """`pieces` with `number`, from 0 within each length. Each length has buckets by its count, so a common one meets no single task."""
    spark = pieces.sparkSession
    # One row for each length: bounded by the capacity.
    share = spark.createDataFrame([(n, -(-c // ROWS_PER_BUCKET)) for n, c in counts.items()] or [(0, 1)], "length long, buckets long")
    dealt = pieces.join(F.broadcast(share), "length").withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.col("buckets")))
    rows = dealt.groupBy("length", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("length", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy(key, "piece", "ids_crc32")
    return (
        dealt.withColumn("inside", F.row_number().over(inside) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("number", F.col("before") + F.col("inside"))
        .drop("bucket", "buckets", "inside", "before")
    )


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, **limits) -> DataFrame:
    """`pieces` (from `tokenised_pieces`) with sequence_id and offset; an empty table stays empty.

    Null and repeated keys are pieces like others; of rows that are equal in all columns it does not
    matter which goes where.
    """
    kept = stored(pieces, "pieces")
    counts = {r["length"]: r["rows"] for r in kept.groupBy("length").agg(F.count("*").alias("rows")).collect()}
    placed = plan(counts, capacity, **limits)
    # One row for each length and group of equal bins: bounded by the capacity, not by the documents.
    shift = 1 << 48
    keys = np.array([a.length * shift + a.number for a in placed], np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    table = np.array([(a.number, a.first, a.each, a.offset, a.length) for a in placed], np.int64).reshape(-1, 5)[order]
    schema = StructType([*kept.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            number_from, first, each, offset, size = table[np.searchsorted(keys, length * shift + number, "right") - 1].T
            inside = number - number_from
            columns = [batch.column(n) for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first + inside // each), pa.array(offset + inside % each * size)], names=schema.names
            )

    return _numbered(kept, key, counts).select(*kept.columns, "number").mapInArrow(place, schema)
