"""Document fingerprints from closed syncmers.

A k-mer of characters is chosen if the smallest of its inner s-mers (by hash) is the first or the last
one. That depends on the k-mer alone, so an edit changes the choice only where it touches the k-mer. Two
documents are alike by the anchors they share, of all they have, as far as these lie at one common shift. What is
written of a fingerprint are the anchors with hashes below a fixed bound, each with its place, so it grows with
the text; of texts with few such anchors it has the smallest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.common import slots_of

K = 12
S = 4
#: Anchors below this hash are written, and so many at least.
BOUND, LEAST = 1 << 60, 48
TOLERANCE = 16  # characters by which places may differ from the common shift

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_LOWEST = -(1 << 63)


def _mixed(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(32))) * _B
    return code ^ (code >> np.uint64(29))


def closed_syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the chosen k-mers. A text shorter than k is one anchor; an empty one has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < K:
        if not len(points):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        whole = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.frombuffer(whole, "<u8"), np.zeros(1, np.int64)
    inner = points[: len(points) - S + 1].copy()
    for j in range(1, S):
        inner = inner * _A + points[j : len(points) - S + 1 + j]
    inner = _mixed(inner)
    width = K - S + 1
    # The smallest of each run of `width`: two runs of half the length, doubled, that overlap.
    smallest, reach = inner, 1
    while 2 * reach <= width:
        smallest, reach = np.minimum(smallest[:-reach], smallest[reach:]), 2 * reach
    count = len(inner) - width + 1
    smallest = np.minimum(smallest[:count], smallest[width - reach : width - reach + count])
    places = np.flatnonzero((smallest == inner[:count]) | (smallest == inner[width - 1 : width - 1 + count]))
    code = np.zeros(len(places), np.uint64)
    for j in [*range(0, K - S, S), K - S]:  # s-mers that cover the k-mer
        code = code * _A + inner[places + j]
    return _mixed(code), places


Anchors = tuple[np.ndarray, np.ndarray]


def sketch(text: str) -> Anchors:
    """All anchors of a text in rising order of their hashes, each at its first place."""
    hashes, places = closed_syncmers(text)
    hashes, first = np.unique(hashes, return_index=True)
    return hashes, places[first]


def written(found: Anchors) -> str:
    """The anchors below the bound, or the smallest ones, as `hash@place`."""
    kept = max(int(np.searchsorted(found[0], np.uint64(BOUND))), LEAST)
    return " ".join([f"{h:016x}@{p}" for h, p in zip(found[0][:kept].tolist(), found[1][:kept].tolist())])


def read(fingerprint: str) -> Anchors:
    pairs = [a.split("@") for a in fingerprint.split()]
    return np.array([int(h, 16) for h, _ in pairs], np.uint64), np.array([int(p) for _, p in pairs], np.int64)


def likeness(a: Anchors, b: Anchors) -> float:
    """Dice's coefficient of two anchor sets, of the shared ones those at one common shift; 1 for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    small, large = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    at = np.searchsorted(large[0], small[0])
    at[at == len(large[0])] = 0
    both = large[0][at] == small[0]
    if not both.any():
        return 0.0
    shift = small[1][both] - large[1][at[both]]
    close = np.abs(shift - np.sort(shift)[len(shift) // 2]) <= TOLERANCE
    return float(2 * close.sum() / (len(a[0]) + len(b[0])))


def _comparable(a: Anchors, b: Anchors) -> tuple[Anchors, Anchors]:
    """Of two written fingerprints the anchors up to the hash where both are still complete."""
    ends = [min(int(x[0][-1]), BOUND - 1) if len(x[0]) == LEAST else BOUND - 1 for x in (a, b) if len(x[0]) >= LEAST]
    if not ends:
        return a, b
    cut = [int(np.searchsorted(x[0], np.uint64(min(ends)), "right")) for x in (a, b)]
    return (a[0][: cut[0]], a[1][: cut[0]]), (b[0][: cut[1]], b[1][: cut[1]])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as a string; empty for null and empty texts."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: written(sketch(t or "")))

    return of(text)


def similarity(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint strings, 0 to 1, by the anchors that are written; a null one counts as empty."""

    @F.pandas_udf("double")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([likeness(*_comparable(read(x or ""), read(y or ""))) for x, y in zip(left, right)], dtype=float)

    return alike(a, b)


def _beside_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in partitions by ranges of falling keys, each range closed by a row (`tail`) with the text that follows it.

    The ranges come from quantiles of the keys, and of the texts' first bytes where one key (or none) has
    more rows than a range should; so a row's range never depends on a sample taken while the job
    runs. Only the texts at the ranges' borders travel twice. Columns: range, tail, place, start, key, text.
    """
    spark = docs.sparkSession
    own_text = F.coalesce(F.col(text), F.lit(""))
    # The first seven bytes as a number, which rises as texts do.
    start = F.conv(F.rpad(F.hex(F.substring(own_text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = docs.select(
        F.col(key), own_text.alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("place"), start.alias("start")
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = rows.agg(F.percentile_approx("place", shares, 10 * ranges).alias("cuts"), F.count("*").alias("n")).first()
    cut_places = sorted(set(cuts["cuts"] or []))
    # A place that several quantiles fall on is cut again, by the texts' starts.
    repeated = [p for p in cut_places if cuts["cuts"].count(p) > 1]
    inner = {}
    if repeated:
        hot = spark.createDataFrame([(p,) for p in repeated], "place long")
        found = rows.select("place", "start").join(F.broadcast(hot), "place").groupBy("place")
        inner = dict(found.agg(F.percentile_approx("start", shares, 10 * ranges)).collect())
    borders = []  # (place, start): rows up to there, by rising keys, belong before the border
    for p in cut_places:
        if p in inner:
            step = max(1, -(-ranges // cuts["cuts"].count(p)))
            # What comes before the place is a range of its own, and so are the parts of the place.
            borders += [(p - 1, np.iinfo(np.int64).max)] if p > _LOWEST else []
            borders += [(p, s) for s in sorted(set(inner[p][step - 1 :: step]))]
        borders.append((p, np.iinfo(np.int64).max))
    borders = sorted(set(borders))
    border_place, border_start = (np.array([b[i] for b in borders], np.int64) for i in (0, 1))
    slots = slots_of(spark, ranges)

    @F.pandas_udf("long")
    def range_of(places: pd.Series, starts: pd.Series) -> pd.Series:
        place, start = places.to_numpy(), starts.to_numpy()
        low, high = np.searchsorted(border_place, place, "left"), np.searchsorted(border_place, place, "right")
        found = low.copy()
        for first in np.unique(low[high - low > 1]):  # a place that is cut again
            own = low == first
            found[own] += np.searchsorted(border_start[first : high[own][0]], start[own])
        return pd.Series(found, dtype="int64")

    ranged = rows.withColumn("range", range_of("place", "start"))
    # One row for each range: its first place, in falling order, with the text that comes first there.
    first = ranged.groupBy("range").agg(F.max(F.struct("place", "start")).alias("head")).select("range", "head.*").collect()
    heads = sorted((tuple(r) for r in first), key=lambda r: r[0])
    goes_to = [(place, begin, own, heads[(i + 1) % len(heads)][0]) for i, (own, place, begin) in enumerate(heads)]
    goes = F.broadcast(spark.createDataFrame(goes_to, "place long, start long, own long, range long"))
    head_rows = (
        rows.select("place", "start", "text").join(goes, ["place", "start"]).groupBy("range", "place", "start").agg(F.max("text").alias("text"))
    )
    nothing = F.lit(None).cast(docs.schema[key].dataType).alias(key)
    tails = head_rows.select("range", F.lit(True).alias("tail"), "place", "start", nothing, "text")
    own = ranged.select("range", F.lit(False).alias("tail"), "place", "start", key, "text")
    slot = F.element_at(F.array(*[F.lit(s) for s in slots]), (F.pmod("range", F.lit(ranges)) + 1).cast("int"))
    dealt = own.unionByName(tails).withColumn("slot", slot).repartition(ranges, "slot").drop("slot")
    return dealt.sortWithinPartitions("range", "tail", F.desc("place"), F.desc("text"))


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last third is the start of the next document.

    The next document has the next smaller key; the last one's is the first (one document: itself). Rows
    with the same key follow each other by falling text, null keys come last, null texts are empty. Keys
    are whole numbers; any other type is refused. Likeness counts all anchors of both texts.
    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. An
    empty table gives an empty one; other columns are not read.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} is not a whole number")
    schema = (
        f"{key} {docs.schema[key].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def judged(row: tuple, text: str, own: tuple, following: str, next_own: tuple) -> tuple:
        replaced = len(text) // 3
        edited = text[: len(text) - replaced] + following[:replaced]
        changed = sketch(edited)
        digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
        return (row, len(text), digest, written(own), written(changed), likeness(own, changed), likeness(own, next_own))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row before, of the same range
        for batch in batches:
            done = []
            for place, tail, own_key, own_text in zip(*[batch.column(n).to_pylist() for n in ("range", "tail", key, "text")]):
                if tail and (waiting is None or waiting[0] != place):
                    continue  # an earlier tail row of the range has served
                found = sketch(own_text)
                if waiting is not None and waiting[0] == place:
                    done.append(judged(*waiting[1:], own_text, found))
                waiting = None if tail else (place, own_key, own_text, found)
            columns = list(zip(*done)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [batch.schema.field(key).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])],
                names=names,
            )

    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return _beside_next(docs, key, text).mapInArrow(compare, schema)
