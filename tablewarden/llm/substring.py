"""Substring deduplication by difference-cover anchors.

A window of 13 words is removed where the same words start a window of a document with a smaller id.
Hashes are taken only of the 7-word runs that start at places 0, 1 or 3 modulo 7: whatever the places of
two equal windows, there is a distance below 7 at which both have such a place, so they share an anchor
that lies inside them. Anchors that occur in one document are done with; around the others windows are
extended to their full length and compared as such.

Anchors and windows that a fixed-size sample of documents shows to be common are sent to all tasks as lists
of bounded length instead of being shuffled, so their rows pile up in no task; what the sample misses is
found like anything else, and no result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.llm.common import free_name, stored
from tablewarden.llm.hashing import WordHashes, hash_texts, mixed, run_hashes, run_sums, split_words

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)  # every difference modulo 7 is one between two of these
ANCHOR = WINDOW - PERIOD + 1
#: Anchors only choose what is compared, so they need fewer bits than windows; short ones travel cheaper.
ANCHOR_BITS = 48
#: Documents looked at for what is common, in how many of them it must be, and how many runs are listed.
SAMPLE, SAMPLE_HITS, MOST_COMMON = 2000, 4, 100_000


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (not negative) and places of a document's anchors."""
    codes = run_hashes(words, ANCHOR)
    places = np.flatnonzero(np.isin(np.arange(len(codes)) % PERIOD, COVER))
    return (codes[places] >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64), places


def windows(words: np.ndarray) -> np.ndarray:
    """Hashes (63 bits, not negative) of all windows, by their start."""
    return (run_hashes(words, WINDOW) >> np.uint64(1)).astype(np.int64)


def around(places: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of the windows that hold an anchor at one of these places."""
    starts = (places[:, None] - np.arange(WINDOW - ANCHOR + 1)[None, :]).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n_words - WINDOW)])


@dataclass
class Common:
    """What a sample shows to be in many documents: anchors, and windows with the smallest document of each."""

    anchors: np.ndarray
    windows: np.ndarray
    smallest: np.ndarray


def _sample_sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        words = [hash_texts([t])[0] for t in texts]
        yield pd.DataFrame({"anchors": [np.unique(anchors(w)[0]) for w in words], "windows": [np.unique(windows(w)) for w in words]})


@dataclass
class Stretch:
    """The words of some texts one after another: hashes, and of each word its text and its place there."""

    words: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    place: np.ndarray

    def starts(self, size: int) -> np.ndarray:
        """Where runs of `size` words of one text start."""
        return np.flatnonzero(self.place + size <= self.lengths[self.text])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of anchors, told apart by text in the bits above theirs, and where they start."""
        at = self.starts(ANCHOR)
        at = at[_COVERED[self.place[at] % PERIOD]]
        codes = mixed(run_sums(self.words, ANCHOR)[at]) >> np.uint64(64 - ANCHOR_BITS)
        return (self.text[at] << ANCHOR_BITS) | codes.astype(np.int64), at

    def windows(self, at: np.ndarray) -> np.ndarray:
        return (mixed(run_sums(self.words, WINDOW)[at]) >> np.uint64(1)).astype(np.int64)


_COVERED = np.isin(np.arange(PERIOD), COVER)
#: Texts and, beyond one text, characters that are hashed together; the texts' numbers stand above an anchor's bits.
TEXTS_AT_ONCE, CHARACTERS_AT_ONCE = 1000, 1_000_000


def _stretches(texts: Iterator[str]) -> Iterator[Stretch]:
    """All texts in their order, some at a time, as numpy costs more by the call than by the word."""

    def stretch(some: list[str]) -> Stretch:
        words, lengths = hash_texts(some)
        text = np.repeat(np.arange(len(some)), lengths)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return Stretch(words, lengths, text, place)

    some, characters = [], 0
    for text in texts:
        some.append(text)
        characters += len(text or "")
        if characters >= CHARACTERS_AT_ONCE or len(some) >= TEXTS_AT_ONCE:
            yield stretch(some)
            some, characters = [], 0
    if some:
        yield stretch(some)


def _found(codes: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes are in a sorted list, and where they would be there."""
    if not len(listed):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    held = np.minimum(np.searchsorted(listed, codes), len(listed) - 1)
    return listed[held] == codes, held


def _by_text(values: np.ndarray, text: np.ndarray, n_texts: int) -> list[np.ndarray]:
    return np.split(values, np.cumsum(np.bincount(text, minlength=n_texts))[:-1])


def _smallest_holders(batches: Iterator[pa.RecordBatch], codes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(code, doc): the smallest document of each common window, among those of a batch."""
    for batch in batches:
        smallest = np.full(len(codes), np.iinfo(np.int64).max)
        docs, done = batch.column(0).to_numpy(), 0
        for s in _stretches((text.as_py() for text in batch.column(1))):
            at = s.starts(WINDOW)
            there, held = _found(s.windows(at), codes)
            np.minimum.at(smallest, held[there], docs[done + s.text[at[there]]])
            done += len(s.lengths)
        there = smallest < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(codes[there]), pa.array(smallest[there])], names=["code", "doc"])


def _shuffled_anchors(batches: Iterator[pd.Series], common: Common) -> Iterator[pd.DataFrame]:
    """Each document's anchors without the common ones, and whether it has any of these."""
    for texts in batches:
        rest, has_common = [], []
        for s in _stretches(texts):
            named = np.unique(s.anchors()[0])
            text, codes = named >> ANCHOR_BITS, named & ((1 << ANCHOR_BITS) - 1)
            listed = _found(codes, common.anchors)[0]
            rest += _by_text(codes[~listed], text[~listed], len(s.lengths))
            has_common += (np.bincount(text[listed], minlength=len(s.lengths)) > 0).tolist()
        yield pd.DataFrame({"anchors": rest, "common": has_common})


def _windows(inputs: Iterator[tuple[pd.Series, pd.Series, pd.Series]], common: Common) -> Iterator[pd.DataFrame]:
    """Windows around shared anchors, each code once with its first start; -1 - start where the text has it again.

    Common windows are decided here: those that a smaller document has go into `sure`.
    """
    for docs, texts, shared in inputs:
        codes_of, starts_of, sure_of, done = [], [], [], 0
        for s in _stretches(texts):
            n_texts = len(s.lengths)
            ids, wanted = docs.to_numpy()[done : done + n_texts], [np.asarray(w, np.int64) for w in shared[done : done + n_texts]]
            done += n_texts
            of_text = np.repeat(np.arange(n_texts), [len(w) for w in wanted])
            wanted = np.concatenate(wanted)
            named, at = s.anchors()
            hit = _found(named, np.sort(((of_text << ANCHOR_BITS) | wanted)[wanted >= 0]))[0]
            hit |= _found(named & ((1 << ANCHOR_BITS) - 1), common.anchors)[0]
            start = around(at[hit], len(s.words))
            start = start[s.place[start] + WINDOW <= s.lengths[s.text[start]]]
            codes, text = s.windows(start), s.text[start]
            order = np.lexsort((codes, text))  # equal ones stay by their start
            codes, text, place = codes[order], text[order], s.place[start[order]]
            first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (text[1:] != text[:-1]))[: len(codes)])
            times = np.diff(np.append(first, len(codes)))
            codes, text, place = codes[first], text[first], place[first]
            place = np.where(times > 1, -1 - place, place).astype(np.int32)
            decided, held = _found(codes, common.windows)
            sure = decided.copy()
            if len(common.windows):
                sure &= common.smallest[held] < ids[text]
            codes_of += _by_text(codes[~decided], text[~decided], n_texts)
            starts_of += _by_text(place[~decided], text[~decided], n_texts)
            sure_of += _by_text(place[sure], text[sure], n_texts)
        yield pd.DataFrame({"code": codes_of, "start": starts_of, "sure": sure_of})


def _without(inputs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    known = WordHashes()
    for texts, starts, copies in inputs:
        rows = []
        for text, start, copy in zip(texts, starts, copies):
            words = split_words(text)
            covered = np.zeros(len(words) + 1, np.int64)
            if copy and len(words) >= WINDOW:
                covered[0] = 1
            elif start is not None and len(start):
                start = np.unique(start).astype(np.int64)
                if start[0] < 0:  # some windows stand for all their equals in the text
                    codes = windows(known.of(words))
                    start = np.union1d(start[start >= 0], np.flatnonzero(np.isin(codes, codes[-1 - start[start < 0]])))
                covered[start] += 1
                covered[start + WINDOW] -= 1
            removed = np.cumsum(covered[:-1]) > 0
            kept = [w for w, gone in zip(words, removed.tolist()) if not gone] if removed.any() else words
            rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])


def _later_copies(rows: DataFrame) -> DataFrame:
    """(doc, mark) of rows whose whole text stands in a document with a smaller id."""
    marked = rows.select("doc", "mark", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    first = marked.groupBy("digest").agg(F.min("doc").alias("first"))
    return marked.join(first, "digest").where("first < doc").select("doc", "mark").distinct()


def common_runs(rows: DataFrame) -> Common:
    """Anchors and windows of at least SAMPLE_HITS of about SAMPLE documents (chosen by their id's hash).

    The sample only decides what is not shuffled. The smallest documents of common windows come from all
    rows, put together in each task before anything is sent.
    """
    nth = max(1, rows.count() // SAMPLE)
    sets = F.pandas_udf(_sample_sets, "anchors array<bigint>, windows array<bigint>")
    sample = stored(rows.where(F.pmod(F.xxhash64("doc"), F.lit(nth)) == 0).select(sets("text").alias("s")).select("s.*"), "sample")

    def often(column: str) -> np.ndarray:
        counted = sample.select(F.explode(column).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
        top = counted.where(F.col("n") >= SAMPLE_HITS).orderBy(F.desc("n"), "code").limit(MOST_COMMON).collect()
        return np.sort(np.array([r["code"] for r in top], np.int64))

    codes = often("windows")
    if not len(codes):
        return Common(often("anchors"), codes, codes)

    def smallest_holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _smallest_holders(batches, codes)

    found = rows.select("doc", "text").mapInArrow(smallest_holders, "code bigint, doc bigint")
    smallest = {r["code"]: r["doc"] for r in found.groupBy("code").agg(F.min("doc").alias("doc")).collect()}
    return Common(often("anchors"), codes, np.array([smallest[c] for c in codes.tolist()], np.int64))


def _exploded(listed: Column, known: Column) -> Column:
    """Rows of a list, and one row more for what is known: its key is negative and the document's own."""
    own = F.when(known, F.array(_own_key())).otherwise(F.array().cast("array<bigint>"))
    return F.explode(F.concat(listed, own))


def _own_key() -> Column:
    return -1 - F.shiftrightunsigned(F.xxhash64("doc", "mark"), 1)


def repeated_windows(rows: DataFrame, common: Common) -> DataFrame:
    """(doc, mark, starts) of windows of `rows` (doc, mark, text) that a document with a smaller id has too.

    One shuffle by anchors tells which are shared, one by windows which document is the smallest. A key's
    rows are at most one per document, common keys are not shuffled, and no pair of documents is ever made.
    Keys below zero carry what needs no comparison.
    """

    def shuffled_anchors(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _shuffled_anchors(texts, common)

    def window_codes(inputs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return _windows(inputs, common)

    anchor_udf = F.pandas_udf(shuffled_anchors, "anchors array<bigint>, common boolean").asNondeterministic()
    window_udf = F.pandas_udf(window_codes, "code array<bigint>, start array<int>, sure array<int>").asNondeterministic()
    found = rows.select("doc", "mark", anchor_udf("text").alias("a")).select(
        "doc", "mark", _exploded(F.col("a.anchors"), F.col("a.common")).alias("anchor")
    )
    holders = found.withColumn("rows", F.count("*").over(Window.partitionBy("anchor")))
    wanted = holders.where("anchor < 0 OR rows > 1").groupBy("doc", "mark").agg(F.collect_list("anchor").alias("wanted"))
    w, sure = F.col("w"), F.col("w")["sure"]
    pairs = F.concat(
        F.arrays_zip(w["code"].alias("code"), w["start"].alias("start")),
        F.transform(sure, lambda s: F.struct(_own_key().alias("code"), s.alias("start"))),
    )
    compared = (
        rows.join(wanted, ["doc", "mark"])
        .select("doc", "mark", window_udf("doc", "text", "wanted").alias("w"))
        .select("doc", "mark", F.explode(pairs).alias("p"))
        .select("doc", "mark", "p.code", "p.start")
        .withColumn("first", F.min("doc").over(Window.partitionBy("code")))
    )
    return compared.where("code < 0 OR first < doc").groupBy("doc", "mark").agg(F.collect_list("start").alias("starts"))


def _judged(rows: DataFrame) -> DataFrame:
    """`rows` (doc, mark, text, neither null) with `result`. All joins take the texts from one and the same shuffle."""
    copies = _later_copies(rows)
    originals = rows.join(copies, ["doc", "mark"], "left_anti")
    nothing = F.array().cast("array<int>")
    changes = (
        repeated_windows(originals, common_runs(rows))
        .select("doc", "mark", "starts", F.lit(False).alias("copy"))
        .unionByName(copies.select("doc", "mark", nothing.alias("starts"), F.lit(True).alias("copy")))
    )
    without = F.pandas_udf(_without, "n_words bigint, n_removed bigint, kept_text string").asNondeterministic()
    return rows.join(changes, ["doc", "mark"], "left").select(
        "doc", "mark", "text", without("text", F.coalesce("starts", nothing), F.coalesce("copy", F.lit(False))).alias("result")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_words, n_removed and kept_text of every row.

    kept_text has the words that stay, joined by one space. Windows are judged on the input, not on what
    is left. The key is an integer. Null texts have no words and an empty kept_text. Rows with a null key
    neither lose words nor take any; rows with the same key are one document as far as "smaller" goes, and
    each is judged alone. Whole copies are settled by their digest and are not cut into windows. Other
    columns are not read; an empty table stays empty.
    """
    named = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    rows = named.where("doc IS NOT NULL AND text IS NOT NULL").select(F.col("doc").cast("long"), F.xxhash64("text").alias("mark"), "text")
    without = F.pandas_udf(_without, "n_words bigint, n_removed bigint, kept_text string").asNondeterministic()
    alone = named.where("doc IS NULL OR text IS NULL").select(
        F.col("doc").cast("long"), "text", without("text", F.array().cast("array<int>"), F.lit(False)).alias("result")
    )
    found = _judged(rows).select("doc", "text", "result").unionByName(alone)
    return found.select(F.col("doc").alias(key), F.col("text").alias(text), "result.n_words", "result.n_removed", "result.kept_text")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """`docs` without the repeated passages, the words left joined by one space; documents left with nothing go.

    Documents that lose no word stay as they are, to the byte, and so do rows with a null key or text.
    `length`, if there, is counted anew. Other columns meet the result by key and text hash; of rows that
    are equal in both, each keeps its own.
    """
    out = free_name(docs, "substring")
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")
    )
    n = F.col("result")
    lost = _judged(rows).where(n["n_removed"] > 0).groupBy("doc", "mark").agg(F.first(F.struct(n["n_words"], n["n_removed"], n["kept_text"])).alias(out))
    lost = lost.select(F.col("doc").alias(f"{out}_doc"), F.col("mark").alias(f"{out}_mark"), out)
    same = (F.col(key) == F.col(f"{out}_doc")) & (F.xxhash64(F.col(text)) == F.col(f"{out}_mark"))
    got = F.col(out)
    new_text = F.coalesce(got["kept_text"], F.col(text))
    new = {text: new_text} | ({length: F.length(new_text).cast("long")} if length in docs.columns else {})
    left = got.isNull() | (got["n_removed"] < got["n_words"])
    return docs.join(lost, same, "left").where(left).withColumns(new).select(*docs.columns)
