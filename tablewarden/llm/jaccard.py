"""N-gram Jaccard join: prefix trees over globally ordered shingle sets, one tree per block of candidates.

Documents with equal sets are one class. A class whose shingles are too often its own to be alike to
anything goes first. The sets of the others are ordered by how many classes hold a shingle; alike sets
share one of their first, rarest shingles (prefix filter). A block is the smallest class of such a shingle
with all classes that share any shingle of which it is the smallest, so alike classes meet in a block, a
class is in few of them, and no shingle's group is ever paired. Blocks too large for one task are cut
into parts that all hold that smallest class; only classes it does not connect go on to the other parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.llm.common import free_name, stored
from tablewarden.llm.components import connected_components
from tablewarden.llm.hashing import WordHashes, run_hashes, split_words
from tablewarden.llm.prefix_tree import Groups, PrefixTree

SHINGLE = 5
SHARE = (3, 4)  # least intersection over union
#: Shingles held by one task's tree, on average; larger blocks are cut.
ITEMS_PER_PART = 1_000_000
#: Bits of a shingle's hash that count how many classes hold it, and that follow its frequency in the global order.
COUNTED_BITS, ORDERED_BITS = 48, 56


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, rising; fewer words than a shingle are one, none none."""
    return np.unique(run_hashes(words, min(size, max(len(words), 1))))


def _sets(texts: pd.Series, known: WordHashes) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(known.of(split_words(text, lower=True)))


def _class(items: np.ndarray) -> int | None:
    """A 64-bit name of a set; None for the empty one."""
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True) if len(items) else None


def _named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The class, its size, and half of its shingles: a fixed half of all there are."""
    known = WordHashes()
    for texts in batches:
        sets = list(_sets(texts, known))
        half = [(s[s % np.uint64(2) == 0] >> np.uint64(64 - COUNTED_BITS)).astype(np.int64) for s in sets]
        yield pd.DataFrame({"class": pd.Series(map(_class, sets), dtype="Int64"), "size": [len(s) for s in sets], "half": half})


def _whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = WordHashes()
    for texts in batches:
        yield pd.Series([s.view(np.int64) for s in _sets(texts, known)], dtype=object)


def _least(size: Column) -> Column:
    """The smallest intersection with any other set that can make a set of this size alike to it."""
    return F.ceil(size * SHARE[0] / SHARE[1])


def _candidates(heads: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes of which, in a fixed half of all shingles, no more are their own than may be missing."""
    items = heads.select("class", F.explode("half").alias("item"))
    owners = items.groupBy("item").agg(F.min("class").alias("class"), F.max("class").alias("last"))
    own = owners.where("class = last").groupBy("class").agg(F.count("*").alias("own"))
    return (
        classes.join(own, "class", "left")
        .where(F.coalesce("own", F.lit(0)) <= F.col("size") - _least(F.col("size")))
        .select("class", "size", "doc", "mark")
    )


def _ordered_sets(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(class, size, items): the shingles that other candidates hold too, in global order."""
    whole = F.pandas_udf(_whole, "array<bigint>")
    # A repeated row counts its shingles twice, which only lets more of them pass.
    # Candidates have no bound, so they are merged with the texts, never sent to all tasks.
    items = rows.join(chosen.hint("merge"), ["doc", "mark"]).select("class", "size", F.explode(whole("text")).alias("item"))
    held = items.groupBy("item").agg(F.count("*").alias("held")).where("held > 1")
    # Twice as many holders put a shingle one step later; among equals the hash decides.
    step = F.floor(F.log2("held")).cast("long")
    place = F.shiftleft(step, ORDERED_BITS).bitwiseOR(F.shiftrightunsigned("item", 64 - ORDERED_BITS))
    sets = items.join(held.hint("merge"), "item").groupBy("class", "size").agg(F.array_sort(F.collect_set(place)).alias("items"))
    return sets.where(F.size("items") >= _least(F.col("size")))


def _members(sets: DataFrame) -> DataFrame:
    """(block, class): the classes of each block, blocks of one left out."""
    # Of a set's items, so many from the front must hold one that an alike set has in front too.
    front = F.slice("items", 1, (F.size("items") - _least(F.col("size")) + 1).cast("int"))
    fronts = sets.select("class", F.explode(front).alias("item"))
    blocks = fronts.groupBy("item").agg(F.min("class").alias("block"), F.max("class").alias("last")).where("block < last")
    return fronts.join(blocks, "item").select("block", "class").distinct()


_FOUND = "block bigint, part bigint, parts bigint, a bigint, b bigint"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, rows) of rows that come sorted by (block, part), across the borders of batches."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            names = ("block", "part", "parts", "probe", "class", "size")
            lists = batch.column("items")
            items = [lists[i].values.to_numpy() for i in range(len(batch))]
            yield from zip(*[batch.column(n).to_pylist() for n in names], items)

    return groupby(rows(), key=lambda r: r[:3])


def _result(found: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*found)) or [()] * len(names)], names=names)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the classes of each part; of a cut block also, with b null, the classes its smallest one does not connect."""
    for (block, part, parts), rows in _grouped(batches):
        _, _, _, _, classes, sizes, items = zip(*rows)
        found = []
        if len(classes) > 1:
            tree, groups = PrefixTree(list(items), list(sizes), SHARE), Groups(len(classes))
            for a, b in tree.spanning_links():
                groups.unite(a, b)
                found.append((block, part, parts, classes[a], classes[b]))
            if parts > 1:
                home = groups.find(classes.index(block))
                found += [(block, part, parts, c, None) for i, c in enumerate(classes) if groups.find(i) != home]
        if found:
            yield _result(found)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of probes with the classes of a part; the probes follow the classes."""
    for (block, part, parts), rows in _grouped(batches):
        tree, classes, sizes, items = None, [], [], []
        for _, _, _, probe, name, size, own in rows:
            if not probe:
                classes.append(name)
                sizes.append(size)
                items.append(own)
                continue
            tree = tree or PrefixTree(items, sizes, SHARE)
            found = [(block, part, parts, name, classes[tree.order[i]]) for i in tree.alike(tree.numbered(own), size)]
            if found:
                yield _result(found)


def _links(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links enough to connect whatever links connect."""
    weight = members.join(sets.select("class", F.size("items").alias("n")), "class").groupBy("block").agg(F.sum("n").alias("n"))
    parts = weight.select("block", F.ceil(F.col("n") / ITEMS_PER_PART).alias("parts"))
    own_part = F.pmod(F.xxhash64("class"), F.col("parts"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    placed = stored(
        members.join(parts, "block").select(
            "block", "parts", "class", F.explode(F.when(F.col("class") == F.col("block"), everywhere).otherwise(F.array(own_part))).alias("part")
        ),
        "parts",
    )
    columns = ["block", "part", "parts", "probe", "class", "size", "items"]
    inside = placed.join(sets, "class").withColumn("probe", F.lit(False)).select(columns)
    found = stored(inside.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_inside, _FOUND), "inside")
    links, strays = found.where("b IS NOT NULL").select("a", "b"), found.where("b IS NULL")
    if strays.isEmpty():
        return links
    probes = (
        strays.select("block", "parts", F.col("a").alias("class"), F.explode(F.filter(everywhere, lambda p: p != F.col("part"))).alias("part"))
        .join(sets, "class")
        .withColumn("probe", F.lit(True))
        .select(columns)
    )
    # Parts without probes have nothing to do.
    stored_side = inside.join(probes.select("block", "part").distinct(), ["block", "part"], "left_semi")
    across = (
        stored_side.unionByName(probes)
        .repartition("block", "part")
        .sortWithinPartitions("block", "part", "probe")
        .mapInArrow(_across, _FOUND)
    )
    return links.unionByName(across.select("a", "b"))


def _linked_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, doc, mark (of the text), size, class, smallest and first of every row.

    smallest is the least key of the row's component, first the least (doc, mark) among its rows with a key.
    """
    named = F.pandas_udf(_named, "class bigint, size bigint, half array<bigint>").asNondeterministic()
    rows = docs.select(F.col(key), F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))
    heads = stored(rows.select(key, "doc", "mark", named("text").alias("c")).select(key, "doc", "mark", "c.class", "c.size", "c.half"), "classes")
    # A class's first row stands for it; a null key comes last.
    order = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("mark").alias("mark"))
    classes = (
        heads.where("class IS NOT NULL")
        .groupBy("class", "size")
        .agg(F.min(order).alias("first"))
        .select("class", "size", F.coalesce("first.doc", F.lit(-(1 << 63))).alias("doc"), "first.mark")
    )
    rows = rows.where("text IS NOT NULL").select(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "mark", "text")
    chosen = stored(_candidates(heads, classes), "candidates")
    # The sampled shingles have done their part; what is left of the heads is small.
    whole, heads = heads, stored(heads.drop("half"), "heads")
    session.discard(docs.sparkSession, whole)
    sets = stored(_ordered_sets(rows, chosen), "sets")
    members = stored(_members(sets), "members")
    links = _links(sets, members)
    component = connected_components(links, "a", "b")
    row = F.when(F.col("doc").isNotNull(), F.struct("doc", "mark"))
    smallest_of_class = heads.where("class IS NOT NULL").groupBy("class").agg(F.min(row).alias("first"))
    labelled = smallest_of_class.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    smallest = labelled.groupBy("component").agg(F.min("first").alias("first"))
    of_class = labelled.select("class", "component").join(smallest, "component").select("class", "first")
    return heads.join(of_class, "class", "left").select(key, "doc", "mark", "size", "class", F.col("first.doc").alias("smallest"), "first")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id and class_id of every row.

    component_id is the smallest key that links lead to, class_id names the shingle set (null for an empty
    one). Null and empty texts have no shingles and link with nothing. Rows with equal sets are linked,
    also rows with the same key; a row with a null key links others but is no smallest key, and has a null
    component if it is alone. Keys are integers; repeated rows are repeated; other columns are not read.
    Sets are named by 64-bit hashes.
    """
    return _linked_rows(docs, key, text).select(
        key, F.col("size").alias("n_shingles"), F.coalesce("smallest", "doc").alias("component_id"), F.col("class").alias("class_id")
    )


def keep_smallest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked ones: the one with the smallest key. Rows with a null key stay.

    Rows are judged one by one, so an id may be repeated: its rows go or stay by their own texts. Of a
    group's rows with the smallest key, the text with the smallest 64-bit hash stays, and of rows that have
    both in common any one. Rows without shingles (null and empty texts) stay.
    """
    rows = _linked_rows(docs, key, text).where(F.col("class").isNotNull() & F.col("doc").isNotNull())
    kept = (F.col("doc") == F.col("first.doc")) & (F.col("mark") == F.col("first.mark"))
    found = rows.groupBy("doc", "mark").agg(F.first(kept).alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    found = stored(found.select("doc", "mark", "kept"), "found")
    names = [free_name(docs, n) for n in ("doc", "mark")]
    marked = docs.withColumns({names[0]: F.col(key).cast("long"), names[1]: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    found = found.toDF(*names, "kept")
    stay = marked.join(found, names, "left_anti")
    repeated = found.where("kept").drop("kept")
    if not repeated.isEmpty():
        stay = stay.unionByName(marked.join(repeated, names, "left_semi").dropDuplicates(names))
    return stay.select(*docs.columns)
