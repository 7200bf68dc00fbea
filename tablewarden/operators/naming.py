"""Unique keys from names, and the choice of one dated artifact per key."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.functions import names
from tablewarden.operators import ordered


def unique_keys(
    df: DataFrame, name: str, order: str, width: int = ordered.ROWS_PER_STRETCH
) -> DataFrame:
    """Add ``key``: the name's slug, then ``slug-2``, ``slug-3`` … in the order given.

    The result is the one of taking names in turn and giving each the first free key. Only two
    slugs can compete for a key ``s-k``: ``s`` for its k-th place, and the literal slug ``s-k`` for
    its first. So each literal child's first arrival is compared with how far its parent had come;
    everything else is a row number. ``order`` is a unique long column.
    """
    slugged = df.withColumn("slug", names.slug(F.col(name)))
    counted = ordered.numbered(slugged, ["slug"], [order], "_nth", F.col(order), width)
    child = r"\A(.*)-([2-9]|[1-9][0-9]+)\z"
    arrivals = counted.groupBy("slug").agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # Slugs that look like another slug's numbered key, where that other slug exists.
    pairs = (
        arrivals.where(F.col("slug").rlike(child))
        .select(
            F.regexp_extract("slug", child, 1).alias("parent"),
            F.regexp_extract("slug", child, 2).try_cast("long").alias("place"),
            F.col("slug").alias("child"),
            "_first",
        )
        .where(F.col("place").isNotNull())
        .join(arrivals.select(F.col("slug").alias("parent")), "parent", "left_semi")
    )
    pairs = session.materialised(_arrived_before(counted, pairs, order, width), "pairs")
    if pairs.isEmpty():
        return _with_key(counted.withColumn("_place", F.col("_nth")))
    skips = _skipped_places(pairs)
    return _with_key(_past_skips(counted, skips, width))


def _arrived_before(counted: DataFrame, pairs: DataFrame, order: str, width: int) -> DataFrame:
    """Pairs with ``come``: how many of the parent's rows came before the child's first.

    A child's first arrival is numbered among its parent's rows; what is not another child is a row.
    """
    marks = pairs.select(F.col("parent").alias("slug"), F.col("_first").alias("_at"), "child", "place")
    rows = counted.join(pairs.select(F.col("parent").alias("slug")).distinct(), "slug", "left_semi")
    entries = rows.select("slug", F.col(order).alias("_at")).unionByName(marks, allowMissingColumns=True)
    among_all = ordered.numbered(entries, ["slug"], ["_at"], "_all", F.col("_at"), width).where("child IS NOT NULL")
    among_marks = ordered.numbered(marks, ["slug"], ["_at"], "_marks", F.col("_at"), width).select("child", "_marks")
    return among_all.join(among_marks, "child").select(
        F.col("slug").alias("parent"), "child", "place", (F.col("_all") - F.col("_marks")).alias("come")
    )


_SKIPS = "slug string, place long, index long"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs by family, depth, parent and place: a parent skips a place that a literal child had before the parent got there.

    Parents come before their children, so whether a parent lost its own first place is known when its pairs
    come. Kept are the number of places the parent has skipped, and the family's names that lost theirs.
    """
    family, parent, skipped, losers = None, None, 0, set()
    for batch in batches:
        out = []
        for root, slug, child, place, come in zip(*[batch.column(n).to_pylist() for n in ("root", "parent", "child", "place", "come")]):
            if root != family:
                family, losers = root, set()
            if slug != parent:
                parent, skipped = slug, int(slug in losers)
            if come < place - skipped:
                out.append((slug, place, skipped))
                skipped += 1
            else:  # the parent had come to that place before
                losers.add(child)
                out.append((child, 1, 0))
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], names=["slug", "place", "index"]
        )


def _skipped_places(pairs: DataFrame) -> DataFrame:
    """(slug, place, index): the places each slug skips, numbered from 0.

    A family are the names that differ only in the numbers they end with; one pass over its pairs, however
    many numbers follow each other at a name's end (``a-2-2-2``), tells them all.
    """
    root = F.regexp_replace("parent", r"(-([2-9]|[1-9][0-9]+))+\z", "")
    depth = F.size(F.split(F.substr("parent", F.length("root") + 1), "-"))
    families = pairs.withColumn("root", root).withColumn("depth", depth)
    placed = families.repartition("root").sortWithinPartitions("root", "depth", "parent", "place")
    return placed.select("root", "parent", "child", "place", "come").mapInArrow(_follow, _SKIPS)


def _past_skips(counted: DataFrame, skips: DataFrame, width: int) -> DataFrame:
    """The n-th row takes the n-th place that is not skipped.

    The j-th skip moves a row on if its place is at most n + j, so ordered by place - j the skips
    before a row are counted by numbering rows and skips together.
    """
    rows = counted.select("*", F.col("_nth").alias("_value"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_j"))
    marks = skips.select("slug", (F.col("place") - F.col("index")).alias("_value"), F.lit(0).alias("_kind"), F.col("index").alias("_j"))
    together = rows.unionByName(marks, allowMissingColumns=True)
    # Rows and skips of one value stand together: skips first.
    position = F.col("_value") * 2 + F.col("_kind")
    numbered = ordered.numbered(together, ["slug"], ["_value", "_kind", "_j"], "_place", position, width)
    return numbered.where("_kind = 1").drop("_value", "_kind", "_j")


def _with_key(placed: DataFrame) -> DataFrame:
    key = F.when(F.col("_place") == 1, F.col("slug")).otherwise(
        F.concat_ws("-", "slug", F.col("_place").cast("string"))
    )
    return placed.withColumn("key", key).drop("_nth", "_place")


# Keys or names of one task; it bounds what a task sorts, whatever number of partitions a session sets.
ROWS_PER_TASK = 50_000


def _sizes(keys: DataFrame, listing: DataFrame) -> tuple[int, list[int]]:
    """How many tasks keys and names are dealt to, and the numbers of dashed parts that keys have (few: keys are short)."""
    told = keys.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("id", "-"))).alias("parts")).first()
    return -(-max(told.n, listing.count()) // ROWS_PER_TASK), sorted(n for n in told.parts if n > 0)


def _dealt(df: DataFrame, tasks: int, column: str) -> DataFrame:
    """Rows of one value together, in so many tasks; one task's rows are left to Spark."""
    return df.repartition(tasks, column) if tasks > 1 else df


def _candidates(keys: DataFrame, listing: DataFrame, tasks: int, parts: list[int]) -> DataFrame:
    dashed = F.split("name", "-")
    lengths = F.array(*[F.lit(n) for n in parts]).cast("array<int>")
    prefixes = F.transform(
        F.filter(lengths, lambda n: n < F.size(dashed)),
        lambda n: F.array_join(F.slice(dashed, F.lit(1), n), "-"),
    )
    names_once = _dealt(listing.where(F.contains(F.col("name"), F.lit("-"))).select("name"), tasks, "name").distinct()
    return _dealt(names_once.select(F.explode(prefixes).alias("id"), "name"), tasks, "id").join(
        _dealt(keys.select("id"), tasks, "id").distinct(), "id", "left_semi"
    )


def artifact_candidates(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, name): every artifact named ``id-…`` of every key, one row each.

    Every artifact name is matched by equality with its own prefixes before a dash, so no key is
    compared with names that do not begin with it; prefixes of more or fewer parts than any key has are left out.
    """
    return _candidates(keys, listing, *_sizes(keys, listing))


def pick_artifacts(keys: DataFrame, listing: DataFrame) -> DataFrame:
    """Per key (column ``id``) the number of its candidates, and its artifact where there is just one.

    The candidates themselves are the rows of :func:`artifact_candidates`; whoever prints them decides
    how many to show.
    """
    tasks, parts = _sizes(keys, listing)
    counted = _candidates(keys, listing, tasks, parts).groupBy("id").agg(
        F.count(F.lit(1)).alias("matches"), F.min("name").alias("path")
    )
    matches = F.coalesce("matches", F.lit(0)).cast("long")
    return (
        _dealt(keys.select("id"), tasks, "id")
        .join(counted, "id", "left")
        .select("id", matches.alias("matches"), F.when(matches == 1, F.col("path")).alias("path"))
    )


# Python workers get this code with the job; nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
