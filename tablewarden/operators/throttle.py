"""Thinning of progress events: at most one per interval since the last event kept.

The choice is greedy, so each depends on the one before; no window function can say that. Runs are taken
in stretches. A stretch is a step function from the last time kept before it to the last time kept within
it; step functions compose, and composing is associative, so what each stretch starts from is found by
a parallel prefix scan: neighbours are composed pair by pair up a tree, and starts are handed down it. Only
stretches that follow closely enough on another take part; after a silence of an interval the next event is
kept whatever came before. Then every stretch is folded on its own, knowing where it starts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden import session
from tablewarden.operators import ordered
from tablewarden.operators.run_log import RunLog

ALWAYS = np.iinfo(np.int64).max
#: A stretch is at least so many intervals wide, so that its step function is a small part of it.
INTERVALS_PER_STRETCH = 64
# Rows of one run that are worth a search instead of a walk.
MANY = 64

Steps = tuple[list[int], list[int]]


def pointers(micros: np.ndarray, droppable: np.ndarray, gap: int) -> np.ndarray:
    """For each event, if it is kept, the next one kept; the number of events where there is none."""
    n = len(micros)
    stays = np.flatnonzero(~droppable)
    next_stay = np.append(stays, n)[np.searchsorted(stays, np.arange(1, n + 1))]
    return np.minimum(next_stay, np.searchsorted(micros, micros + gap, side="left"))


def _joined(steps: Iterator[tuple[int, int]]) -> Steps:
    """Thresholds with their results; neighbours with one result are one, of equal thresholds the first counts."""
    thresholds: list[int] = []
    results: list[int] = []
    for threshold, result in steps:
        if thresholds and threshold <= thresholds[-1]:
            continue
        if results and results[-1] == result:
            thresholds[-1] = threshold
        else:
            thresholds.append(threshold)
            results.append(result)
    return thresholds, results


def step_function(micros: np.ndarray, droppable: np.ndarray, gap: int) -> Steps:
    """How a stretch maps the last kept time before it to the last kept time within it.

    With ``earliest = last + gap``, the first event kept is the first one at or after ``earliest``,
    or the first that cannot be dropped. Returned are rising thresholds and results: the result
    for ``earliest`` is that of the first threshold not below it; beyond the last, nothing is kept.
    ``last`` is not after the stretch's first event, so thresholds end one gap after that event: their
    number is bounded by the distinct microseconds in one gap, whatever the stretch's size.
    """
    n = len(micros)
    end = micros.tolist()
    following = pointers(micros, droppable, gap).tolist()
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            end[i] = end[following[i]]
    stop = int(np.searchsorted(micros, micros[0] + gap, side="left"))
    stays = np.flatnonzero(~droppable)
    first_stay = int(stays[0]) if len(stays) else n

    def steps() -> Iterator[tuple[int, int]]:
        for i in range(min(stop + 1, first_stay, n)):
            yield int(micros[i]), end[i]
        if first_stay <= stop and first_stay < n:
            yield ALWAYS, end[first_stay]

    return _joined(steps())


def applied(steps: Steps, last: int | None, gap: int) -> int | None:
    """The last kept time after a stretch, from that before it."""
    thresholds, results = steps
    if last is None:
        return results[0] if results else None
    at = int(np.searchsorted(np.asarray(thresholds, np.int64), last + gap, side="left"))
    return results[at] if at < len(results) else last


def composed(first: Steps, second: Steps, gap: int) -> Steps:
    """The step function of two stretches, one after the other."""

    def steps() -> Iterator[tuple[int, int]]:
        for threshold, result in zip(*first, strict=True):
            yield threshold, applied(second, result, gap)
        # Where the first keeps nothing, the second starts from what came before both.
        yield from zip(*second, strict=True)

    return _joined(steps())


def throttle(
    log: RunLog,
    interval_ms: int = fixed.PROGRESS_INTERVAL_MS,
    width: int | None = None,
    seed: DataFrame | None = None,
) -> DataFrame:
    """The events that are kept, with all their columns.

    The clock decides, so a run's events are taken by time, and by the log's order within one time.
    ``seed`` may give the time of the last event kept before (the run column and ``micros``); ``width`` is
    that of a stretch, in microseconds.
    """
    gap, run, stretch = interval_ms * 1000, log.run, ordered.STRETCH
    columns = log.events.columns
    timed = log.events.withColumn("_us", log.micros).withColumn(
        "_drop", F.coalesce(F.col("type") == "progress", F.lit(False))
    )
    width = width or max(ordered.MICROS_PER_STRETCH, INTERVALS_PER_STRETCH * gap)
    cut = ordered.in_stretches(timed, F.col("_us"), width)
    carried = _starts(cut, run, gap, seed)
    cut = cut.withColumn("_carry", F.lit(None).cast("long")) if carried is None else cut.join(carried, [run, stretch], "left")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            runs, stretches = (batch.column(c) for c in (run, stretch))
            times = batch.column("_us").to_numpy(zero_copy_only=False)
            drops = batch.column("_drop").to_numpy(zero_copy_only=False)
            carries = batch.column("_carry")
            new = np.zeros(len(batch), bool)
            new[:1] = True
            for keys in (runs, stretches):
                codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            bounds = np.append(np.flatnonzero(new), len(batch))
            mask = np.zeros(len(batch), bool)
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                key = (runs[low].as_py(), stretches[low].as_py())
                if key != group:
                    group, last = key, carries[low].as_py()
                last = keep(times[low:high], drops[low:high], mask[low:high], last, gap)
            yield batch.filter(pa.array(mask, pa.bool_()))

    placed = cut.repartition(run, stretch).sortWithinPartitions(run, stretch, "_us", *log.order)
    return placed.mapInArrow(fold, placed.schema).select(*columns)


def keep(times: np.ndarray, drops: np.ndarray, mask: np.ndarray, last: int | None, gap: int) -> int | None:
    """Mark the kept ones of a run's events in order; returns the last time kept."""
    n = len(times)
    if n < MANY:
        for i, (at, may_drop) in enumerate(zip(times.tolist(), drops.tolist(), strict=True)):
            if not may_drop or last is None or at - last >= gap:
                mask[i], last = True, at
        return last
    at = 0
    if last is not None:
        stays = np.flatnonzero(~drops)
        at = min(int(np.searchsorted(times, last + gap, side="left")), int(stays[0]) if len(stays) else n)
    following, kept = pointers(times, drops, gap).tolist(), []
    while at < n:
        kept.append(at)
        at = following[at]
    mask[kept] = True
    return int(times[kept[-1]]) if kept else last


def _starts(cut: DataFrame, run: str, gap: int, seed: DataFrame | None) -> DataFrame | None:
    """(run, stretch, ``_carry``): the last kept time before stretches that are close to it; None if no stretch is."""
    stretch = ordered.STRETCH
    along = Window.partitionBy(run).orderBy(stretch)
    ends = (
        cut.groupBy(run, stretch)
        .agg(F.min("_us").alias("_low"), F.max("_us").alias("_high"))
        .withColumn("_past", F.lag("_high").over(along))
        .withColumn("_nth", F.row_number().over(along))
    )
    seeds = None
    if seed is not None:
        seeds = seed.select(run, F.col("micros").alias("_seed"))
        ends = ends.join(seeds, run, "left").withColumn("_past", F.when(F.col("_nth") == 1, F.col("_seed")).otherwise(F.col("_past")))
    close = F.coalesce(F.col("_low") - F.col("_past") < gap, F.lit(False))
    # A chain begins where nothing close came before; its stretches are numbered from there.
    chained = (
        ends.withColumn("_close", close)
        .withColumn("_chain", F.sum((~F.col("_close")).cast("long")).over(along))
        .withColumn("_follows", F.coalesce(F.lead(close).over(along), F.lit(False)))
        .where("_close OR _follows")
        .withColumn("_index", F.row_number().over(Window.partitionBy(run, "_chain").orderBy(stretch)) - 1)
    )
    seeded = F.col("_seed") if seed is not None else F.lit(None).cast("long")
    chained = session.materialised(
        chained.select(run, stretch, "_chain", F.col("_index").cast("long"), F.when(F.col("_nth") == 1, seeded).alias("_seed")), "chains"
    )
    longest = chained.agg(F.max("_index")).first()[0]
    if longest is None:
        return None
    if not longest:
        return chained.select(run, stretch, F.col("_seed").alias("_carry"))
    leaves = _functions(cut, chained, run, gap)
    return _handed_down(_composed_up(leaves, run, gap, longest), chained, run, gap)


_FUNCTION = "thresholds array<long>, results array<long>"


def _functions(cut: DataFrame, chained: DataFrame, run: str, gap: int) -> DataFrame:
    """(run, _chain, _index, step function) of every stretch of a chain."""
    stretch, run_type = ordered.STRETCH, cut.schema[run].dataType.simpleString()
    # Of events at one time only this counts: whether one of them cannot be dropped. Bursts merge on
    # the map side, and a stretch's rows are bounded by the distinct times in it.
    rows = (
        cut.join(chained, [run, stretch])
        .groupBy(run, "_chain", "_index", "_us")
        .agg(F.bool_and("_drop").alias("_drop"))
    )

    def summarise(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_us")
        steps = step_function(pdf["_us"].to_numpy(np.int64), pdf["_drop"].to_numpy(bool), gap)
        return pd.DataFrame([[*key, *steps]], columns=[run, "_chain", "_index", "thresholds", "results"])

    found = rows.groupBy(run, "_chain", "_index").applyInPandas(
        summarise, f"{run} {run_type}, _chain long, _index long, {_FUNCTION}"
    )
    return session.materialised(found, "functions")


def _composed_up(leaves: DataFrame, run: str, gap: int, longest: int) -> list[DataFrame]:
    """The tree's levels from the leaves: a node has the function of the two below it, one after the other."""
    run_type = leaves.schema[run].dataType.simpleString()

    def pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(list(r.thresholds), list(r.results)) for r in pdf.sort_values("_index").itertuples()]
        steps = own[0] if len(own) == 1 else composed(own[0], own[1], gap)
        return pd.DataFrame([[*key, *steps]], columns=[run, "_chain", "_index", "thresholds", "results"])

    levels = [leaves]
    for _ in range(int(longest).bit_length()):
        below = levels[-1]
        above = below.groupBy(run, "_chain", F.shiftright("_index", 1).alias("_above")).applyInPandas(
            pair, f"{run} {run_type}, _chain long, _index long, {_FUNCTION}"
        )
        levels.append(session.materialised(above, "functions"))
    return levels


def _handed_down(levels: list[DataFrame], chained: DataFrame, run: str, gap: int) -> DataFrame:
    """What each leaf starts from: a left child what its parent does, a right child what its sibling makes of that."""
    run_type = chained.schema[run].dataType.simpleString()
    seeds = chained.where("_index = 0").select(run, "_chain", F.col("_seed").alias("_carry"))
    starts = seeds.withColumn("_index", F.lit(0).cast("long"))

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_index")
        start = pdf["_carry"].iloc[0]
        carries = [None if pd.isna(start) else int(start)]
        if len(pdf) > 1:
            left = (list(pdf["thresholds"].iloc[0]), list(pdf["results"].iloc[0]))
            carries.append(applied(left, carries[0], gap))
        return pd.DataFrame({run: pdf[run], "_chain": pdf["_chain"], "_index": pdf["_index"], "_carry": pd.array(carries, "Int64")})

    for level in reversed(levels[:-1]):
        above = starts.withColumnRenamed("_index", "_above")
        children = level.withColumn("_above", F.shiftright("_index", 1)).join(above, [run, "_chain", "_above"])
        starts = children.groupBy(run, "_chain", "_above").applyInPandas(
            split, f"{run} {run_type}, _chain long, _index long, _carry long"
        )
        if level is not levels[0]:
            starts = session.materialised(starts, "starts")
    return chained.join(starts, [run, "_chain", "_index"]).select(run, ordered.STRETCH, "_carry")


# Python workers get this code with the job; nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
