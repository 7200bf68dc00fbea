"""Order-dependent work that survives a hot group.

A window over one key runs in one task. Most order-dependent rules here are therefore plain
aggregates (smallest position, value at the largest position). Where a true scan is needed, every group
is cut into stretches of a fixed width along its order, each scanned on its own, and the little that a
stretch passes on is carried from stretch to stretch. A row's stretch follows from the row alone, so
nothing has to be counted before the plan is made, and plan and result are the same at every size. A group
within one stretch, as most are, costs one more row in the table that carries. Many rows at nearly one position
are one stretch: Spark sorts them on disk, and the scans remember no more than a few values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a stretch where positions count rows, and where they are microseconds.
ROWS_PER_STRETCH = 1_000_000
MICROS_PER_STRETCH = 3_600_000_000
STRETCH = "_stretch"


def in_stretches(df: DataFrame, position: Column, width: int = ROWS_PER_STRETCH) -> DataFrame:
    """Add ``_stretch``, which rises with ``position`` (a long)."""
    return df.withColumn(STRETCH, F.floor(position / F.lit(width)).cast("long"))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    position: Column,
    width: int = ROWS_PER_STRETCH,
) -> DataFrame:
    """Row numbers within each key, also where one key holds most rows.

    Rows are numbered within their stretch, and the sizes of the earlier stretches are added.
    ``position`` is a long that rises with ``order``.
    """
    cut = in_stretches(df, position, width)
    local = cut.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys, STRETCH).orderBy(*order)).cast("long")
    )
    earlier = Window.partitionBy(*keys).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, STRETCH)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*keys, STRETCH, F.sum("_size").over(earlier).alias("_before"))
        .where("_before IS NOT NULL")
    )
    return (
        local.join(offsets, [*keys, STRETCH], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop(STRETCH, "_before")
    )


def carried_forward(
    df: DataFrame, keys: Sequence[str], line: str, value: str, name: str, lines_per_stretch: int
) -> DataFrame:
    """Last non-null ``value`` at or before each line."""
    cut = in_stretches(df, F.col(line), lines_per_stretch)
    so_far = (
        Window.partitionBy(*keys, STRETCH)
        .orderBy(line)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    )
    endings = (
        cut.groupBy(*keys, STRETCH)
        .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(line))).alias("_end"))
        .select(*keys, STRETCH, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    )
    return (
        cut.withColumn("_local", F.last(value, ignorenulls=True).over(so_far))
        .join(endings, [*keys, STRETCH], "left")
        .withColumn(name, F.coalesce("_local", "_carried"))
        .drop(STRETCH, "_local", "_carried")
    )
