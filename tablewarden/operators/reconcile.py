"""Comparing a table with its copy: counts, checksums, row differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"


def reconcile(source: DataFrame, restored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each object of either side.

    ``source`` has scope (ALL, SCHEMA, EXCLUDED), kind and rows; ``restored`` has kind and rows.
    """
    joined = source.withColumnsRenamed({"rows": "source_rows", "kind": "source_kind"}).join(
        restored.withColumnsRenamed({"rows": "restored_rows", "kind": "restored_kind"}),
        list(keys),
        "full_outer",
    )
    scope, there = F.col("scope"), F.col("restored_kind").isNotNull()
    status = (
        F.when(scope.isNull(), "unexpected")
        .when(scope == "EXCLUDED", F.when(there, "unexpected").otherwise("excluded"))
        .when(~there, "missing")
        .when(F.col("source_kind") != F.col("restored_kind"), "kind-changed")
        .when(F.col("source_kind") == "view", "match")
        .when(
            scope == "SCHEMA",
            F.when(F.col("restored_rows") == 0, "schema-only").otherwise("unexpected-rows"),
        )
        .when(F.col("source_rows") == F.col("restored_rows"), "match")
        .otherwise("rows-differ")
    )
    return joined.withColumn("status", status)


def _hashable(column: Column, dtype: T.DataType) -> Column:
    """Maps have no order and no hash of their own: their sorted entries stand for them."""
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(column))
    if isinstance(dtype, T.VariantType):
        return F.to_json(column)
    return column


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row's exact values; which columns are null counts too."""
    columns = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c, _ in columns])
    return F.xxhash64(nulls, *[_hashable(c, t) for c, t in columns])


def portable_text(column: Column, dtype: T.DataType, scale: int) -> Column:
    """Text of a value that other engines write alike; doubles as whole numbers of 10^-scale."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = F.round(column * F.lit(float(10**scale))).try_cast("long").cast("string")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(column)
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def portable_row_hash(df: DataFrame, scale: int) -> Column:
    """The md5 of a row's portable text, in hexadecimal: for comparison with another engine.

    It does not see differences of doubles below the scale; within Spark use :func:`row_hash`.
    """
    parts = [portable_text(F.col(f"`{f.name}`"), f.dataType, scale) for f in df.schema.fields]
    return F.md5(F.concat_ws("|", *parts))


def portable_sum(hashes: Column) -> Column:
    """The sums of the four 32-bit parts of all hashes, in order, with dashes between: all 128 bits count.

    A part has 32 bits, so a sum of longs could overflow from 2^31 rows on; decimals cannot.
    """
    sums = [
        F.sum(F.conv(F.substring(hashes, 8 * part + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
        for part in range(4)
    ]
    return F.concat_ws("-", *[F.coalesce(s, F.lit("0")) for s in sums])


def hash_sum(hashes: Column) -> Column:
    """Sum of row hashes, read as unsigned, as an exact decimal aggregate.

    The four 16-bit parts are summed as longs, which cannot overflow below 1.4 * 10^14 rows and stay in
    generated code; they are put together once at the end. A sum needs no sort, merges on the map
    side and, unlike an exclusive or, does not lose pairs of equal rows.
    """
    total = F.lit(0).cast("decimal(38,0)")
    for part in range(4):
        bits = F.shiftrightunsigned(hashes, 16 * part).bitwiseAND(F.lit(0xFFFF).cast("long"))
        weight = F.lit(1 << (16 * part)).cast("decimal(20,0)")
        total = total + (F.coalesce(F.sum(bits), F.lit(0)).cast("decimal(20,0)") * weight).cast(
            "decimal(38,0)"
        )
    return total.cast("decimal(38,0)")


def checksum(df: DataFrame, portable_scale: int | None = None) -> DataFrame:
    """One row: number of rows and an order-insensitive checksum."""
    if portable_scale is None:
        total = hash_sum(row_hash(df))
    else:
        total = portable_sum(portable_row_hash(df, portable_scale))
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("checksum"))


#: Parts of each of the two levels that tables are compared by before rows are.
FAN_BITS = 10
FAN = 1 << FAN_BITS


def narrowed(left: DataFrame, right: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parts in which they agree: what a difference of rows has to look at.

    A tree of two levels over the hash of the columns ``by``: first so many parts are compared by
    their numbers and hash sums, then parts of the parts that differ. What is shuffled are sums, at most one
    for each part, so the rows that a comparison then shuffles follow the parts that differ and not the tables. Each
    table is scanned three times. With ``by`` a key, a changed row is in one part on both sides; equal tables
    leave nothing. Columns of one name must have one type.
    """
    columns = left.columns
    spot = F.xxhash64(*[F.col(f"`{c}`") for c in by])
    first = F.pmod(spot, F.lit(FAN)).cast("int")
    second = F.pmod(F.shiftright(spot, FAN_BITS), F.lit(FAN)).cast("int")

    def placed(df: DataFrame) -> DataFrame:
        rows = df.select(*[f"`{c}`" for c in columns])
        return rows.select("*", first.alias("_first"), second.alias("_second"), row_hash(rows).alias("_hash"))

    sides = [placed(left), placed(right)]

    def differing(parts: list[str], rows: list[DataFrame]) -> DataFrame:
        summed = [side.groupBy(*parts).agg(F.count(F.lit(1)).alias("n"), hash_sum(F.col("_hash")).alias("h")) for side in rows]
        signed = summed[0].unionByName(summed[1].select(*parts, (-F.col("n")).alias("n"), (-F.col("h")).alias("h")))
        return signed.groupBy(*parts).agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where("n <> 0 OR h <> 0").select(*parts)

    # At most FAN rows, so sending them to all tasks is safe.
    outer = F.broadcast(differing(["_first"], sides))
    inner = differing(["_first", "_second"], [side.join(outer, "_first", "left_semi") for side in sides])
    # At most FAN times FAN pairs of numbers.
    kept = [side.join(F.broadcast(inner), ["_first", "_second"], "left_semi") for side in sides]
    return kept[0].select(*[f"`{c}`" for c in columns]), kept[1].select(*[f"`{c}`" for c in columns])


def row_surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference: each differing row once, with how many more the left side has.

    Both sides are counted together, so copies merge before the shuffle and a row with very many
    copies stays one row throughout (a plain EXCEPT ALL would write each copy out in one task).
    """
    columns = left.columns
    signed = left.withColumn("_n", F.lit(1).cast("long")).unionByName(
        right.select(*columns).withColumn("_n", F.lit(-1).cast("long"))
    )
    return (
        signed.groupBy(*[f"`{c}`" for c in columns])
        .agg(F.sum("_n").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by all other columns: a mergeable aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*rest)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*").select(*df.columns)


def keyed_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two keyed tables that are on one side only or differ, with the differing columns."""
    rest = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*rest).alias("left_row"))
    b = right.select(*keys, F.struct(*rest).alias("right_row"))
    changed = F.filter(
        F.array(
            *[
                F.when(~F.col(f"left_row.{c}").eqNullSafe(F.col(f"right_row.{c}")), F.lit(c))
                for c in rest
            ]
        ),
        lambda c: c.isNotNull(),
    )
    status = (
        F.when(F.col("right_row").isNull(), "left-only")
        .when(F.col("left_row").isNull(), "right-only")
        .when(F.size(changed) > 0, "changed")
    )
    return (
        a.join(b, list(keys), "full_outer")
        .select(*keys, status.alias("status"), F.when(status == "changed", changed).alias("columns"))
        .where(F.col("status").isNotNull())
    )


def paired_versions(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Whether both sides of a pair are there and report the same version."""
    return (
        left.withColumnRenamed("version", "left_version")
        .join(right.withColumnRenamed("version", "right_version"), key, "full_outer")
        .withColumn(
            "agreement",
            F.when(
                F.col("left_version").isNull() | F.col("right_version").isNull(), "incomplete"
            )
            .when(F.col("left_version") == F.col("right_version"), "equal")
            .otherwise("different"),
        )
    )
