"""What the operators of this package share: tables, words, folds and stored intermediate results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import session

# The white space that parts words, in Java's and Python's pattern syntax.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Rows of one Arrow batch: whole texts travel in them, so a batch stays at some megabytes.
ROWS_PER_BATCH = 250


def prepare(spark: SparkSession) -> SparkSession:
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder: read several times, and there after executors are lost."""
    return session.materialised(df, label)


def file_bytes(path: str) -> bytes:
    """A vocabulary or model file, read where the query is planned and sent along with the job."""
    with open(path, "rb") as file:
        return file.read()


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"{wanted}_"
    return wanted


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def words(text: Column) -> Column:
    """Runs of non-space characters; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def slots_of(spark: SparkSession, count: int) -> list[int]:
    """For each of so many partitions a number that Spark's hash puts there, so that each range has a task of its own."""
    numbers = spark.range(32 * count + 64).select(F.col("id").cast("int").alias("slot"))
    found = numbers.groupBy(F.pmod(F.hash("slot"), F.lit(count)).alias("part")).agg(F.min("slot")).collect()
    known = dict(map(tuple, found))
    return [known.get(part, part) for part in range(count)]
