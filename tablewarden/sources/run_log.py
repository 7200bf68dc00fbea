"""Run logs as tables of lines, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(raw: DataFrame) -> DataFrame:
    line = F.regexp_replace("value", r"\r\z", "")
    return raw.select(line.alias("line")).where(F.col("line") != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines; either line ending. A torn last line fails its parse and is quarantined."""
    return _lines(spark.read.option("lineSep", "\n").text(path))


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same from files as they arrive; ``maxBytesPerTrigger`` bounds a micro-batch."""
    return _lines(spark.readStream.options(lineSep="\n", **options).text(path))
