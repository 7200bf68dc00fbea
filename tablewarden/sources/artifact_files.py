"""An artifact on disk as tables: its files, and the sections of a text manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions import names
from tablewarden.operators.artifact import HEADING, OBJECT_HEADING, sets_switch
from tablewarden.operators.selection import DATABASE, TABLE
from tablewarden.sources.folders import Folders


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path that Spark would read: ``file_name`` relative to it, and ``length``.

    File contents are not read: the content column is never selected.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ).select("path", "length")
    root = Folders(spark).qualified(path).rstrip("/") + "/"
    # The root is a prefix of every path and taken off once, whatever the names below it are.
    return files.select(F.substr("path", F.lit(len(root) + 1)).alias("file_name"), "length")


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry of a flat artifact: ``file_name``, ``length`` and ``regular`` (false for folders and the like).

    Unlike :func:`list_files` it tells of names beginning with a dot or underscore, so nothing escapes
    the rules on files; what lies in a folder is not listed, as the folder itself is refused.
    """
    seen = list_files(spark, path).where(~F.contains("file_name", F.lit("/"))).withColumn("regular", F.lit(True))
    passed_over = spark.createDataFrame(Folders(spark).unusual(path), "file_name string, length long, regular boolean")
    return seen.unionByName(passed_over)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections of a text manifest, one row each, without any ordering work.

    A section ends where a line begins with a bracket, so that break is the record separator: Spark
    splits even a huge manifest by itself. Headings with blanks before them are split off within a
    record. Like :func:`artifact.assign_headings` it takes a trimmed line in brackets for a heading.
    """
    raw = spark.read.option("lineSep", "\n[").text(path)
    text = F.regexp_replace("value", r"\r", "")
    # The separator took the bracket of all headings but a first one; a preamble has none at all.
    has_heading = names.trimmed(F.substring_index(text, "\n", 1)).endswith("]") & ~text.startswith("[")
    restored = F.when(has_heading, F.concat(F.lit("["), text)).otherwise(text)
    blanks = r"[ \t\x0B\f]*"
    raw = raw.select(F.explode(F.split(restored, rf"\n(?={blanks}\[[^\n]*\]{blanks}(?:\n|\z))")).alias("whole"))
    whole = F.col("whole")
    head = names.trimmed(F.substring_index(whole, "\n", 1))

    def value(key: str):
        pattern = rf"(?m)^{key}\s*=\s*([0-9]+)\s*$"
        return F.when(whole.rlike(pattern), F.regexp_extract(whole, pattern, 1))

    def part(group: int):
        return F.when(head.rlike(OBJECT_HEADING), F.regexp_extract(head, OBJECT_HEADING, group))

    return raw.where(head.rlike(HEADING)).select(
        head.alias("heading"),
        part(1).alias(DATABASE),
        part(2).alias(TABLE),
        value("rows").alias("declared_rows"),
        value("is_view").alias("view_flag"),
        F.size(F.filter(F.split(whole, "\n"), sets_switch)).cast("long").alias("control_lines"),
    )
