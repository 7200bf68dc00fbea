"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from tablewarden.sources.folders import Folders

# Settings the library is written for; callers pass them to their session builder.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Of a JSON object's repeated keys the last one counts, as in most readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Generated methods above this size are never compiled to machine code; splitting them instead
    # halves the time of long rule chains such as the log parser's.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# Folders of materialised copies, in the order made; and which copy reads which.
MADE: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings a running session still takes."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def _scratch_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.split("[")[0] == "local":
            raise ValueError("name a folder that all executors reach in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="tablewarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tablewarden/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, in a part of this application's own.

    Only on one machine, where the session names no folder (tests, notebooks), a local one is made and
    recorded. Anywhere else a missing setting is an error, as executors would write to their own disks.
    """
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; call it when no result that reads it is needed any more."""
    Folders(spark).delete(_scratch_root(spark))


def materialised(df: DataFrame, label: str) -> DataFrame:
    """The rows of a table that several rules read, written once to the shared folder.

    Unlike a cache it is there after executors are lost, and unlike the plan it is not computed again
    by every rule.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    _PATHS[copy] = path
    MADE.append(path)
    return copy


def discard(spark: SparkSession, *copies: DataFrame | str) -> None:
    """Delete materialised copies (or their paths) that nothing will read any more."""
    for copy in copies:
        path = copy if isinstance(copy, str) else _PATHS[copy]
        Folders(spark).delete(path)
        if path in MADE:
            MADE.remove(path)
