"""Export of many tables into one artifact that is complete or not there at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.findings import FINDINGS, Rule, all_findings, check, refuse_on
from tablewarden.operators import artifact, reconcile, selection
from tablewarden.sources.artifact_files import list_files
from tablewarden.sources.catalog import Reader
from tablewarden.sources.folders import Folders

MANIFEST = "manifest"
DATA = "data"
MANIFEST_SCHEMA = (
    "database_name string, table_name string, kind string, scope string, rows long, "
    "checksum decimal(38,0), definition string, schema_json string"
)
RULE_ORDER = ("not-an-artifact", "unexpected-entry", "duplicate-object", "missing-data", "missing-schema", "row-count", "unsafe-identifier")

# A further check a caller may add: (manifest, files) -> findings.
ExtraRule = Callable[[DataFrame, DataFrame], DataFrame]


def object_path(root: str, database: str, table: str) -> str:
    return f"{root}/{DATA}/{database}.{table}"


@dataclass(frozen=True)
class Snapshot:
    """What to export: a resolved selection and how to read its tables.

    ``objects`` has database_name, table_name, kind and scope; views may have a ``definition``.
    """

    spark: SparkSession
    objects: DataFrame
    reader: Reader
    compression: str = "zstd"
    threads: int = 4
    rows_per_file: int = 0
    with_checksum: bool = False
    extra_rules: Sequence[ExtraRule] = field(default_factory=tuple)

    def export(self, target: str) -> DataFrame:
        """Write the artifact and return its manifest.

        Everything is written and checked below a hidden sibling, the manifest last, then renamed.
        A target that exists is refused before the work and again by the rename itself. Where a
        rename copies (object stores), readers still refuse a folder without its manifest.
        """
        self._check_options()
        folders = Folders(self.spark)
        if folders.exists(target):
            raise FileExistsError(target)
        refuse_on(selection.identifier_findings(self.objects), ("unsafe-identifier",))
        parent, _, name = target.rstrip("/").rpartition("/")
        staged = f"{parent}/.{name}.{uuid.uuid4().hex}.partial"
        folders.make_parent(staged)
        try:
            with ThreadPoolExecutor(self.threads) as pool:
                # The driver holds one small record per table: each table is a job of its own.
                exported = list(
                    pool.map(lambda o: self._export_one(o, staged), self._selected())
                )
            if not exported:
                raise ValueError("the selection is empty: nothing to export")
            manifest = self.spark.createDataFrame(exported, MANIFEST_SCHEMA)
            manifest.coalesce(1).write.mode("errorifexists").parquet(f"{staged}/{MANIFEST}")
            refuse_on(verify(self.spark, staged, self.extra_rules), RULE_ORDER)
            folders.publish(staged, target)
        except BaseException:
            folders.delete(staged)
            raise
        return self.spark.read.parquet(f"{target}/{MANIFEST}")

    def _check_options(self) -> None:
        if self.compression not in fixed.COMPRESSIONS:
            raise ValueError(f"unknown compression: {self.compression}")
        if self.threads < fixed.MIN_THREADS:
            raise ValueError(f"threads must be at least {fixed.MIN_THREADS}")

    def _selected(self):
        columns = [*("database_name", "table_name", "kind", "scope")]
        definition = (
            F.col("definition") if "definition" in self.objects.columns else F.lit(None).cast("string")
        )
        return self.objects.select(*columns, definition.alias("definition")).toLocalIterator()

    def _export_one(self, item: Row, staged: str) -> tuple:
        database, table = item.database_name, item.table_name
        rows, checksum, schema = None, None, None
        if item.kind != "view":
            df = self.reader(self.spark, database, table)
            schema = df.schema.json()
            rows, checksum = self._write(df, item.scope, object_path(staged, database, table))
        return (database, table, item.kind, item.scope, rows, checksum, item.definition, schema)

    def _write(self, df: DataFrame, scope: str, path: str) -> tuple[int | None, object]:
        """Write straight from the scan's partitions; counting and hashing ride along."""

        def save(frame: DataFrame) -> None:
            (
                frame.write.mode("errorifexists")
                .option("compression", self.compression)
                .option("maxRecordsPerFile", self.rows_per_file)
                .parquet(path)
            )

        if scope == "SCHEMA":
            save(df.limit(0))
            return None, None
        measured = Observation()
        metrics = [F.count(F.lit(1)).alias("rows")]
        if self.with_checksum:
            metrics.append(reconcile.hash_sum(reconcile.row_hash(df)).alias("checksum"))
        save(df.observe(measured, *metrics))
        found = measured.get
        return found["rows"], found.get("checksum")


def verify(
    spark: SparkSession, path: str, extra_rules: Sequence[ExtraRule] = (), threads: int = 4
) -> DataFrame:
    """Findings on an artifact: its manifest against the files and the rows they hold."""
    if not Folders(spark).exists(f"{path}/{MANIFEST}"):
        return spark.createDataFrame(
            [("not-an-artifact", path, "error", "there is no manifest")], FINDINGS
        )
    manifest = spark.read.parquet(f"{path}/{MANIFEST}")
    tables = manifest.where(F.col("kind") != "view")
    if not Folders(spark).exists(f"{path}/{DATA}"):
        files = spark.createDataFrame([], "file_name string, length long")
    else:
        files = list_files(spark, f"{path}/{DATA}")
    held = (
        files.select(F.substring_index("file_name", "/", 1).alias("object"))
        .groupBy("object")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    name = F.concat_ws(".", "database_name", "table_name")
    listed = tables.withColumn("object", name).join(held, "object", "left")
    rows = F.col("rows")
    presence = check(
        listed,
        [
            Rule("missing-data", (rows > 0) & F.col("files").isNull(), name, F.lit("rows but no file")),
            Rule("missing-schema", F.col("files").isNull(), name, F.lit("no file tells its columns")),
            Rule(
                "row-count",
                (F.col("scope") != "SCHEMA") & rows.isNull(),
                name,
                F.lit("no row count"),
            ),
        ],
    )
    counted = stored_rows(spark, path, listed.where(F.col("files").isNotNull()), threads)
    differing = check(
        tables.join(counted, ["database_name", "table_name"]),
        [
            Rule(
                "row-count",
                F.coalesce(rows, F.lit(0)) != F.col("stored"),
                name,
                F.concat_ws(" ", F.lit("stored rows:"), F.col("stored").cast("string")),
            )
        ],
    )
    parts = [
        presence,
        differing,
        selection.identifier_findings(manifest),
        artifact.repeated_values(manifest, ["database_name", "table_name"], "duplicate-object"),
        unexpected_entries(spark, path, tables, files),
    ]
    return all_findings([*parts, *(rule(manifest, files) for rule in extra_rules)])


def unexpected_entries(spark: SparkSession, path: str, tables: DataFrame, files: DataFrame) -> DataFrame:
    """What lies in an artifact and is neither manifest nor data of a listed table: hidden entries, files, folders.

    The listings are one call for the root and one for its data folder. Markers that Spark's writers
    leave (``_SUCCESS`` and checksums) are part of a table's folder and not looked at.
    """
    folders = Folders(spark)
    at_root = [n for n, _, _ in folders.unusual(path) if n not in (MANIFEST, DATA)] + folders.plain_files(path)
    in_data = [f"{DATA}/{n}" for n in folders.plain_files(f"{path}/{DATA}")]
    held = spark.createDataFrame([(n,) for n in folders.folders(f"{path}/{DATA}")], "object string")
    listed = tables.select(F.concat_ws(".", "database_name", "table_name").alias("object"))
    strange = held.join(listed, "object", "left_anti").select(F.concat(F.lit(f"{DATA}/"), "object").alias("entry"))
    nested = files.where(F.size(F.split("file_name", "/")) != 2).select(F.concat(F.lit(f"{DATA}/"), "file_name").alias("entry"))
    named = spark.createDataFrame([(n,) for n in [*at_root, *in_data]], "entry string")
    entries = named.unionByName(strange).unionByName(nested).distinct()
    return check(entries, [Rule("unexpected-entry", F.lit(True), F.col("entry"), F.lit("not part of the artifact"))])


def stored_rows(spark: SparkSession, path: str, tables: DataFrame, threads: int = 4) -> DataFrame:
    """Rows each object's files hold. A count without columns reads file footers only."""

    def count(item: Row) -> tuple[str, str, int]:
        where = object_path(path, item.database_name, item.table_name)
        return item.database_name, item.table_name, spark.read.parquet(where).count()

    names = tables.select("database_name", "table_name").toLocalIterator()
    with ThreadPoolExecutor(threads) as pool:
        counts = list(pool.map(count, names))
    return spark.createDataFrame(counts, "database_name string, table_name string, stored long")
