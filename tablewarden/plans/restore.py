"""Restore of an artifact into a database: verify, disclose the plan, then change anything."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewarden.findings import FINDINGS, all_findings, check, refuse_on
from tablewarden.operators import artifact, catalog, naming
from tablewarden.plans import snapshot
from tablewarden.sources import artifact_files
from tablewarden.sources.folders import Folders

DESTINATION_RULES = (
    "invalid-destination",
    "system-destination",
    "overwrite-needs-existing",
    "invalid-object-count",
    "destination-not-empty",
)


SHOWN_CANDIDATES = 10  # in a message; of more only the number


class NotApproved(Exception):
    """The plan was disclosed and not approved; nothing was changed."""


@dataclass(frozen=True)
class Restore:
    """Restore one source database of an artifact under a destination name."""

    spark: SparkSession
    path: str
    source: str
    destination: str
    destination_policy: str = "require-empty"
    overwrite_policy: str = "reject"
    threads: int = 4
    location: str | None = None

    def verify(self) -> DataFrame:
        return snapshot.verify(self.spark, self.path, threads=self.threads)

    def _objects(self) -> DataFrame:
        manifest = self.spark.read.parquet(f"{self.path}/{snapshot.MANIFEST}")
        return manifest.where(F.col("database_name") == self.source)

    def plan(self) -> DataFrame:
        """One row telling what a restore would touch and under which policies."""
        exists = self.spark.catalog.databaseExists(self.destination)
        held = len(self.spark.catalog.listTables(self.destination)) if exists else 0
        return self._objects().agg(
            F.lit(self.path).alias("artifact"),
            F.lit(self.source).alias("source"),
            F.lit(self.destination).alias("database"),
            F.lit(exists).alias("destination_exists"),
            F.lit(str(held)).alias("objects"),
            F.lit(self.destination_policy).alias("destination_policy"),
            F.lit(self.overwrite_policy).alias("overwrite_policy"),
            F.count(F.lit(1)).alias("restored_objects"),
            F.sum("rows").alias("restored_rows"),
        )

    def apply(self, approve: bool | Callable[[Row], bool]) -> DataFrame:
        """Restore after the artifact and the destination pass and the plan is approved.

        Returns database_name, table_name, kind and rows of what was restored.
        """
        refuse_on(self.verify(), snapshot.RULE_ORDER)
        plan = self.plan()
        refuse_on(check(plan, catalog.destination_rules()), DESTINATION_RULES)
        summary = plan.collect()[0]  # one row by construction
        if summary.restored_objects == 0:
            raise ValueError(f"the artifact holds nothing of {self.source}")
        approved = approve(summary) if callable(approve) else approve
        if approved is not True:
            raise NotApproved(self.destination)
        where = f" LOCATION '{self.location}'" if self.location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.destination}`{where}")
        items = list(self._objects().drop("schema_json").toLocalIterator())
        if self.overwrite_policy == "reject":
            for item in items:
                if self.spark.catalog.tableExists(f"`{self.destination}`.`{item.table_name}`"):
                    raise FileExistsError(f"{self.destination}.{item.table_name}")
        tables = [i for i in items if i.kind != "view"]
        with ThreadPoolExecutor(self.threads) as pool:
            list(pool.map(self._load, tables))
        for item in items:
            if item.kind == "view":
                self._create_view(item)
        return restored_counts(self.spark, self.destination, items, self.threads)

    def _load(self, item: Row) -> None:
        target = f"`{self.destination}`.`{item.table_name}`"
        rows = self.spark.read.parquet(
            snapshot.object_path(self.path, item.database_name, item.table_name)
        )
        keeps_schema = self.overwrite_policy in ("truncate", "delete")
        if keeps_schema and self.spark.catalog.tableExists(target):
            # Both empty the table and keep its definition: for files they are one operation.
            columns = self.spark.table(target).columns
            rows.select(*columns).write.insertInto(target, overwrite=True)
            return
        mode = "overwrite" if self.overwrite_policy == "drop" else "errorifexists"
        rows.write.format("parquet").mode(mode).saveAsTable(target)

    def _create_view(self, item: Row) -> None:
        if not item.definition:
            raise ValueError(f"view {item.table_name} has no definition")
        verb = "CREATE VIEW" if self.overwrite_policy == "reject" else "CREATE OR REPLACE VIEW"
        body = item.definition.replace("{database}", f"`{self.destination}`")
        self.spark.sql(f"{verb} `{self.destination}`.`{item.table_name}` AS {body}")


def restored_counts(
    spark: SparkSession, database: str, items: list[Row], threads: int = 4
) -> DataFrame:
    def count(item: Row) -> tuple[str, str, str, int | None]:
        kind = spark.catalog.getTable(f"`{database}`.`{item.table_name}`").tableType
        if kind == "VIEW":
            return database, item.table_name, "view", None
        rows = spark.table(f"`{database}`.`{item.table_name}`").count()
        return database, item.table_name, "base-table", rows

    with ThreadPoolExecutor(threads) as pool:
        counted = list(pool.map(count, items))
    return spark.createDataFrame(
        counted, "database_name string, table_name string, kind string, rows long"
    )


DUMP_METADATA = "metadata"


def verify_dump(
    spark: SparkSession, path: str, source: str, reported_files: int | None = None, loader: str = "loader"
) -> DataFrame:
    """Findings on a flat artifact of text files: every entry, the manifest's sections, and what objects must have.

    Entries that Spark's readers pass over (hidden ones, folders) are judged too. ``reported_files`` is the number
    that the run which wrote the artifact told, without the manifest. First failures come in
    ``artifact.RULE_ORDER``.
    """
    if not Folders(spark).exists(f"{path}/{DUMP_METADATA}"):
        return spark.createDataFrame([("not-an-artifact", path, "error", "there is no manifest")], FINDINGS)
    entries = artifact_files.list_entries(spark, path)
    files = entries.where("regular")
    sections = artifact_files.read_sections(spark, f"{path}/{DUMP_METADATA}").withColumn("artifact", F.lit(path))
    listed = sections.where(F.col("table_name").isNotNull()).dropDuplicates(["database_name", "table_name"])
    parts = [
        artifact.file_findings(entries.where(F.col("file_name") != DUMP_METADATA)),
        artifact.section_findings(sections, loader=loader),
        artifact.emptiness_findings(sections, source),
        artifact.restore_findings(listed, files),
        artifact.repeated_values(entries, ["file_name"], "duplicate-file"),
    ]
    if reported_files is not None:
        data = entries.where(F.col("file_name") != DUMP_METADATA)
        parts.append(artifact.file_count_findings(data, F.lit(reported_files)))
    return all_findings(parts)


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Names of the published artifacts below a folder; staged ones begin with a dot."""
    names = [(n,) for n in Folders(spark).folders(root) if not n.startswith(".")]
    return spark.createDataFrame(names, "name string")


def find_artifact(spark: SparkSession, root: str, key: str, explicit: str | None = None) -> str:
    """Path of the one artifact of a key; an explicit path wins over any listing."""
    if explicit is not None:
        explicit = explicit.strip()
        if explicit == "":
            raise ValueError("the artifact path must not be empty")
        return explicit if explicit.startswith("/") or ":" in explicit else f"{root}/{explicit}"
    keys = spark.createDataFrame([(key,)], "id string")
    listing = list_artifacts(spark, root)
    chosen = naming.pick_artifacts(keys, listing).collect()[0]  # one key
    if chosen.matches == 0:
        raise LookupError(f"{key}: none matched")
    if chosen.matches > SHOWN_CANDIDATES:
        raise LookupError(f"{key}: {chosen.matches} matches")
    if chosen.path is None:
        shown = naming.artifact_candidates(keys, listing).orderBy("name").collect()
        raise LookupError(f"{key}: {chosen.matches} matches: {', '.join(r.name for r in shown)}")
    return f"{root}/{chosen.path}"
