"""A backup in one call: check what is selected, resolve its scope, export it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.findings import all_findings, refuse_on
from tablewarden.operators import catalog, selection
from tablewarden.plans.snapshot import Snapshot
from tablewarden.sources.catalog import Reader

PREFLIGHT_RULES = ("missing-database", "unqualified-product", "unsafe-engine", "missing-privilege")


@dataclass(frozen=True)
class Backup:
    """Some databases of a catalog, without the tables that ``drop`` names and the rows of those in ``schema_only``.

    ``facts`` are the tables of `sources.catalog` (``tables``, and where known ``databases`` and ``keys``).
    Without ``databases`` those that hold a table are there; without ``keys`` no table is said to lack one.
    ``more`` are further findings, of grants for instance; errors among them stop the backup too. ``options`` go
    to the `Snapshot`.
    """

    spark: SparkSession
    facts: Mapping[str, DataFrame]
    reader: Reader
    databases: Sequence[str]
    drop: Sequence[str] = ()
    schema_only: Sequence[str] = ()
    include_views: bool = True
    safe_engines: Sequence[str] = (fixed.SAFE_ENGINE,)
    more: Sequence[DataFrame] = ()
    options: Mapping[str, object] = field(default_factory=dict)

    def selected(self) -> DataFrame:
        """The tables of the databases, with ``has_key``."""
        tables = selection.of_kinds(selection.in_databases(self.facts["tables"], self.databases), self.include_views)
        if "keys" not in self.facts:
            return tables.withColumn("has_key", F.lit(True))
        return catalog.mark_existence(tables, [selection.DATABASE, selection.TABLE], self.facts["keys"], "has_key")

    def preflight(self) -> DataFrame:
        """Errors and warnings on the selection; nothing is written."""
        wanted = self.spark.createDataFrame([(d,) for d in self.databases], f"{selection.DATABASE} string")
        present = self.facts.get("databases", self.facts["tables"]).select(selection.DATABASE)
        # Tables that are dropped need no key and may have any engine.
        kept = self.scoped().drop("scope", "serialized")
        missing = catalog.preflight(kept.limit(0), wanted, present)
        return all_findings([missing, catalog.catalog_findings(kept, self.safe_engines), *self.more])

    def scoped(self) -> DataFrame:
        return selection.resolve_scopes(self.selected(), self.drop, self.schema_only)

    def run(self, target: str) -> tuple[DataFrame, DataFrame]:
        """Export to ``target``; returns the manifest and the warnings. Errors stop it before anything is written."""
        found = self.preflight()
        refuse_on(found.where("severity = 'error'"), PREFLIGHT_RULES)
        manifest = Snapshot(self.spark, self.scoped(), self.reader, **self.options).export(target)
        return manifest, found.where("severity = 'warning'")
