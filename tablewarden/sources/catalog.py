"""Catalogs as tables: of a database server through JDBC or from dumped files, or of the Spark session."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Reads one object: (session, database, table) -> rows.
Reader = Callable[[SparkSession, str, str], DataFrame]


def parquet_reader(root: str) -> Reader:
    """Tables stored as ``<root>/<table>.parquet``."""
    return lambda spark, database, table: spark.read.parquet(f"{root}/{table}.parquet")


def session_reader() -> Reader:
    return lambda spark, database, table: spark.table(f"`{database}`.`{table}`")


def session_catalog(spark: SparkSession, databases: Sequence[str]) -> DataFrame:
    """Tables and views of the session's own catalog; a table's engine is its provider."""

    def provider(db: str, table: str) -> str | None:
        told = spark.sql(f"DESCRIBE TABLE EXTENDED `{db}`.`{table}`").where("col_name = 'Provider'")
        return next((r.data_type for r in told.collect()), None)  # one row of metadata

    rows = [
        (db, t.name, "view" if t.tableType == "VIEW" else "base-table", None if t.tableType == "VIEW" else provider(db, t.name))
        for db in databases
        if spark.catalog.databaseExists(db)
        for t in spark.catalog.listTables(db)
        if not t.isTemporary
    ]
    return spark.createDataFrame(
        rows, "database_name string, table_name string, kind string, engine string"
    )


# Columns of the information-schema views that are read, all of them as text.
VIEWS = {
    "SCHEMATA": ("SCHEMA_NAME",),
    "TABLES": ("TABLE_SCHEMA", "TABLE_NAME", "TABLE_TYPE", "ENGINE", "TABLE_ROWS"),
    "STATISTICS": ("TABLE_SCHEMA", "TABLE_NAME", "NON_UNIQUE"),
    "TRIGGERS": ("EVENT_OBJECT_SCHEMA", "EVENT_OBJECT_TABLE"),
    "ROUTINES": ("ROUTINE_SCHEMA",),
    "EVENTS": ("EVENT_SCHEMA",),
}


def _facts(view: Callable[[str, str], DataFrame]) -> dict[str, DataFrame]:
    """The catalog's tables from a function that reads a view, given its database column."""
    keys = view("STATISTICS", "TABLE_SCHEMA").where(F.col("NON_UNIQUE").cast("int") == 0)
    return {
        "databases": view("SCHEMATA", "SCHEMA_NAME").select(
            F.col("SCHEMA_NAME").alias("database_name")
        ),
        "tables": view("TABLES", "TABLE_SCHEMA").select(
            F.col("TABLE_SCHEMA").alias("database_name"),
            F.col("TABLE_NAME").alias("table_name"),
            F.when(F.upper("TABLE_TYPE") == "VIEW", "view").otherwise("base-table").alias("kind"),
            F.col("ENGINE").alias("engine"),
            F.col("TABLE_ROWS").cast("decimal(20,0)").alias("estimated_rows"),
        ),
        "keys": keys.select(
            F.col("TABLE_SCHEMA").alias("database_name"), F.col("TABLE_NAME").alias("table_name")
        ),
        "triggers": view("TRIGGERS", "EVENT_OBJECT_SCHEMA").select(
            F.col("EVENT_OBJECT_SCHEMA").alias("database_name"),
            F.col("EVENT_OBJECT_TABLE").alias("table_name"),
        ),
        "routines": view("ROUTINES", "ROUTINE_SCHEMA").select(
            F.col("ROUTINE_SCHEMA").alias("database_name")
        ),
        "events": view("EVENTS", "EVENT_SCHEMA").select(
            F.col("EVENT_SCHEMA").alias("database_name")
        ),
    }


def jdbc_catalog(
    spark: SparkSession, url: str, databases: Sequence[str], **options: str
) -> dict[str, DataFrame]:
    """Information-schema tables of a server, filtered at the server by database.

    Needs the server's JDBC driver on the class path. Sizes of unsigned 64-bit columns arrive as
    decimals, never as doubles.
    """

    def view(name: str, database_column: str) -> DataFrame:
        return (
            spark.read.format("jdbc")
            .options(url=url, dbtable=f"information_schema.{name}", **options)
            .load()
            .where(F.col(database_column).isin(*databases))
        )

    return _facts(view)


def dumped_catalog(spark: SparkSession, folder: str, databases: Sequence[str]) -> dict[str, DataFrame]:
    """The same from a dump: for each view a folder ``<folder>/<VIEW>`` of JSON lines, one for each row.

    Values may be JSON texts or numbers; all are read as text, so 64-bit sizes keep their digits. The
    filter on databases goes to the reader, which drops a line before it makes a row of it.
    """

    def view(name: str, database_column: str) -> DataFrame:
        schema = ", ".join(f"{c} string" for c in VIEWS[name])
        return spark.read.schema(schema).json(f"{folder}/{name}").where(F.col(database_column).isin(*databases))

    return _facts(view)
