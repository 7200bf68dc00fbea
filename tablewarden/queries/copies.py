"""Queries on export, restore and comparison of copies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.findings import all_findings
from tablewarden.operators import catalog, naming, reconcile, selection
from tablewarden.plans.restore import Restore
from tablewarden.plans.snapshot import Snapshot, object_path
from tablewarden.queries import common as c
from tablewarden.sources.catalog import parquet_reader
from tablewarden.sources.folders import Folders

SOURCE = "shop"
DROP = ("shop.labels",)
SCHEMA_ONLY = ("shop.bench*",)
VIEW = "big_orders"
CHECKED = ("lineitem", "orders", "customer")
SCALE = 2


def _objects(spark: SparkSession, tables) -> DataFrame:
    rows = [(SOURCE, t, "base-table", None) for t in tables]
    return spark.createDataFrame(
        rows, "database_name string, table_name string, kind string, definition string"
    )


def export_restore_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip of all tables and a view: export, verify, publish, restore renamed, reconcile."""
    definition = "SELECT * FROM {database}.orders WHERE o_totalprice > 100000"
    view = spark.createDataFrame(
        [(SOURCE, VIEW, "view", definition)],
        "database_name string, table_name string, kind string, definition string",
    )
    objects = _objects(spark, c.TABLES).unionByName(view)
    scoped = selection.resolve_scopes(objects, DROP, SCHEMA_ONLY)
    folder = session.scratch_dir(spark, "round-trip")
    artifact = f"{folder}/shop-artifact"
    Snapshot(spark, scoped, parquet_reader(sf)).export(artifact)
    destination = f"restored_{uuid.uuid4().hex}"
    restore = Restore(spark, artifact, SOURCE, destination, location=f"{folder}/restored")
    try:
        restored = restore.apply(lambda plan: plan.restored_objects == 14)
        counted = restored.drop("database_name").collect()  # one row per table
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{destination}` CASCADE")
        Folders(spark).delete(folder)
    back = spark.createDataFrame(counted, restored.drop("database_name").schema)
    counts = [
        c.table(spark, sf, t).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(t))
        for t in c.TABLES
    ]
    rows = counts[0]
    for part in counts[1:]:
        rows = rows.unionByName(part)
    source = (
        objects.select("table_name", "kind")
        .join(scoped.select("table_name", "scope"), "table_name", "left")
        .na.fill("EXCLUDED", ["scope"])
        .join(rows, "table_name", "left")
    )
    return reconcile.reconcile(source, back, ["table_name"]).select(
        "table_name", "scope", "source_rows", "restored_rows", "status"
    )


EXPORT_RESTORE_COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, "
    + {"labels": "'EXCLUDED'", "benchmark": "'SCHEMA'"}.get(t, "'ALL'")
    + " AS scope, count(*) AS source_rows, "
    + {"labels": "NULL", "benchmark": "0"}.get(t, "count(*)")
    + " AS restored_rows, "
    + {"labels": "'excluded'", "benchmark": "'schema-only'"}.get(t, "'match'")
    + f" AS status FROM {t}"
    for t in c.TABLES
) + f"\nUNION ALL SELECT '{VIEW}', 'ALL', NULL, NULL, 'match'"


def table_checksum(spark: SparkSession, sf: str) -> DataFrame:
    """Exact checksums taken while exporting and again from the copy; a portable one of each side."""
    folder = session.scratch_dir(spark, "checksum")
    objects = selection.resolve_scopes(_objects(spark, CHECKED))
    artifact = f"{folder}/shop-checksum"
    manifest = Snapshot(spark, objects, parquet_reader(sf), with_checksum=True).export(artifact)

    def measured(name: str, df: DataFrame) -> DataFrame:
        portable = reconcile.portable_row_hash(df, SCALE)
        return df.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("rows"),
            reconcile.portable_sum(portable).alias("portable"),
            reconcile.hash_sum(reconcile.row_hash(df)).alias("exact"),
        )

    source = all_findings([measured(t, c.table(spark, sf, t)) for t in CHECKED])
    copy = all_findings(
        [measured(t, spark.read.parquet(object_path(artifact, SOURCE, t))) for t in CHECKED]
    )
    compared = (
        manifest.select("table_name", "checksum")
        .join(source.select("table_name", "rows", F.col("portable").alias("checksum_before")), "table_name")
        .join(copy.select("table_name", F.col("portable").alias("checksum_after"), "exact"), "table_name")
        .select(
            "table_name",
            "rows",
            "checksum_before",
            "checksum_after",
            (F.col("checksum") == F.col("exact")).alias("exact_match"),
        )
    )
    rows = compared.collect()  # one per table; then the copy can go
    Folders(spark).delete(folder)
    return spark.createDataFrame(rows, compared.schema)


def _md5_sql(table: str, columns: list[str]) -> str:
    parts = ", ".join(f"coalesce({x}, '\\N')" for x in columns)
    sums = " || '-' || ".join(f"sum(cast(cast('0x' || substr(h, {8 * n + 1}, 8) AS bigint) AS hugeint))" for n in range(4))
    return f"""
SELECT '{table}' AS table_name, count(*) AS rows, {sums} AS checksum_before, {sums} AS checksum_after, true AS exact_match
FROM (SELECT md5(concat_ws('|', {parts})) AS h FROM {table}) x"""


def _text(name: str) -> str:
    return f"cast({name} AS varchar)"


def _money(name: str) -> str:
    return f"cast(cast(round({name} * 100) AS bigint) AS varchar)"


def _time(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f')"


TABLE_CHECKSUM = "\nUNION ALL".join(
    [
        _md5_sql(
            "lineitem",
            [
                *map(_text, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
                *map(_money, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
                *map(_text, ("l_returnflag", "l_linestatus")),
                _time("l_shipdate"),
            ],
        ),
        _md5_sql(
            "orders",
            [
                *map(_text, ("o_orderkey", "o_custkey", "o_orderstatus")),
                _money("o_totalprice"),
                _time("o_orderdate"),
                _text("o_orderpriority"),
            ],
        ),
        _md5_sql(
            "customer",
            [
                *map(_text, ("c_custkey", "c_name", "c_nationkey")),
                _money("c_acctbal"),
                _text("c_mktsegment"),
            ],
        ),
    ]
)


def row_difference(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = c.table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return reconcile.row_surplus(lineitem, reconcile.first_per_key(lineitem, keys))


_LINE_COLUMNS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)
ROW_DIFFERENCE = f"""
WITH d AS (SELECT {_LINE_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) x WHERE rn = 1)
SELECT {_LINE_COLUMNS}, count(*) AS surplus
FROM (SELECT {_LINE_COLUMNS} FROM lineitem EXCEPT ALL SELECT {_LINE_COLUMNS} FROM d) s GROUP BY ALL
"""


def keyed_difference(spark: SparkSession, sf: str) -> DataFrame:
    orders = c.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    copy = orders.where(key % 103 != 0).select(
        F.when(key % 107 == 0, key + 100_000_000).otherwise(key).alias("o_orderkey"),
        "o_custkey",
        F.when(key % 101 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 97 == 0, F.col("o_totalprice") + 1)
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )
    found = reconcile.keyed_difference(*reconcile.narrowed(orders, copy, ["o_orderkey"]), ["o_orderkey"])
    return found.select(
        "o_orderkey", "status", F.array_join("columns", ",").alias("columns")
    )


KEYED_DIFFERENCE = """
SELECT o_orderkey, CASE WHEN o_orderkey % 103 = 0 OR o_orderkey % 107 = 0 THEN 'left-only' ELSE 'changed' END AS status,
       CASE WHEN o_orderkey % 103 <> 0 AND o_orderkey % 107 <> 0 THEN
         concat_ws(',', CASE WHEN o_orderkey % 101 = 0 THEN 'o_orderstatus' END,
                   CASE WHEN o_orderkey % 97 = 0 THEN 'o_totalprice' END) END AS columns
FROM orders WHERE o_orderkey % 103 = 0 OR o_orderkey % 107 = 0 OR o_orderkey % 101 = 0 OR o_orderkey % 97 = 0
UNION ALL
SELECT o_orderkey + 100000000, 'right-only', NULL FROM orders WHERE o_orderkey % 107 = 0 AND o_orderkey % 103 <> 0
"""


def restore_policy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer as a destination holding its orders, under every pair of policies."""
    key = F.col("c_custkey")
    held = c.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n")
    )
    policies = F.array(
        *[
            F.named_struct(F.lit("d"), F.lit(d), F.lit("o"), F.lit(o))
            for d in ("require-empty", "allow-existing")
            for o in ("reject", "drop", "truncate", "delete")
        ]
    )
    destinations = (
        c.table(spark, sf, "customer")
        .select("c_custkey")
        .join(held, "c_custkey", "left")
        .select(
            "c_custkey",
            F.when(key % 50 == 0, "Sys")
            .when(key % 50 == 1, "")
            .otherwise(F.concat(F.lit("db"), key.cast("string")))
            .alias("database"),
            F.when(key % 50 == 2, "007")
            .when(key % 50 == 3, "9007199254740993")
            .otherwise(F.coalesce("n", F.lit(0)).cast("string"))
            .alias("objects"),
            (key % 2).cast("string").alias("log_bin"),
            F.when(key % 60 == 0, "x").otherwise((key % 3).cast("string")).alias("session_log_bin"),
            F.when(key % 4 < 2, "enable").otherwise("disable").alias("binlog_policy"),
            F.explode(policies).alias("p"),
        )
        .select(
            "*",
            F.col("p.d").alias("destination_policy"),
            F.col("p.o").alias("overwrite_policy"),
        )
    )
    return destinations.select(
        "c_custkey",
        "destination_policy",
        "overwrite_policy",
        c.rule_names([*catalog.destination_rules(), *catalog.binlog_rules()]).alias("rules"),
    )


RESTORE_POLICY_MATRIX = """
WITH d AS (
  SELECT c_custkey, CASE c_custkey % 50 WHEN 0 THEN 'Sys' WHEN 1 THEN '' ELSE 'db' || c_custkey END AS db,
         CASE c_custkey % 50 WHEN 2 THEN '007' WHEN 3 THEN '9007199254740993' ELSE cast(count(o_orderkey) AS varchar) END AS n,
         c_custkey % 2 AS lb, CASE WHEN c_custkey % 60 = 0 THEN 'x' ELSE cast(c_custkey % 3 AS varchar) END AS sb,
         CASE WHEN c_custkey % 4 < 2 THEN 'enable' ELSE 'disable' END AS bp
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
p AS (SELECT * FROM (VALUES ('require-empty'), ('allow-existing')) a(dp) CROSS JOIN
      (VALUES ('reject'), ('drop'), ('truncate'), ('delete')) b(op))
SELECT c_custkey, dp AS destination_policy, op AS overwrite_policy, concat_ws(',',
  CASE WHEN db = '' THEN 'invalid-destination' END, CASE WHEN db = 'Sys' THEN 'system-destination' END,
  CASE WHEN op <> 'reject' AND dp <> 'allow-existing' THEN 'overwrite-needs-existing' END,
  CASE WHEN n IN ('007', '9007199254740993') THEN 'invalid-object-count' END,
  CASE WHEN n NOT IN ('0', '007', '9007199254740993') AND dp = 'require-empty' THEN 'destination-not-empty' END,
  CASE WHEN sb NOT IN ('0', '1') THEN 'invalid-binlog-value' END,
  CASE WHEN bp = 'enable' AND (lb = 0 OR sb = '0') THEN 'binlog-unavailable' END,
  CASE WHEN bp = 'disable' AND sb = '1' THEN 'binlog-not-disabled' END) AS rules
FROM d CROSS JOIN p
"""


def artifact_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dated artifacts, named after customer and status; several keys per customer."""
    from tablewarden.functions import names

    base = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    listing = c.table(spark, sf, "orders").select(
        names.dated_name(
            F.concat_ws("-", base, F.lower("o_orderstatus")), F.col("o_orderdate")
        ).alias("name")
    )
    endings = F.array(*[F.lit(e) for e in ("", "-f", "-o", "-p", "-x")])
    keys = c.table(spark, sf, "customer").select(
        F.col("c_custkey"), F.explode(endings).alias("ending")
    ).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), "ending").alias("id"))
    picked = naming.pick_artifacts(keys, listing).withColumn("name", F.lit(None).cast("string"))
    several = naming.artifact_candidates(keys, listing).join(picked.where("matches > 1").select("id"), "id", "left_semi")
    return picked.unionByName(several, allowMissingColumns=True)


ARTIFACT_PICK = """
WITH n AS (SELECT DISTINCT o_custkey, 'c' || o_custkey || '-' || lower(o_orderstatus) || '-' ||
                  strftime(o_orderdate, '%Y-%m-%d') AS name FROM orders),
k AS (SELECT c_custkey, 'c' || c_custkey || e AS id FROM customer CROSS JOIN (VALUES (''), ('-f'), ('-o'), ('-p'), ('-x')) v(e)),
f AS (SELECT id, name FROM k LEFT JOIN n ON o_custkey = c_custkey AND starts_with(name, id || '-')),
m AS (SELECT id, count(name) AS matches, min(name) AS first FROM f GROUP BY id)
SELECT id, matches, CASE WHEN matches = 1 THEN first END AS path, NULL AS name FROM m
UNION ALL
SELECT id, NULL, NULL, name FROM f WHERE id IN (SELECT id FROM m WHERE matches > 1)
"""

QUERIES = {
    "export_restore_counts": export_restore_counts,
    "table_checksum": table_checksum,
    "row_difference": row_difference,
    "keyed_difference": keyed_difference,
    "restore_policy_matrix": restore_policy_matrix,
    "artifact_pick": artifact_pick,
}
ORACLES = {
    "export_restore_counts": EXPORT_RESTORE_COUNTS,
    "table_checksum": TABLE_CHECKSUM,
    "row_difference": ROW_DIFFERENCE,
    "keyed_difference": KEYED_DIFFERENCE,
    "restore_policy_matrix": RESTORE_POLICY_MATRIX,
    "artifact_pick": ARTIFACT_PICK,
}
