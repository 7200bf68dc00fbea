"""Queries on catalogs, grants and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.findings import Rule, all_findings, check
from tablewarden.operators import catalog, grants, selection, settings
from tablewarden.queries import common as c
from tablewarden.sources.catalog import dumped_catalog

PATTERNS = (
    "economy.red*",
    "*.*_?0",
    "promo.small_ring_1??",
    "standard.*",
    "nope.*",
    "l?rge.old*anvil_*",
    "unqualified",
    ".table",
    "database.",
)
WELL_FORMED = PATTERNS[:6]
DROP = ("*.red_*", "economy.old*")
SCHEMA_ONLY = ("promo.*", "*.*_?5", "*.red_gear_*")
DATABASES = ("economy", "promo", "standard", "large")
WANTED = ("economy", "promo", "small", "medium", "large", "standard", "archive")


def glob_select(spark: SparkSession, sf: str) -> DataFrame:
    objects = c.view(spark, sf, c.OBJECTS)
    chosen = selection.select_tables(objects, WELL_FORMED).select(
        F.lit("selected").alias("kind"),
        F.concat_ws(".", "database_name", "table_name").alias("subject"),
        F.array_join("patterns", "|").alias("detail"),
    )
    hits = selection.pattern_hits(objects, WELL_FORMED).select(
        F.lit("matches").alias("kind"),
        F.col("pattern").alias("subject"),
        F.col("matches").cast("string").alias("detail"),
    )
    findings = all_findings(
        [
            selection.malformed_patterns(spark, PATTERNS),
            selection.unmatched_patterns(objects, PATTERNS),
        ]
    ).select(F.col("rule").alias("kind"), "subject", "detail")
    return all_findings([chosen, hits, findings])


GLOB_SELECT = f"""
WITH o AS ({c.OBJECTS}),
m AS (
  SELECT database_name || '.' || table_name AS subject, 1 AS n, 'economy.red*' AS pattern FROM o
  WHERE database_name = 'economy' AND starts_with(table_name, 'red')
  UNION ALL SELECT database_name || '.' || table_name, 2, '*.*_?0' FROM o WHERE regexp_matches(table_name, '^.*_.0$')
  UNION ALL SELECT database_name || '.' || table_name, 3, 'promo.small_ring_1??' FROM o
  WHERE database_name = 'promo' AND regexp_matches(table_name, '^small_ring_1..$')
  UNION ALL SELECT database_name || '.' || table_name, 4, 'standard.*' FROM o WHERE database_name = 'standard'
  UNION ALL SELECT database_name || '.' || table_name, 6, 'l?rge.old*anvil_*' FROM o
  WHERE database_name = 'large' AND regexp_matches(table_name, '^old.*anvil_.*$'))
SELECT 'selected' AS kind, subject, string_agg(pattern, '|' ORDER BY n) AS detail FROM m GROUP BY subject
UNION ALL
SELECT 'matches', p.pattern, cast((SELECT count(*) FROM m WHERE m.pattern = p.pattern) AS varchar)
FROM (VALUES ('economy.red*'), ('*.*_?0'), ('promo.small_ring_1??'), ('standard.*'), ('nope.*'), ('l?rge.old*anvil_*')) p(pattern)
UNION ALL
SELECT 'malformed-pattern', p, 'pattern must be qualified as database.table'
FROM (VALUES ('unqualified'), ('.table'), ('database.')) q(p)
UNION ALL
SELECT 'unmatched-pattern', p, 'pattern matched nothing'
FROM (VALUES ('economy.red*'), ('*.*_?0'), ('promo.small_ring_1??'), ('standard.*'), ('nope.*'), ('l?rge.old*anvil_*')) q(p)
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.pattern = q.p)
"""


# Patterns by the thousand: whole names, beginnings, endings, single characters, and some without a letter.
PATTERN_TABLE = """
SELECT DISTINCT CASE p_partkey % 6
         WHEN 0 THEN concat(lower(p_type), '.', t)
         WHEN 1 THEN concat(substr(lower(p_type), 1, 3), '*.', substr(t, 1, 9), '*')
         WHEN 2 THEN concat('*.*_', cast(p_partkey AS string))
         WHEN 3 THEN concat(lower(p_type), '.?', substr(t, 2, 8), '*', substr(t, -2))
         WHEN 4 THEN concat('*', substr(lower(p_type), -3), '.', substr(t, 1, 12), '??')
         ELSE concat(substr(t, 1, 4), '.') END AS pattern
FROM (SELECT *, concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS string)) AS t FROM part) p
WHERE p_partkey % 7 < 3
"""


def glob_table(spark: SparkSession, sf: str) -> DataFrame:
    return selection.match_pattern_table(c.view(spark, sf, c.OBJECTS), c.view(spark, sf, PATTERN_TABLE))


GLOB_TABLE = f"""
SELECT pattern, database_name, table_name FROM ({PATTERN_TABLE}) p
JOIN ({c.OBJECTS}) o
  ON regexp_full_match(database_name, replace(replace(split_part(pattern, '.', 1), '*', '.*'), '?', '.'))
 AND regexp_full_match(table_name, replace(replace(split_part(pattern, '.', 2), '*', '.*'), '?', '.'))
WHERE split_part(pattern, '.', 2) <> ''
"""


def scope_resolve(spark: SparkSession, sf: str) -> DataFrame:
    objects = c.view(spark, sf, c.OBJECTS)
    here = selection.in_databases(selection.of_kinds(objects, include_views=False), DATABASES)
    # A property of the part, told by all of its lines.
    sold = c.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("most")).where("most > 40")
    wanted = objects.join(sold, F.col("object_id") == F.col("l_partkey"), "left_semi")
    unwanted = objects.where(F.col("object_id") % 9 == 0)
    kept = selection.without(selection.only_named(here, wanted), unwanted)
    return selection.resolve_scopes(kept, DROP, SCHEMA_ONLY, within=objects).select(
        "object_id", "scope", "serialized"
    )


SCOPE_RESOLVE = f"""
SELECT object_id,
       CASE WHEN database_name = 'promo' OR regexp_matches(table_name, '_.5$') OR starts_with(table_name, 'red_gear_')
            THEN 'SCHEMA' ELSE 'ALL' END AS scope,
       '`' || database_name || '`.`' || table_name || '`' AS serialized
FROM ({c.OBJECTS}) o
WHERE kind <> 'view' AND database_name IN ('economy', 'promo', 'standard', 'large') AND object_id % 9 <> 0
  AND object_id IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING max(l_quantity) > 40)
  AND NOT starts_with(table_name, 'red_') AND NOT (database_name = 'economy' AND starts_with(table_name, 'old'))
"""


def identifier_findings(spark: SparkSession, sf: str) -> DataFrame:
    objects = c.view(spark, sf, c.OBJECTS).select(
        "database_name",
        F.when(F.col("object_id") % 17 == 0, F.concat(F.lit("tablewarden_"), "table_name"))
        .when(F.col("object_id") % 23 == 0, F.concat("table_name", F.lit("$")))
        .otherwise(F.col("table_name"))
        .alias("table_name"),
    )
    pages = c.table(spark, sf, "pages").select(
        F.when(F.col("page_id") % 7 == 0, "we`b").otherwise("web").alias("database_name"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("`"), "url"))
        .otherwise(F.col("url"))
        .alias("table_name"),
    )
    return selection.identifier_findings(objects.unionByName(pages))


IDENTIFIER_FINDINGS = f"""
WITH n AS (
  SELECT database_name, CASE WHEN object_id % 17 = 0 THEN 'tablewarden_' || table_name
         WHEN object_id % 23 = 0 THEN table_name || '$' ELSE table_name END AS table_name FROM ({c.OBJECTS}) o
  UNION ALL
  SELECT CASE WHEN page_id % 7 = 0 THEN 'we`b' ELSE 'web' END, CASE WHEN page_id % 5 = 0 THEN '`' || url ELSE url END
  FROM pages),
e AS (SELECT 'database' AS kind, database_name AS name FROM n UNION ALL SELECT 'table', table_name FROM n)
SELECT 'backtick-in-section' AS rule, name AS subject, 'error' AS severity,
       kind || ' name cannot head a manifest section' AS detail FROM e WHERE contains(name, '`')
UNION ALL
SELECT 'unsafe-identifier', name, 'error', 'unsupported ' || kind || ' name' FROM e
WHERE NOT regexp_full_match(name, '[A-Za-z0-9_-]+') OR starts_with(name, 'tablewarden_')
"""


def catalog_preflight(spark: SparkSession, sf: str) -> DataFrame:
    objects = c.view(spark, sf, c.OBJECTS)
    # Properties told by all lines of a part and all orders of a customer.
    keys = (
        c.table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("object_id"))
        .agg(F.min("l_linenumber").alias("first"))
        .where("first = 1")
    )
    triggers = (
        c.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("object_id"))
        .agg(F.bool_or(F.col("o_orderstatus") == "F").alias("finished"))
        .where("finished")
    )
    marked = catalog.mark_existence(objects, ["object_id"], keys, "has_key")
    marked = catalog.mark_existence(marked, ["object_id"], triggers, "has_triggers")
    wanted = spark.createDataFrame([(d,) for d in WANTED], "database_name string")
    s = F.col("s_suppkey")
    servers = c.table(spark, sf, "supplier").select(
        F.col("s_name").alias("server"),
        F.when(s % 4 == 0, F.concat(F.lit("8.0."), s.cast("string")))
        .when(s % 4 == 1, "10.6.1-MariaDB")
        .when(s % 4 == 2, "5.7.1")
        .otherwise("8.4.0")
        .alias("version"),
        F.when(s % 8 == 3, "mariadb build").otherwise("community").alias("version_comment"),
    )
    routines = c.table(spark, sf, "supplier").select(
        F.when(s % 3 == 0, "economy").when(s % 3 == 1, "promo").otherwise("small").alias("database_name")
    )
    events = c.table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, "medium").otherwise("large").alias("database_name")
    )
    counts = catalog.object_counts(wanted, objects, routines, events).select(
        F.lit("object-count").alias("rule"),
        F.col("database_name").alias("subject"),
        F.lit("info").alias("severity"),
        F.col("objects").cast("string").alias("detail"),
    )
    with_triggers = (
        marked.where("has_triggers")
        .groupBy("database_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.lit("trigger-tables").alias("rule"),
            F.col("database_name").alias("subject"),
            F.lit("info").alias("severity"),
            F.col("n").cast("string").alias("detail"),
        )
    )
    present = objects.select("database_name")
    found = catalog.preflight(marked, wanted, present, servers)
    return all_findings([found, counts, with_triggers])


CATALOG_PREFLIGHT = f"""
WITH o AS ({c.OBJECTS}),
m AS (SELECT *, object_id IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING min(l_linenumber) = 1) AS has_key,
             object_id IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F')) AS has_triggers FROM o),
w AS (SELECT * FROM (VALUES ('economy'), ('promo'), ('small'), ('medium'), ('large'), ('standard'), ('archive')) v(d)),
s AS (SELECT s_name, CASE s_suppkey % 4 WHEN 0 THEN '8.0.' || s_suppkey WHEN 1 THEN '10.6.1-MariaDB' WHEN 2 THEN '5.7.1'
             ELSE '8.4.0' END AS v, CASE WHEN s_suppkey % 8 = 3 THEN 'mariadb build' ELSE 'community' END AS cm FROM supplier),
p AS (SELECT s_name, CASE WHEN v || ' ' || cm ILIKE '%mariadb%' THEN 'mariadb' WHEN v LIKE '8.%' THEN 'mysql'
             ELSE 'unknown' END AS product FROM s),
k AS (SELECT database_name AS d FROM o
      UNION ALL SELECT CASE s_suppkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'promo' ELSE 'small' END FROM supplier
      UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'medium' ELSE 'large' END FROM customer)
SELECT 'missing-database' AS rule, d AS subject, 'error' AS severity, 'selected database does not exist' AS detail
FROM w WHERE d NOT IN (SELECT database_name FROM o)
UNION ALL
SELECT 'unsafe-engine', database_name || '.' || table_name, 'error', 'engine ' || coalesce(engine, 'unknown') FROM m
WHERE kind = 'base-table' AND (engine IS NULL OR upper(engine) <> 'INNODB')
UNION ALL
SELECT 'keyless-table', database_name || '.' || table_name, 'warning', 'base table without a unique key' FROM m
WHERE kind = 'base-table' AND NOT has_key
UNION ALL
SELECT 'unqualified-product', s_name, 'error', 'refused product ' || product FROM p WHERE product <> 'mysql'
UNION ALL
SELECT 'object-count', w.d, 'info', cast((SELECT count(*) FROM k WHERE k.d = w.d) AS varchar) FROM w
UNION ALL
SELECT 'trigger-tables', database_name, 'info', cast(count(*) AS varchar) FROM m WHERE has_triggers GROUP BY database_name
"""


# A server's catalog as text, with sizes that no double holds.
DUMPED_TABLES = f"""
SELECT database_name AS "TABLE_SCHEMA", table_name AS "TABLE_NAME",
       CASE kind WHEN 'view' THEN 'VIEW' ELSE 'BASE TABLE' END AS "TABLE_TYPE", engine AS "ENGINE",
       CASE WHEN kind = 'view' THEN NULL WHEN object_id % 9 = 0 THEN '18446744073709551615' ELSE cast(object_id AS string) END AS "TABLE_ROWS",
       object_id
FROM ({c.OBJECTS}) o
"""


def catalog_from_dump(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog dumped as JSON lines, read back for some databases: tables with keys and triggers, and objects by database."""
    folder = session.scratch_dir(spark, "dump")
    tables = c.view(spark, sf, DUMPED_TABLES.replace('"', "`"))
    schema, table, key = F.col("TABLE_SCHEMA"), F.col("TABLE_NAME"), F.col("object_id")
    dumped = {
        "SCHEMATA": tables.select(schema.alias("SCHEMA_NAME")).distinct(),
        "TABLES": tables.drop("object_id"),
        "STATISTICS": tables.where(key % 3 != 0).select(schema, table, (key % 2).alias("NON_UNIQUE")),
        "TRIGGERS": tables.where(key % 5 == 0).select(schema.alias("EVENT_OBJECT_SCHEMA"), table.alias("EVENT_OBJECT_TABLE")),
        "ROUTINES": tables.where(key % 7 == 0).select(schema.alias("ROUTINE_SCHEMA")),
        "EVENTS": tables.where(key % 11 == 0).select(schema.alias("EVENT_SCHEMA")),
    }
    for name, rows in dumped.items():
        rows.write.json(f"{folder}/{name}")
    facts = dumped_catalog(spark, folder, DATABASES)
    names = ["database_name", "table_name"]
    marked = catalog.mark_existence(facts["tables"], names, facts["keys"], "has_key")
    marked = catalog.mark_existence(marked, names, facts["triggers"], "has_triggers")
    counted = catalog.object_counts(facts["databases"], facts["tables"], facts["routines"], facts["events"])
    return marked.join(counted, "database_name").select(
        *names, "kind", "engine", F.col("estimated_rows").cast("string").alias("estimated_rows"), "has_key", "has_triggers", "objects"
    )


CATALOG_FROM_DUMP = f"""
WITH t AS ({DUMPED_TABLES}),
n AS (SELECT "TABLE_SCHEMA" AS d, count(*) + count(*) FILTER (object_id % 7 = 0) + count(*) FILTER (object_id % 11 = 0) AS objects FROM t GROUP BY 1)
SELECT "TABLE_SCHEMA" AS database_name, "TABLE_NAME" AS table_name,
       CASE "TABLE_TYPE" WHEN 'VIEW' THEN 'view' ELSE 'base-table' END AS kind, "ENGINE" AS engine, "TABLE_ROWS" AS estimated_rows,
       object_id % 3 <> 0 AND object_id % 2 = 0 AS has_key, object_id % 5 = 0 AS has_triggers, objects
FROM t JOIN n ON d = "TABLE_SCHEMA" WHERE d IN ({", ".join(f"'{d}'" for d in DATABASES)})
"""


def _parsed_grants(spark: SparkSession, sf: str) -> DataFrame:
    return grants.parse_grants(c.view(spark, sf, c.GRANTS).drop("database_name"))


def grant_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed_grants(spark, sf).select(
        "grantee", "stmt", "understood", "action", F.array_join("privileges", ",").alias("privileges"), "database"
    )


def granted_privileges(spark: SparkSession, sf: str) -> DataFrame:
    """What each account holds, one row per privilege, and whether a run needs it."""
    held = grants.granted_set(_parsed_grants(spark, sf), "grantee")
    return held.withColumn("needed", grants.is_one_of(grants.required_data("mysql", "auto"), F.col("privilege")))


# The statements read: what they grant, and where.
PARSED_GRANTS = rf"""
SELECT grantee, stmt, NOT contains(stmt, '.`t`') AS understood,
       CASE WHEN NOT contains(stmt, '.`t`') THEN split_part(stmt, ' ', 1) END AS action,
       CASE WHEN NOT contains(stmt, '.`t`') THEN
         regexp_extract(stmt, '^(?:GRANT|REVOKE) (.*) ON ', 1) END AS listed,
       CASE WHEN NOT contains(stmt, '.`t`') AND NOT contains(stmt, '*.*') THEN
         replace(regexp_extract(stmt, '`(.*)`', 1), '\_', '_') END AS database
FROM ({c.GRANTS}) g
"""

GRANT_PARSE = f"""
SELECT grantee, stmt, understood, action, replace(listed, ', ', ',') AS privileges, database FROM ({PARSED_GRANTS}) p
"""

GRANTED_PRIVILEGES = f"""
SELECT DISTINCT grantee, item AS privilege, item IN ('SELECT', 'SHOW VIEW', 'TRIGGER') AS needed
FROM (SELECT grantee, unnest(string_split(listed, ', ')) AS item FROM ({PARSED_GRANTS}) p WHERE action = 'GRANT') x
"""


def privilege_gaps(spark: SparkSession, sf: str) -> DataFrame:
    accounts = c.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grantee"))
    databases = c.table(spark, sf, "nation").select(F.col("n_name").alias("database")).distinct()
    return grants.privilege_gaps(
        accounts,
        _parsed_grants(spark, sf),
        databases,
        grants.required_global("mysql", "auto", "replica"),
        grants.required_data("mysql", "auto"),
    )


PRIVILEGE_GAPS = f"""
WITH g AS (SELECT grantee, action, database, unnest(string_split(listed, ', ')) AS item
           FROM ({PARSED_GRANTS}) p WHERE understood),
n AS (SELECT * FROM (VALUES ('RELOAD', true), ('PROCESS', true), ('BACKUP_ADMIN', true), ('REPLICATION CLIENT', true),
                            ('SELECT', false), ('SHOW VIEW', false), ('TRIGGER', false)) v(privilege, everywhere)),
lack AS (
  SELECT s_suppkey AS grantee, privilege, everywhere
  FROM supplier CROSS JOIN n CROSS JOIN nation d
  WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.grantee = s_suppkey AND action = 'GRANT' AND item IN (privilege, 'ALL PRIVILEGES')
                    AND (g.database IS NULL OR (NOT everywhere AND g.database = n_name)))
     OR (NOT everywhere AND EXISTS (SELECT 1 FROM g WHERE g.grantee = s_suppkey AND action = 'REVOKE'
                    AND item IN (privilege, 'ALL PRIVILEGES') AND g.database = n_name)))
SELECT grantee, privilege, everywhere, count(*) AS missing_databases FROM lack GROUP BY ALL
"""


def grant_visibility(spark: SparkSession, sf: str) -> DataFrame:
    requests = (
        c.view(spark, sf, c.GRANTS)
        .select("grantee", F.col("database_name").alias("database"))
        .distinct()
    )
    return grants.visibility(requests, _parsed_grants(spark, sf))


GRANT_VISIBILITY = f"""
WITH p AS ({PARSED_GRANTS}), r AS (SELECT DISTINCT grantee, database_name AS database FROM ({c.GRANTS}) g)
SELECT grantee, database,
       NOT EXISTS (SELECT 1 FROM p WHERE p.grantee = r.grantee AND action = 'REVOKE' AND p.database = r.database)
       AND EXISTS (SELECT 1 FROM p WHERE p.grantee = r.grantee AND action = 'GRANT' AND listed = 'ALL PRIVILEGES'
                   AND (p.database IS NULL OR p.database = r.database)) AS visible
FROM r
"""


def reference_integrity(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = c.table(spark, sf, "orders"), c.table(spark, sf, "customer")
    nation, region = c.table(spark, sf, "nation"), c.table(spark, sf, "region")
    shifted = orders.select(
        F.when(F.col("o_orderkey") % 101 == 0, F.col("o_custkey") + 10_000_000)
        .otherwise(F.col("o_custkey"))
        .alias("k")
    )
    moved = customer.select(
        F.when(F.col("c_custkey") % 50 == 0, F.col("c_nationkey") + 100)
        .otherwise(F.col("c_nationkey"))
        .alias("k")
    )
    known = all_findings(
        [
            settings.known_keys(r, k).select(
                F.lit("known-keys").alias("rule"),
                F.lit(n).alias("subject"),
                F.lit("info").alias("severity"),
                F.col("known").alias("detail"),
            )
            for n, r, k in (("region", region, "r_name"), ("nation", nation, "n_name"))
        ]
    )
    return all_findings(
        [
            settings.dangling_references(shifted, "k", customer, "c_custkey", "customer"),
            settings.dangling_references(moved, "k", nation, "n_nationkey", "nation"),
            settings.dangling_references(nation, "n_regionkey", region, "r_regionkey", "region"),
            known,
        ]
    )


REFERENCE_INTEGRITY = """
WITH o AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders),
m AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS k FROM customer)
SELECT 'unknown-customer' AS rule, cast(k AS varchar) AS subject, 'error' AS severity,
       'referred to by ' || count(*) || ' rows' AS detail
FROM o WHERE k NOT IN (SELECT c_custkey FROM customer) GROUP BY k
UNION ALL
SELECT 'unknown-nation', cast(k AS varchar), 'error', 'referred to by ' || count(*) || ' rows'
FROM m WHERE k NOT IN (SELECT n_nationkey FROM nation) GROUP BY k
UNION ALL
SELECT 'unknown-region', cast(n_regionkey AS varchar), 'error', 'referred to by ' || count(*) || ' rows'
FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) GROUP BY n_regionkey
UNION ALL
SELECT DISTINCT 'known-keys', 'region', 'info', r_name FROM region
UNION ALL
SELECT DISTINCT 'known-keys', 'nation', 'info', n_name FROM nation
"""


def user_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The user of a database (customer), else the one of its server (nation)."""
    customer = c.table(spark, sf, "customer")
    users = customer.select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias(
            "user"
        ),
    )
    servers = c.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("srv-"), "n_name")).alias("user"),
    )
    return settings.with_fallback(
        customer.select("c_custkey", "c_nationkey"), users, servers, "c_custkey", "c_nationkey", "user"
    ).select("c_custkey", "user")


USER_FALLBACK = """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'u' || c_custkey
       WHEN n_nationkey % 3 <> 0 THEN 'srv-' || n_name END AS user
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""

QUERIES = {
    "glob_table": glob_table,
    "catalog_from_dump": catalog_from_dump,
    "glob_select": glob_select,
    "scope_resolve": scope_resolve,
    "identifier_findings": identifier_findings,
    "catalog_preflight": catalog_preflight,
    "grant_parse": grant_parse,
    "granted_privileges": granted_privileges,
    "privilege_gaps": privilege_gaps,
    "grant_visibility": grant_visibility,
    "reference_integrity": reference_integrity,
    "user_fallback": user_fallback,
}
ORACLES = {
    "glob_table": GLOB_TABLE,
    "catalog_from_dump": CATALOG_FROM_DUMP,
    "glob_select": GLOB_SELECT,
    "scope_resolve": SCOPE_RESOLVE,
    "identifier_findings": IDENTIFIER_FINDINGS,
    "catalog_preflight": CATALOG_PREFLIGHT,
    "grant_parse": GRANT_PARSE,
    "granted_privileges": GRANTED_PRIVILEGES,
    "privilege_gaps": PRIVILEGE_GAPS,
    "grant_visibility": GRANT_VISIBILITY,
    "reference_integrity": REFERENCE_INTEGRITY,
    "user_fallback": USER_FALLBACK,
}
