"""Queries on artifact files and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.findings import all_findings
from tablewarden.operators import artifact
from tablewarden.queries import common as c

# Page paths as artifact paths, with unsafe ones planted.
PATHS = r"""
SELECT page_id, CASE WHEN page_id % 21 = 0 THEN ''
       WHEN page_id % 9 = 0 THEN concat(p, '/../../..') WHEN page_id % 13 = 0 THEN concat('/', p)
       WHEN page_id % 17 = 0 THEN concat('../', p) WHEN page_id % 19 = 0 THEN 'metadata.header'
       WHEN page_id % 23 = 0 THEN 'metadata.partial' WHEN page_id % 29 = 0 THEN 'metadata.partial.3'
       WHEN page_id % 31 = 0 THEN concat('tablewarden_', page_id) WHEN page_id % 37 = 0 THEN 'a/./../b/../c'
       WHEN page_id % 41 = 0 THEN '..hidden/x' ELSE p END AS file_name, p
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages) x
"""


def path_containment(spark: SparkSession, sf: str) -> DataFrame:
    return c.view(spark, sf, PATHS).select(
        "page_id", c.rule_names(artifact.file_rules()).alias("rules")
    )


PATH_CONTAINMENT = f"""
SELECT page_id, CASE
  WHEN file_name = '' OR starts_with(file_name, '/') OR starts_with(file_name, '..') THEN 'unsafe-path'
  WHEN file_name LIKE '%/../../..' AND len(list_filter(string_split(p, '/'), lambda x: x <> '')) < 3 THEN 'unsafe-path'
  WHEN file_name = 'metadata.partial' THEN 'control-file,incomplete-artifact'
  WHEN file_name LIKE 'metadata.%' OR starts_with(file_name, 'tablewarden_') THEN 'control-file' ELSE '' END AS rules
FROM ({PATHS}) f
"""

# The file view with names of every other kind.
ALL_FILES = f"""
SELECT file_name FROM ({c.FILES}) f
UNION ALL
SELECT concat('app.s', cast(s_suppkey AS string), CASE s_suppkey % 5 WHEN 0 THEN '-schema-triggers.sql.gz'
  WHEN 1 THEN '.00001.00002.dat.zst' WHEN 2 THEN '.x1.sql' WHEN 3 THEN '.12.dat' ELSE '.7.sql.bz2' END) FROM supplier
UNION ALL
SELECT concat('web', cast(s_suppkey AS string), '-schema-create.sql.zst') FROM supplier WHERE s_suppkey % 3 = 0
"""


def file_decode(spark: SparkSession, sf: str) -> DataFrame:
    return artifact.decode_files(c.view(spark, sf, ALL_FILES))


FILE_DECODE = f"""
WITH f AS (SELECT file_name, regexp_extract(file_name, '\\.(gz|zst)$', 1) AS z,
                  regexp_replace(file_name, '\\.(gz|zst)$', '') AS plain FROM ({ALL_FILES}) a),
g AS (SELECT *, regexp_replace(plain, '\\.(sql|dat)$', '') AS stem FROM f),
r AS (SELECT *, CASE WHEN plain LIKE '%-schema-create.sql' THEN 'create' WHEN plain LIKE '%-schema.sql' THEN 'schema'
       WHEN plain LIKE '%-schema-view.sql' THEN 'schema-view' WHEN plain LIKE '%-schema-triggers.sql' THEN 'schema-triggers'
       WHEN stem <> plain AND regexp_full_match(stem, 'app\\.s[0-9]+(\\.[0-9]+)+') THEN 'data' ELSE 'other' END AS role FROM g)
SELECT file_name, role, CASE WHEN role = 'create' THEN regexp_extract(file_name, '^([a-z0-9]+)-', 1)
       WHEN role <> 'other' THEN 'app' END AS database_name,
       CASE WHEN role IN ('data', 'schema', 'schema-view', 'schema-triggers')
            THEN regexp_extract(file_name, '^app\\.(s[0-9]+)', 1) END AS table_name,
       CASE WHEN role = 'data' THEN regexp_extract(stem, '^app\\.s[0-9]+\\.(.*)$', 1) END AS chunk,
       CASE WHEN z <> '' THEN z END AS codec
FROM r
"""

# Manifest text: several lines per supplier, in four artifacts, with repeated and loader sections.
MANIFEST_LINES = f"""
SELECT concat('artifact-', cast(s_suppkey % 4 AS string)) AS artifact, s_suppkey * 10 + n AS line_no,
       CASE n WHEN 0 THEN concat('[`app`.`', table_name, '`]') WHEN 1 THEN concat('rows = ', cast(declared_rows AS string))
         WHEN 2 THEN concat('is_view = ', cast(is_view AS string)) WHEN 3 THEN '' WHEN 4 THEN '# note'
         WHEN 5 THEN concat(' [`app`.`', table_name, '`] ') WHEN 6 THEN 'rows = 0'
         WHEN 7 THEN '[loader_session_variables_x]'
         ELSE CASE WHEN s_suppkey % 2 = 0 THEN ' sql_log_bin = 1' ELSE 'other = 1' END END AS line
FROM ({c.MANIFEST}) m CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
  UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) i
WHERE (n <> 1 OR declared_rows IS NOT NULL) AND (n NOT IN (5, 6) OR s_suppkey % 29 = 0) AND (n NOT IN (7, 8) OR s_suppkey % 31 = 0)
"""


def manifest_sections(spark: SparkSession, sf: str) -> DataFrame:
    lines = _manifest_lines(spark, sf)
    found = artifact.sections(artifact.assign_headings(lines))
    rows = found.select(
        F.lit("section").alias("kind"),
        F.concat_ws(" ", "artifact", "section_start", "heading").alias("subject"),
        F.concat_ws(
            " ",
            F.concat(F.lit("rows="), F.coalesce("declared_rows", F.lit("?"))),
            F.concat(F.lit("view="), F.coalesce("view_flag", F.lit("?"))),
            F.concat(F.lit("table="), F.coalesce("table_name", F.lit("?"))),
        ).alias("detail"),
    )
    findings = artifact.section_findings(found).select(F.col("rule").alias("kind"), "subject", "detail")
    return rows.unionByName(findings)


def _manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines view with each supplier's lines exploded instead of joined."""
    key, table_name = F.col("s_suppkey"), F.col("table_name")
    heading = F.concat(F.lit("[`app`.`"), table_name, F.lit("`]"))
    repeated, loader = key % 29 == 0, key % 31 == 0
    lines = {
        0: heading,
        1: F.concat(F.lit("rows = "), F.col("declared_rows").cast("string")),
        2: F.concat(F.lit("is_view = "), F.col("is_view").cast("string")),
        3: F.lit(""),
        4: F.lit("# note"),
        5: F.when(repeated, F.concat(F.lit(" "), heading, F.lit(" "))),
        6: F.when(repeated, F.lit("rows = 0")),
        7: F.when(loader, F.lit("[loader_session_variables_x]")),
        8: F.when(loader, F.when(key % 2 == 0, " sql_log_bin = 1").otherwise("other = 1")),
    }
    entries = F.array(
        *[F.named_struct(F.lit("n"), F.lit(n), F.lit("line"), line) for n, line in lines.items()]
    )
    return (
        c.view(spark, sf, c.MANIFEST)
        .select("s_suppkey", F.explode(entries).alias("e"))
        .where(F.col("e.line").isNotNull())
        .select(
            F.concat(F.lit("artifact-"), (F.col("s_suppkey") % 4).cast("string")).alias("artifact"),
            (F.col("s_suppkey") * 10 + F.col("e.n")).alias("line_no"),
            F.col("e.line").alias("line"),
        )
    )


MANIFEST_SECTIONS = f"""
WITH l AS ({MANIFEST_LINES}),
h AS (SELECT *, last_value(CASE WHEN trim(line) LIKE '[%]' THEN line_no END IGNORE NULLS)
                OVER (PARTITION BY artifact ORDER BY line_no) AS section_start FROM l),
s AS (SELECT artifact, section_start, trim(arg_min(line, line_no)) AS heading,
             arg_min(regexp_extract(line, '^rows = ([0-9]+)$', 1), line_no) FILTER (line LIKE 'rows = %') AS r,
             arg_min(regexp_extract(line, '^is_view = ([0-9]+)$', 1), line_no) FILTER (line LIKE 'is_view = %') AS v,
             count(*) FILTER (line LIKE '%sql_log_bin%') AS control
      FROM h WHERE section_start IS NOT NULL GROUP BY artifact, section_start)
SELECT 'section' AS kind, concat_ws(' ', artifact, section_start, heading) AS subject,
       'rows=' || coalesce(r, '?') || ' view=' || coalesce(v, '?') || ' table=' ||
       coalesce(nullif(regexp_extract(heading, '`\\.`(.*)`', 1), ''), '?') AS detail
FROM s
UNION ALL
SELECT 'binlog-override', artifact, heading FROM s WHERE heading LIKE '[loader%' AND control > 0
UNION ALL
SELECT 'duplicate-section', artifact || ' ' || heading, 'appears ' || count(*) || ' times'
FROM s WHERE heading LIKE '[`%' GROUP BY artifact, heading HAVING count(*) > 1
"""

# The manifest as read, and the selection it should describe.
DECLARED = f"""
SELECT database_name, table_name, s_suppkey AS section_start, cast(declared_rows AS string) AS declared_rows,
       CASE WHEN s_suppkey % 43 = 0 THEN '2' ELSE cast(is_view AS string) END AS view_flag
FROM ({c.MANIFEST}) m WHERE s_suppkey % 37 <> 0
"""
SELECTION = """
SELECT 'app' AS database_name, concat('s', cast(s_suppkey AS string)) AS table_name,
       CASE WHEN s_suppkey % 10 = 0 THEN 'view' ELSE 'base-table' END AS kind,
       CASE WHEN s_suppkey % 6 = 0 THEN 'SCHEMA' ELSE 'ALL' END AS scope, s_suppkey % 14 = 0 AS has_triggers
FROM supplier
UNION ALL
SELECT concat('db', cast(s_suppkey AS string)), 'extra', 'base-table', 'ALL', false FROM supplier WHERE s_suppkey % 33 = 0
"""


def artifact_verify(spark: SparkSession, sf: str) -> DataFrame:
    files = session.materialised(c.view(spark, sf, c.FILES), "files")
    manifest = session.materialised(c.view(spark, sf, DECLARED), "manifest")
    export = artifact.export_findings(session.materialised(c.view(spark, sf, SELECTION), "selection"), manifest, files)
    restore = artifact.restore_findings(manifest, files)
    reported = c.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    parts = {
        "export": export,
        "restore": restore,
        "files": all_findings(
            [
                artifact.file_findings(files),
                artifact.file_count_findings(files, reported),
                artifact.emptiness_findings(manifest, "app"),
                artifact.emptiness_findings(manifest, "nothing"),
            ]
        ),
    }
    return all_findings([df.withColumn("side", F.lit(n)) for n, df in parts.items()])


ARTIFACT_VERIFY = f"""
WITH f AS (SELECT DISTINCT regexp_replace(file_name, '\\.(gz|zst)$', '') AS n FROM ({c.FILES}) x),
m AS ({DECLARED}), o AS ({SELECTION}),
has AS (SELECT o.database_name || '.' || o.table_name AS subject, o.*, m.section_start, m.declared_rows, m.view_flag
        FROM o LEFT JOIN m ON o.database_name = m.database_name AND o.table_name = m.table_name),
fl AS (SELECT *, subject || '-schema.sql' IN (SELECT n FROM f) AS sch, subject || '-schema-view.sql' IN (SELECT n FROM f) AS vw,
              subject || '-schema-triggers.sql' IN (SELECT n FROM f) AS trg,
              subject IN (SELECT regexp_extract(n, '^(app\\.s[0-9]+)\\.[0-9]+\\.sql$', 1) FROM f) AS dat FROM has)
SELECT 'export' AS side, 'missing-create-file' AS rule, database_name AS subject, 'error' AS severity,
       'database has no create file' AS detail FROM o WHERE database_name <> 'app' GROUP BY database_name
UNION ALL SELECT 'export', 'missing-section', subject, 'error', 'not in the manifest' FROM fl WHERE section_start IS NULL
UNION ALL SELECT 'export', 'missing-schema', subject, 'error', 'no schema file' FROM fl WHERE NOT sch
UNION ALL SELECT 'export', 'missing-view', subject, 'error', 'no view definition' FROM fl WHERE kind = 'view' AND NOT vw
UNION ALL SELECT 'export', 'missing-triggers', subject, 'error', 'no trigger file' FROM fl WHERE has_triggers AND NOT trg
UNION ALL SELECT 'export', 'missing-row-count', subject, 'error', 'no row count' FROM fl
  WHERE kind <> 'view' AND scope <> 'SCHEMA' AND section_start IS NOT NULL AND declared_rows IS NULL
UNION ALL SELECT 'export', 'missing-data', subject, 'error', 'rows but no data file' FROM fl
  WHERE scope <> 'SCHEMA' AND declared_rows <> '0' AND NOT dat
UNION ALL SELECT 'restore', 'invalid-view-flag', subject, 'error', 'view flag 2' FROM fl WHERE view_flag = '2'
UNION ALL SELECT 'restore', 'missing-schema', subject, 'error', 'no schema file' FROM fl WHERE section_start IS NOT NULL AND NOT sch
UNION ALL SELECT 'restore', 'missing-view', subject, 'error', 'no view definition' FROM fl WHERE view_flag = '1' AND NOT vw
UNION ALL SELECT 'restore', 'unexpected-view', subject, 'error', 'view definition of a table' FROM fl WHERE view_flag <> '1' AND vw
UNION ALL SELECT 'restore', 'missing-data', subject, 'error', 'rows but no data file' FROM fl WHERE declared_rows <> '0' AND NOT dat
UNION ALL SELECT 'files', 'file-count', 'artifact', 'error',
  'expected ' || (SELECT count(*) FROM supplier) || ', found ' || (SELECT count(*) FROM ({c.FILES}) y)
UNION ALL SELECT 'files', 'empty-artifact', 'nothing', 'error', 'no restorable objects'
"""

QUERIES = {
    "path_containment": path_containment,
    "file_decode": file_decode,
    "manifest_sections": manifest_sections,
    "artifact_verify": artifact_verify,
}
ORACLES = {
    "path_containment": PATH_CONTAINMENT,
    "file_decode": FILE_DECODE,
    "manifest_sections": MANIFEST_SECTIONS,
    "artifact_verify": ARTIFACT_VERIFY,
}
