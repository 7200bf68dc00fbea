"""Inputs of the registered queries: the driver's tables and views over them.

The views are SQL both engines read alike; the oracle of a query wraps the same text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.findings import Rule, broken_rules
from tablewarden.functions import events as ev
from tablewarden.operators.run_log import RunLog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Stand-ins in the event table for the steps of a run.
LOCK = ("signup", None, "started")
PROGRESS = ("view", None, "progress")
UNLOCK = ("purchase", None, "finished")
LIFECYCLE = (
    ("signup", None, "started"),
    ("view", None, "progress"),
    ("click", None, "warning"),
    ("purchase", None, "finished"),
)
COMPLETIONS = ("purchase",)

# One run is one user on one day; events are ordered by (ts, event_id).
RUNLOG = """
SELECT concat(cast(user_id AS string), '-', substr(cast(ts AS string), 1, 10)) AS run_id, event_id, ts,
       CASE WHEN user_id % 2 = 0 THEN 'exporter' ELSE 'loader' END AS tool,
       event_type AS source_event,
       CASE event_id % 6 WHEN 0 THEN 'startup' WHEN 1 THEN 'global_lock' WHEN 2 THEN 'checksum'
            WHEN 3 THEN 'dump_finish' WHEN 4 THEN 'wait_database_finish' ELSE 'dump' END AS source_phase,
       CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'warning'
            WHEN 'purchase' THEN 'finished' ELSE 'failed' END AS status,
       (event_type = 'error' AND value > 50) AS fatal,
       cast(replace(replace(props, '{"k": ', ''), '}', '') AS int) AS k,
       CASE WHEN event_id % 10 = 0 THEN 'WARNING' ELSE 'INFO' END AS level_name
FROM events
"""

LINES = """
SELECT event_id,
       CASE WHEN event_id % 97 = 0 THEN '{bad}'
            ELSE concat('{"schema_version":"', CASE WHEN event_id % 83 = 0 THEN '2' ELSE '1' END,
                        '","event_version":"1","seq":', cast(event_id AS string),
                        CASE WHEN event_id % 79 = 0 THEN '' ELSE concat(',"run_id":"', cast(user_id AS string), '"') END,
                        ',"ts":"', substr(cast(ts AS string), 1, 19), '.0","level":"INFO","tool":"exporter","event":"', event_type,
                        '","phase":"dump","status":"progress","fatal":',
                        CASE WHEN event_id % 73 = 0 THEN '"true"' ELSE 'false' END, ',"rows":',
                        CASE WHEN event_id % 89 = 0 THEN cast(event_id AS string)
                             ELSE concat('"', cast(event_id AS string), '"') END, '}') END AS line
FROM events
"""

OBJECTS = """
SELECT lower(p_type) AS database_name,
       concat(replace(p_name, ' ', '_'), '_', cast(p_partkey AS string)) AS table_name,
       CASE WHEN p_partkey % 10 = 0 THEN 'view' ELSE 'base-table' END AS kind,
       CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN 'MyISAM' ELSE 'InnoDB' END AS engine,
       p_partkey AS object_id
FROM part
"""

MANIFEST = """
SELECT 'app' AS database_name, concat('s', cast(s_suppkey AS string)) AS table_name,
       CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS is_view,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE coalesce(n, 0) END AS declared_rows,
       s_suppkey
FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 13 <> 0 GROUP BY l_suppkey) c
  ON s_suppkey = l_suppkey
"""

FILES = """
SELECT DISTINCT concat('app.s', cast(l_suppkey AS string), '.', lpad(cast(l_linenumber AS string), 5, '0'), '.sql',
       CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.gz' ELSE '.zst' END) AS file_name
FROM lineitem WHERE l_suppkey % 7 <> 0 AND l_suppkey % 10 <> 0
UNION ALL
SELECT concat('app.s', cast(s_suppkey AS string), '-schema.sql') FROM supplier WHERE s_suppkey % 11 <> 0
UNION ALL
SELECT concat('app.s', cast(s_suppkey AS string), '-schema-view.sql') FROM supplier
WHERE s_suppkey % 20 = 0 OR s_suppkey % 17 = 0
UNION ALL
SELECT 'app-schema-create.sql' AS file_name
"""

GRANTS = r"""
SELECT s_suppkey AS grantee, n_name AS database_name,
       CASE WHEN s_suppkey % 9 = 0 THEN 'GRANT ALL PRIVILEGES ON *.* TO u'
            ELSE concat('GRANT SELECT, SHOW VIEW', CASE WHEN s_suppkey % 2 = 0 THEN ', TRIGGER' ELSE '' END,
                        ' ON `', replace(n_name, '_', '\_'), '`.* TO u') END AS stmt
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT s_suppkey, n_name, concat('REVOKE SELECT ON `', n_name, '`.* FROM u')
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 = 0
UNION ALL
SELECT s_suppkey, n_name, concat('GRANT TRIGGER ON `', n_name, '`.`t` TO u')
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0
"""

LAYERS = """
SELECT c_custkey AS entity, 'segment' AS path, 1 AS prio, c_mktsegment AS val FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT c_custkey, 'segment', 2, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'env' END FROM customer WHERE c_custkey % 2 = 0
UNION ALL
SELECT c_custkey, 'segment', 3, 'default' FROM customer
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's SQL with its tables read from ``sf_dir``; nothing is registered in the session."""
    located = re.sub(
        r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql
    )
    # Backslashes are plain characters in the shared SQL, escapes in this parser.
    return spark.sql(located.replace("\\", "\\\\"))


def run_log(spark: SparkSession, sf_dir: str) -> RunLog:
    """Typed events of the run-log view."""
    raw = view(spark, sf_dir, RUNLOG)
    status = F.col("status")
    event_type = ev.type_of(
        status, F.col("fatal"), F.col("level_name"), F.col("source_event"), COMPLETIONS
    )
    typed = (
        raw.withColumn("phase", ev.phase_of(F.col("source_phase"), F.col("tool")))
        .withColumn("type", event_type)
        .withColumn("source_status", status)
        .withColumn("status", F.when(F.col("type") == "status", ev.status_of(status)))
    )
    return RunLog(typed, order=("ts", "event_id"), at="ts")


# The same typing for oracles.
TYPED = f"""
SELECT *, CASE WHEN regexp_matches(lower(source_phase), 'start|initial') THEN 'startup'
               WHEN regexp_matches(lower(source_phase), 'lock|snapshot') THEN 'locking'
               WHEN regexp_matches(lower(source_phase), 'verify|check') THEN 'verification'
               WHEN regexp_matches(lower(source_phase), 'final|cleanup|complete') THEN 'finalization'
               WHEN tool = 'exporter' THEN 'backup' ELSE 'restore' END AS phase,
       CASE WHEN status = 'cancelled' THEN 'cancelled'
            WHEN fatal OR status = 'failed' THEN 'error'
            WHEN status = 'warning' OR level_name = 'WARNING' THEN 'warning'
            WHEN status = 'progress' THEN 'progress'
            WHEN status = 'finished' AND source_event = 'purchase' THEN 'completion'
            ELSE 'status' END AS type
FROM ({RUNLOG}) r
"""


def rule_names(rules: list[Rule]) -> Column:
    """Names of the rules a row breaks, as one text in rule order."""
    return F.array_join(F.transform(broken_rules(rules), lambda f: f["rule"]), ",")
