"""Queries on settings, names, versions and replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions import names, versions
from tablewarden.operators import catalog, naming, reconcile, settings
from tablewarden.queries import common as c

MINIMUM = "20.3.50-7"

# The layers view with a nested path, a value hiding it, and one hidden by it.
NESTED_LAYERS = f"""
{c.LAYERS}
UNION ALL SELECT c_custkey, 'limits.port', 3, cast(c_nationkey AS string) FROM customer
UNION ALL SELECT c_custkey, 'limits', 2, NULL FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT c_custkey, 'limits', 4, 'none' FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT c_custkey, 'limits.host.name', 1, 'h' FROM customer WHERE c_custkey % 4 = 0
"""


def layered_overlay(spark: SparkSession, sf: str) -> DataFrame:
    return settings.overlay(c.view(spark, sf, NESTED_LAYERS))


LAYERED_OVERLAY = f"""
WITH l AS ({NESTED_LAYERS}),
w AS (SELECT entity, path, min(prio) AS prio, count(*) AS layers, arg_min(struct_pack(v := val), prio).v AS val FROM l GROUP BY ALL)
SELECT entity, path, val, prio, layers FROM w
WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.entity = w.entity AND o.prio < w.prio
                  AND (starts_with(w.path, o.path || '.') OR starts_with(o.path, w.path || '.')))
"""


def settings_rules(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    rows = c.table(spark, sf, "customer").select(
        "c_custkey",
        (key * 97 % 70_000).alias("port"),
        (key % 5).alias("threads"),
        F.when(key % 7 != 0, key % 3).alias("threshold"),
        F.when(key % 11 == 0, "custom").when(key % 2 == 0, "expert").otherwise("production").alias("profile"),
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 3 == 0, "auto")
        .when(key % 3 == 1, "no-lock")
        .otherwise("safe-no-lock")
        .alias("mode"),
        (key % 4 < 2).alias("protect_ddl"),
        F.when(key % 17 == 0, "verify-ca").otherwise("preferred").alias("tls"),
    )
    rules = [*settings.settings_rules(key), settings.tls_rule(key)]
    return rows.select("c_custkey", c.rule_names(rules).alias("rules"))


SETTINGS_RULES = """
WITH s AS (SELECT c_custkey AS k, c_custkey * 97 % 70000 AS port, c_custkey % 5 AS threads,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 3 END AS threshold,
  CASE WHEN c_custkey % 11 = 0 THEN 'custom' WHEN c_custkey % 2 = 0 THEN 'expert' ELSE 'production' END AS profile,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'auto' WHEN c_custkey % 3 = 1 THEN 'no-lock'
       ELSE 'safe-no-lock' END AS mode, c_custkey % 4 < 2 AS protect FROM customer)
SELECT k AS c_custkey, concat_ws(',', CASE WHEN port < 1 OR port > 65535 THEN 'port-range' END,
  CASE WHEN threads < 2 THEN 'too-few-threads' END, CASE WHEN threshold < 1 THEN 'threshold-range' END,
  CASE WHEN profile = 'custom' THEN 'unknown-profile' END, CASE WHEN mode IS NULL THEN 'unknown-mode' END,
  CASE WHEN NOT coalesce(CASE mode WHEN 'auto' THEN protect WHEN 'no-lock' THEN NOT protect
       ELSE profile = 'expert' AND NOT protect END, false) THEN 'unsafe-consistency' END,
  CASE WHEN k % 17 = 0 THEN 'certificate-needed' END) AS rules
FROM s
"""


# In this order: the second db must pass over db-2, and the second db-2 takes db-2-2 before it comes itself.
COLLIDING = ("db", "db-2", "db", "db-2", "db-2-2")


def slug_suffix(spark: SparkSession, sf: str) -> DataFrame:
    """Two names per part from a list with blanks; keys unique over all."""
    listed = names.name_list(F.concat("p_name", F.lit(" , ,  *"), "p_type", F.lit("*,")))
    entries = c.table(spark, sf, "part").select("p_partkey", F.posexplode(listed).alias("pos", "name"))
    ordered = entries.where(~names.is_blank(F.col("name"))).withColumn(
        "at", F.col("p_partkey") * 10 + F.col("pos")
    )
    # Names that take each other's numbered keys, one per region.
    colliding = c.table(spark, sf, "region").select(
        (-1 - F.col("r_regionkey")).cast("long").alias("p_partkey"),
        F.lit(0).alias("pos"),
        F.element_at(F.array(*[F.lit(n) for n in COLLIDING]), (F.col("r_regionkey") + 1).cast("int")).alias("name"),
        (F.col("r_regionkey") - 1000).cast("long").alias("at"),
    )
    ordered = ordered.select("p_partkey", "pos", "name", "at").unionByName(colliding)
    return naming.unique_keys(ordered, "name", "at").select("p_partkey", "pos", "key")


SLUG_SUFFIX = """
WITH e AS (SELECT p_partkey, 0 AS pos, replace(p_name, ' ', '-') AS slug FROM part
           UNION ALL SELECT p_partkey, 1, p_type FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey, pos) AS nth FROM e)
SELECT p_partkey, pos, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || nth END AS key FROM n
UNION ALL
SELECT -1 - r_regionkey, 0, ['db', 'db-2', 'db-3', 'db-2-2', 'db-2-2-2'][cast(r_regionkey + 1 AS integer)] FROM region
"""

_PART_VERSION = (
    "concat(cast(p_size AS string), '.', cast(p_partkey % 7 AS string), '.', cast(p_partkey % 100 AS string), "
    "CASE WHEN p_partkey % 31 = 0 THEN '' ELSE '-' END, cast(p_partkey AS string), "
    "CASE WHEN p_partkey % 9 = 0 THEN '999999999999999999999999' ELSE '' END)"
)
PART_VERSIONS = f"SELECT p_partkey AS host, {_PART_VERSION} AS version FROM part WHERE p_partkey % 8 <> 7"
SUPPLIER_VERSIONS = f"""
SELECT s_suppkey AS host, CASE WHEN s_suppkey % 5 = 0 THEN {_PART_VERSION}
       ELSE concat('0', cast(s_nationkey AS string), '.', cast(s_suppkey % 7 AS string), '.', '007-1') END AS version
FROM supplier JOIN part ON s_suppkey = p_partkey
"""


def version_order(spark: SparkSession, sf: str) -> DataFrame:
    pairs = reconcile.paired_versions(
        c.view(spark, sf, PART_VERSIONS), c.view(spark, sf, SUPPLIER_VERSIONS), "host"
    )
    left, right = F.col("left_version"), F.col("right_version")
    line = F.concat(F.lit("exporter v"), left, F.lit(", built against lib 8.0 with SSL support\n"))
    keyed = pairs.withColumn("_left", versions.version_key(left)).withColumn(
        "_right", versions.version_key(right)
    )
    minimum = versions.version_key(F.lit(MINIMUM))
    return keyed.orderBy("_left").select(
        "host",
        "agreement",
        versions.compare_keys(F.col("_left"), F.col("_right")).cast("long").alias("compared"),
        F.coalesce(F.col("_left") >= minimum, F.lit(False)).alias("recent"),
        versions.printed_version(line, "exporter").alias("printed"),
    )


# Zero-padded parts compare like numbers of any length.
SUPPLIER_PADDED = "list_transform(regexp_extract_all(%s, '[0-9]+'), lambda x: lpad(x, 60, '0'))"
_VALID = "regexp_full_match(%s, '[0-9]+\\.[0-9]+\\.[0-9]+-[0-9]+')"
VERSION_ORDER = f"""
WITH p AS (SELECT coalesce(a.host, b.host) AS host, a.version AS l, b.version AS r
           FROM ({PART_VERSIONS}) a FULL JOIN ({SUPPLIER_VERSIONS}) b ON a.host = b.host),
k AS (SELECT *, CASE WHEN {_VALID % 'l'} THEN {SUPPLIER_PADDED % 'l'} END AS lk,
             CASE WHEN {_VALID % 'r'} THEN {SUPPLIER_PADDED % 'r'} END AS rk FROM p)
SELECT host, CASE WHEN l IS NULL OR r IS NULL THEN 'incomplete' WHEN l = r THEN 'equal' ELSE 'different' END AS agreement,
       CASE WHEN lk < rk THEN -1 WHEN lk > rk THEN 1 WHEN lk = rk THEN 0 END AS compared,
       coalesce(lk >= {SUPPLIER_PADDED % f"'{MINIMUM}'"}, false) AS recent,
       CASE WHEN lk IS NOT NULL THEN l END AS printed
FROM k
"""


def replica_health(spark: SparkSession, sf: str) -> DataFrame:
    """Each run as a replica: its latest event of each type gives a status value."""
    events = c.view(spark, sf, c.RUNLOG)
    k, at = F.col("k"), F.struct("ts", "event_id")

    def latest(kind: str, value):
        return F.max_by(value, F.when(F.col("source_event") == kind, at))

    yes_no = F.when(k % 5 == 0, "No").when(k % 2 == 0, "Yes").otherwise("yes")
    seconds = F.struct(F.when(k % 3 != 0, k.cast("string")).alias("v"))
    replicas = events.groupBy(F.col("run_id").alias("server")).agg(
        latest("signup", yes_no).alias("replica_io_running"),
        latest("click", yes_no).alias("slave_io_running"),
        latest("view", yes_no).alias("replica_sql_running"),
        latest("purchase", yes_no).alias("slave_sql_running"),
        latest("error", seconds).alias("_new"),
        latest("view", seconds).alias("_old"),
    )
    pairs = [
        F.when(
            F.col(source).isNotNull(),
            F.named_struct(F.lit("key"), F.lit(name), F.lit("value"), F.col(f"{source}.v")),
        )
        for source, name in (("_new", "Seconds_Behind_Source"), ("_old", "Seconds_Behind_Master"))
    ]
    reported = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))
    return replicas.withColumn("status", reported).select(
        "server",
        c.rule_names(catalog.replica_rules()).alias("rules"),
        catalog.replica_lag().alias("lag"),
    )


REPLICA_HEALTH = f"""
WITH e AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'No' WHEN k % 2 = 0 THEN 'Yes' ELSE 'yes' END AS yn,
                  struct_pack(v := CASE WHEN k % 3 <> 0 THEN cast(k AS varchar) END) AS sec FROM ({c.RUNLOG}) r),
g AS (SELECT run_id AS server,
  coalesce(arg_max(yn, (ts, event_id)) FILTER (source_event = 'signup'), arg_max(yn, (ts, event_id)) FILTER (source_event = 'click')) AS io,
  coalesce(arg_max(yn, (ts, event_id)) FILTER (source_event = 'view'), arg_max(yn, (ts, event_id)) FILTER (source_event = 'purchase')) AS sq,
  arg_max(sec, (ts, event_id)) FILTER (source_event = 'error') AS n, arg_max(sec, (ts, event_id)) FILTER (source_event = 'view') AS o,
  count(*) FILTER (source_event = 'error') AS has_n, count(*) FILTER (source_event = 'view') AS has_o
  FROM e GROUP BY run_id)
SELECT server, CASE WHEN io IS NULL AND sq IS NULL THEN 'not-a-replica'
                    WHEN coalesce(upper(io), '') <> 'YES' OR coalesce(upper(sq), '') <> 'YES' THEN 'replica-stopped' ELSE '' END AS rules,
       CASE WHEN (has_n > 0 AND n.v IS NULL) OR (has_o > 0 AND o.v IS NULL) THEN NULL
            ELSE cast(coalesce(n.v, o.v, '0') AS bigint) END AS lag
FROM g
"""

QUERIES = {
    "layered_overlay": layered_overlay,
    "settings_rules": settings_rules,
    "slug_suffix": slug_suffix,
    "version_order": version_order,
    "replica_health": replica_health,
}
ORACLES = {
    "layered_overlay": LAYERED_OVERLAY,
    "settings_rules": SETTINGS_RULES,
    "slug_suffix": SLUG_SUFFIX,
    "version_order": VERSION_ORDER,
    "replica_health": REPLICA_HEALTH,
}
