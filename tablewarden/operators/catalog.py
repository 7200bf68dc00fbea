"""Preflight of a catalog and of a destination, as findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.findings import Rule, all_findings, check
from tablewarden.operators.selection import DATABASE, TABLE


def mark_existence(catalog: DataFrame, keys: Sequence[str], members: DataFrame, name: str) -> DataFrame:
    """Flag catalog rows that have a row in ``members``.

    Members are reduced to distinct keys first, on the map side too, so a key holding most of them
    arrives at the join as one row.
    """
    present = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return catalog.join(present, list(keys), "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def missing_members(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not present."""
    return wanted.select(key).join(present.select(key).distinct(), key, "left_anti")


def object_counts(wanted: DataFrame, *kinds: DataFrame) -> DataFrame:
    """Objects per wanted database over several kinds of objects; absent databases count 0."""
    counted = [k.groupBy(DATABASE).agg(F.count(F.lit(1)).alias("n")) for k in kinds]
    union = counted[0]
    for part in counted[1:]:
        union = union.unionByName(part)
    totals = union.groupBy(DATABASE).agg(F.sum("n").alias("objects"))
    return wanted.select(DATABASE).join(totals, DATABASE, "left").na.fill(0, ["objects"])


def catalog_findings(catalog: DataFrame, safe_engines: Sequence[str] = (fixed.SAFE_ENGINE,)) -> DataFrame:
    """Unsafe engines (error) and base tables without a unique key (warning)."""
    safe = F.coalesce(F.upper("engine").isin(*[e.upper() for e in safe_engines]), F.lit(False))
    base = F.col("kind") == "base-table"
    subject = F.concat_ws(".", DATABASE, TABLE)
    return check(
        catalog,
        [
            Rule(
                "unsafe-engine",
                base & ~safe,
                subject,
                F.concat(F.lit("engine "), F.coalesce(F.col("engine"), F.lit("unknown"))),
            ),
            Rule(
                "keyless-table",
                base & ~F.col("has_key"),
                subject,
                F.lit("base table without a unique key"),
                "warning",
            ),
        ],
    )


def product_of(version: Column, comment: Column) -> Column:
    """Server product: ``mysql``, or ``mariadb``/``unknown`` which are refused."""
    both = F.concat_ws(" ", version, comment)
    return (
        F.when(both.rlike("(?i)mariadb"), "mariadb")
        .when(version.startswith("8."), "mysql")
        .otherwise("unknown")
    )


def product_findings(servers: DataFrame) -> DataFrame:
    product = product_of(F.col("version"), F.col("version_comment"))
    return check(
        servers,
        [
            Rule(
                "unqualified-product",
                product != "mysql",
                F.col("server"),
                F.concat(F.lit("refused product "), product),
            )
        ],
    )


def destination_rules(prefix: str = "") -> list[Rule]:
    """Rules on a destination row (database, objects as text, destination and overwrite policy)."""
    database, objects = F.col("database"), F.col("objects")
    valid = objects.rlike(fixed.COUNTER_PATTERN) & F.coalesce(
        objects.try_cast("decimal(38,0)") <= F.lit(fixed.SAFE_INTEGER_MAX), F.lit(False)
    )
    return [
        Rule(
            prefix + "invalid-destination",
            F.coalesce((database == "") | F.contains(database, F.lit("\0")), F.lit(True)),
            database,
            F.lit("destination needs a valid name"),
        ),
        Rule(
            prefix + "system-destination",
            F.lower(database).isin(*fixed.SYSTEM_DATABASES),
            database,
            F.lit("destination is a system database"),
        ),
        Rule(
            prefix + "overwrite-needs-existing",
            (F.col("overwrite_policy") != "reject")
            & (F.col("destination_policy") != "allow-existing"),
            database,
            F.concat_ws(" ", F.lit("overwrite policy"), F.col("overwrite_policy")),
        ),
        Rule(
            prefix + "invalid-object-count",
            ~F.coalesce(valid, F.lit(False)),
            database,
            F.lit("object count is no safe counter"),
        ),
        Rule(
            prefix + "destination-not-empty",
            valid
            & (objects.try_cast("decimal(38,0)") > 0)
            & (F.col("destination_policy") == "require-empty"),
            database,
            F.concat(F.lit("contains "), objects, F.lit(" objects")),
        ),
    ]


def binlog_rules() -> list[Rule]:
    """Rules on the log switches of a destination (global and session, as 0/1 text)."""
    policy, database = F.col("binlog_policy"), F.col("database")
    glob, sess = F.col("log_bin"), F.col("session_log_bin")
    return [
        Rule(
            "invalid-binlog-value",
            ~F.coalesce(glob.isin("0", "1"), F.lit(False))
            | ~F.coalesce(sess.isin("0", "1"), F.lit(False)),
            database,
            F.lit("switch must be 0 or 1"),
        ),
        Rule(
            "binlog-unavailable",
            (policy == "enable") & ((glob == "0") | (sess == "0")),
            database,
            F.lit("log is off and cannot satisfy enable"),
        ),
        Rule(
            "binlog-not-disabled",
            (policy == "disable") & (sess == "1"),
            database,
            F.lit("session log could not be disabled"),
        ),
    ]


def replica_rules(reported: Column | None = None) -> list[Rule]:
    """Health of a replica reported under the new or the old column names.

    ``reported`` tells whether the server gave a status row at all; a row without either thread's state
    is a replica that does not run. Unless given, such a row counts as none.
    """
    io = F.coalesce("replica_io_running", "slave_io_running")
    sql = F.coalesce("replica_sql_running", "slave_sql_running")
    configured = F.coalesce(io, sql).isNotNull() if reported is None else reported
    running = (F.upper(io).eqNullSafe(F.lit("YES"))) & (F.upper(sql).eqNullSafe(F.lit("YES")))
    return [
        Rule("not-a-replica", ~configured, F.col("server"), F.lit("no replica is configured")),
        Rule(
            "replica-stopped",
            configured & ~running,
            F.col("server"),
            F.lit("both threads must be running"),
        ),
    ]


def replica_findings(replicas: DataFrame) -> DataFrame:
    return check(replicas, replica_rules(F.col("reported") if "reported" in replicas.columns else None))


def replica_lag() -> Column:
    """Lag in seconds; null (unknown) when either name reports null, 0 when neither is reported.

    Expects the map column ``status`` of a server's reported names and values.
    """
    status = F.col("status")
    new, old = F.lit("Seconds_Behind_Source"), F.lit("Seconds_Behind_Master")
    has_new, has_old = F.map_contains_key(status, new), F.map_contains_key(status, old)
    value_new, value_old = F.try_element_at(status, new), F.try_element_at(status, old)
    unknown = (has_new & value_new.isNull()) | (has_old & value_old.isNull())
    return F.when(
        ~unknown, F.coalesce(value_new, value_old, F.lit("0")).try_cast("long")
    )


def preflight(
    catalog: DataFrame, wanted: DataFrame, databases: DataFrame, servers: DataFrame | None = None
) -> DataFrame:
    """All preflight findings on a selection."""
    missing = missing_members(wanted, databases, DATABASE)
    parts = [
        check(
            missing,
            [
                Rule(
                    "missing-database",
                    F.lit(True),
                    F.col(DATABASE),
                    F.lit("selected database does not exist"),
                )
            ],
        ),
        catalog_findings(catalog),
    ]
    if servers is not None:
        parts.append(product_findings(servers))
    return all_findings(parts)
