"""Settings kept as rows: layered overlay, references between them, and their rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.findings import Rule, check


def overlay(
    layers: DataFrame, entity: str = "entity", path: str = "path", prio: str = "prio", val: str = "val"
) -> DataFrame:
    """Effective value of each dotted path: the layer with the smallest ``prio`` wins.

    A null value is present and wins like any other. A value at a path hides what lower layers hold
    below it, and a lower value at a path gives way to anything a higher layer holds below it. The
    winner per path is a mergeable aggregate, so a hot path costs no more than any other.
    """
    winners = layers.groupBy(entity, path).agg(
        F.min_by(val, prio).alias(val),
        F.min(prio).alias(prio),
        F.count(F.lit(1)).alias("layers"),
    )
    parts = F.split(path, r"\.")
    above = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
    )
    # Each nested path with each of its ancestors; a path has few of them.
    lineage = winners.where(F.contains(F.col(path), F.lit("."))).select(
        entity, path, prio, F.explode(above).alias("ancestor")
    )
    below = lineage.groupBy(entity, F.col("ancestor").alias(path)).agg(
        F.min(prio).alias("_below")
    )
    hidden = (
        lineage.join(
            winners.select(
                entity, F.col(path).alias("ancestor"), F.col(prio).alias("_above")
            ),
            [entity, "ancestor"],
        )
        .where(F.col("_above") < F.col(prio))
        .select(entity, path)
        .distinct()
    )
    return (
        winners.join(below, [entity, path], "left")
        .where(F.col("_below").isNull() | (F.col(prio) < F.col("_below")))
        .drop("_below")
        .join(hidden, [entity, path], "left_anti")
    )


def enum_rule(name: str, column: str, allowed: Sequence[str], subject: Column) -> Rule:
    return Rule(
        name,
        ~F.coalesce(F.col(column).isin(*allowed), F.lit(False)),
        subject,
        F.concat(F.lit(f"{column} is "), F.coalesce(F.col(column), F.lit("null"))),
    )


def bounds_rules(subject: Column) -> list[Rule]:
    """Port, threads and throttle threshold (null allowed) within their bounds."""
    low, high = fixed.PORT_RANGE
    return [
        Rule(
            "port-range",
            ~F.coalesce(F.col("port").between(low, high), F.lit(False)),
            subject,
            F.concat(F.lit("port "), F.col("port").cast("string")),
        ),
        Rule(
            "too-few-threads",
            ~F.coalesce(F.col("threads") >= fixed.MIN_THREADS, F.lit(False)),
            subject,
            F.concat(F.lit("threads "), F.col("threads").cast("string")),
        ),
        Rule(
            "threshold-range",
            F.col("threshold") < 1,
            subject,
            F.concat(F.lit("threshold "), F.col("threshold").cast("string")),
        ),
    ]


def consistency_rule(subject: Column) -> Rule:
    """Which consistency modes may go with protected structure, and for which profile."""
    mode, protect = F.col("mode"), F.col("protect_ddl")
    allowed = (
        F.when(mode == "auto", protect)
        .when(mode == "no-lock", ~protect)
        .otherwise((F.col("profile") == "expert") & ~protect)
    )
    return Rule(
        "unsafe-consistency",
        ~F.coalesce(allowed, F.lit(False)),
        subject,
        F.concat_ws(" ", "profile", "mode"),
    )


def tls_rule(subject: Column) -> Rule:
    return Rule(
        "certificate-needed",
        F.col("tls").isin("verify-ca", "verify-identity"),
        subject,
        F.concat(F.lit("tls "), F.col("tls")),
    )


def settings_rules(subject: Column) -> list[Rule]:
    return [
        *bounds_rules(subject),
        enum_rule("unknown-profile", "profile", fixed.PROFILES, subject),
        enum_rule("unknown-mode", "mode", fixed.CONSISTENCY_MODES, subject),
        consistency_rule(subject),
    ]


def dangling_references(
    referring: DataFrame, key: str, registry: DataFrame, registry_key: str, name: str
) -> DataFrame:
    """Referenced keys that the registry lacks, each once, with the number of rows referring to it.

    Referring rows are counted per key before the join, so a key used by most rows joins as one row.
    """
    used = referring.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    known = registry.select(F.col(registry_key).alias("_key")).distinct()
    return check(
        used.where(F.col("_key").isNotNull()).join(known, "_key", "left_anti"),
        [
            Rule(
                f"unknown-{name}",
                F.lit(True),
                F.col("_key"),
                F.concat(F.lit("referred to by "), F.col("_rows").cast("string"), F.lit(" rows")),
            )
        ],
    )


def known_keys(registry: DataFrame, key: str) -> DataFrame:
    """The keys of a registry, each once, as rows of one column ``known``; ordering is left to the reader."""
    return registry.select(F.col(key).cast("string").alias("known")).where(F.col("known").isNotNull()).distinct()


def with_fallback(
    df: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, value: str
) -> DataFrame:
    """Add ``value`` from the first registry, else from the second."""
    one = first.select(first_key, F.col(value).alias("_one"))
    two = second.select(second_key, F.col(value).alias("_two"))
    return (
        df.join(one, first_key, "left")
        .join(two, second_key, "left")
        .withColumn(value, F.coalesce("_one", "_two"))
        .drop("_one", "_two")
    )


def issue_list(findings: DataFrame, subject: str = "subject") -> DataFrame:
    """Distinct messages per subject, one row each; equal ones merge before the shuffle."""
    return findings.select(subject, F.col("detail").alias("issue")).distinct()
