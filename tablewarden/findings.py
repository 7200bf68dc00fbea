"""The one output shape of every rule, and the way rules are evaluated.

All rules over one table are evaluated in a single scan: each row yields an array holding the rules
it breaks, which is then exploded. Adding a rule adds an expression, never another pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    """A rule is broken by every row for which ``broken`` is true (null counts as not broken)."""

    name: str
    broken: Column
    subject: Column
    detail: Column
    severity: str = "error"

    def as_struct(self) -> Column:
        return F.when(
            self.broken,
            # named_struct, because exploding in the same projection drops nested aliases.
            F.named_struct(
                F.lit("rule"),
                F.lit(self.name),
                F.lit("subject"),
                self.subject.cast("string"),
                F.lit("severity"),
                F.lit(self.severity),
                F.lit("detail"),
                self.detail.cast("string"),
            ),
        )


def broken_rules(rules: Sequence[Rule]) -> Column:
    """Array of the findings of one row."""
    return F.filter(F.array(*[r.as_struct() for r in rules]), lambda f: f.isNotNull())


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of all rules over ``df`` in one scan."""
    return df.select(F.explode(broken_rules(rules)).alias("f")).select("f.*")


def all_findings(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)


def first_failure(findings: DataFrame, rule_order: Sequence[str]) -> DataFrame:
    """The single finding that a check stopping at its first failure would report."""
    rank = F.array_position(F.array(*[F.lit(r) for r in rule_order]), F.col("rule"))
    return (
        findings.where(F.col("severity") == "error")
        .orderBy(rank, "subject", "detail")
        .limit(1)
    )


class RuleViolation(Exception):
    """Raised by drivers of side effects (export, restore) when findings forbid going on."""


def refuse_on(findings: DataFrame, rule_order: Sequence[str]) -> None:
    """Raise on the first finding in rule order; only that one row reaches the driver."""
    worst = first_failure(findings, rule_order).collect()
    if worst:
        raise RuleViolation(f"{worst[0].rule}: {worst[0].subject}: {worst[0].detail}")
