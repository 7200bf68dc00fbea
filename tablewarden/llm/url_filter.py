"""URL filters: host-suffix and path-prefix expressions joined with a rule table by short hash.

A rule is a host and a path; it fits its host, all subdomains, and every path that starts with the
rule's. Each distinct (host, path) of the input is expanded once into the rule strings that could fit
it. These meet the rules by an equi-join on the first four bytes of their SHA-256, the whole digests
are compared after that, and the longest rule of those left decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8  # hexadecimal digits of the digest that are joined on: 4 bytes

RULE_SCHEMA = "host string, path string, verdict string"


def _lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return _lowered(found)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots; none for an empty host."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    )


def _path_prefixes(path: Column, lengths: Sequence[int]) -> Column:
    """The path's beginnings that have the length of some rule's path."""
    wanted = F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>")  # empty without rules
    return F.transform(F.filter(wanted, lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))


def _digest(host: Column, path: Column) -> Column:
    # A host holds no slash, so the first one parts host and path of a rule without doubt; a rule whose
    # path is empty or begins otherwise is told apart by the zero byte.
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def deciding_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rule that decides for each distinct (host, path) that some rule fits: host, path, rule, verdict.

    Rules with a null part or an empty host never fit. Of rules of the same length the longer host wins,
    then `block`; a rule given twice counts once.
    """
    good = rules.where("host != '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        _lowered(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
    )
    # One number for each length that a rule's path has: few, however many rules there are.
    lengths = [row.n for row in good.select(F.length("rule_path").alias("n")).distinct().collect()]
    digests = good.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "short", F.substring("rule_digest", 1, PREFIX_HEX)
    )
    places = urls.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).distinct()
    expressions = (
        places.withColumn("suffix", F.explode(_host_suffixes(F.col("host"))))
        .withColumn("prefix", F.explode(_path_prefixes(F.col("path"), lengths)))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    fitting = expressions.join(digests, "short").where("digest = rule_digest")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = fitting.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str, url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule and verdict of every row of `pages`; other columns are not read.

    Null urls and those without `://` have an empty host and path, which no rule fits. Without a fitting
    rule the verdict is `default` and the rule null. Null and repeated keys and repeated urls keep their
    rows; an empty table gives an empty one, an empty rule table `default` everywhere.
    """
    own = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    decided = deciding_rules(pages, rules, url)
    return own.join(decided, ["host", "path"], "left").select(
        key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
