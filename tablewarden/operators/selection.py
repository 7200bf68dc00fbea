"""Choosing tables from a catalog: patterns, exact names, scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.findings import Rule, check
from tablewarden.functions import names

DATABASE = "database_name"
TABLE = "table_name"


def _refuse_malformed(patterns: Sequence[str]) -> None:
    for pattern in patterns:
        if not names.is_qualified(pattern):
            raise ValueError(f"pattern must be qualified as database.table: {pattern}")


def select_tables(catalog: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Each catalog row that some pattern matches, once, with the patterns that matched it."""
    _refuse_malformed(patterns)
    hits = names.matched_patterns(patterns, F.col(DATABASE), F.col(TABLE))
    return catalog.withColumn("patterns", hits).where(F.size("patterns") > 0)


def pattern_hits(catalog: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Number of catalog rows per pattern, counted for all patterns in one combined scan."""
    _refuse_malformed(patterns)
    if not patterns:
        return catalog.sparkSession.createDataFrame([], "pattern string, matches long")
    counts = [
        F.struct(
            F.lit(p).alias("pattern"),
            F.count_if(names.glob_match(p, F.col(DATABASE), F.col(TABLE))).alias("matches"),
        )
        for p in patterns
    ]
    return catalog.agg(F.array(*counts).alias("c")).select(F.inline("c"))


# Shapes of patterns that names are cut by; patterns of rarer shapes are found by their longest run alone.
SHAPES = 256


def _glob_runs(glob: Column) -> Column:
    """What a glob says at fixed places: the whole name, or its first run of literals and how many characters come
    before it, and its last run and how many come after it; both lie outside the stars.
    """
    def run(pattern: str, around: str) -> Column:
        text = F.regexp_extract(glob, pattern, 1)
        return F.struct(
            F.when(text == "", 0).otherwise(F.length(F.regexp_extract(glob, around, 0))).alias("at"), F.length(text).alias("size"), text.alias("text")
        )

    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("text"))
    whole = ~glob.rlike(r"[*?]")
    return F.struct(
        whole.alias("whole"),
        F.when(whole, F.struct(F.lit(0).alias("at"), F.length(glob).alias("size"), glob.alias("text"))).otherwise(run(r"\A\?*([^*?]*)", r"\A\?*")).alias("first"),
        F.when(whole, none).otherwise(run(r"([^*?]*)\?*\z", r"\?*\z")).alias("last"),
    )


def _longest_run(runs: Column) -> Column:
    """Of both halves' runs (:func:`_glob_runs`) the longest alone; of one length whole names come first."""
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("text"))
    ranked = [
        F.struct(runs[half][run]["size"].alias("size"), runs[half]["whole"].alias("whole"), F.lit(half).alias("half"), F.lit(run).alias("run"))
        for half in (DATABASE, TABLE)
        for run in ("first", "last")
    ]
    best = F.greatest(*ranked)

    def half(name: str) -> Column:
        def kept(run: str) -> Column:
            return F.when((best["half"] == name) & (best["run"] == run), runs[name][run]).otherwise(none).alias(run)

        return F.struct((runs[name]["whole"] & (best["half"] == name)).alias("whole"), kept("first"), kept("last")).alias(name)

    return F.struct(half(DATABASE), half(TABLE))


def _shape(runs: Column) -> Column:
    """Where a pattern's runs lie, without their texts; whole names of any length have one shape."""
    def half(name: str) -> Column:
        h = runs[name]
        places = [F.when(h["whole"], 0).otherwise(h[run][field]).alias(f"{run}_{field}") for run in ("first", "last") for field in ("at", "size")]
        return F.struct(h["whole"].alias("whole"), *places).alias(name)

    return F.struct(half(DATABASE), half(TABLE))


def _cut(name: Column, shape: Column) -> Column:
    """A name's characters at the places of one half of a shape; null where it is too short for them."""
    length, ends = F.length(name), shape["last_at"] + shape["last_size"]
    first = F.substr(name, shape["first_at"] + 1, shape["first_size"])
    last = F.substr(name, length - ends + 1, shape["last_size"])
    long_enough = (length >= shape["first_at"] + shape["first_size"]) & (length >= ends)
    return F.when(shape["whole"], name).when(long_enough, F.concat(first, last))


def _regex(glob: Column) -> Column:
    """Anchored regex of a glob, as :func:`names.glob_regex` makes it, for a column of globs."""
    literal = F.regexp_replace(glob, r"([^A-Za-z0-9*?])", r"\\$1")
    any_one = names._ANY.replace("\\", "\\\\")
    body = F.regexp_replace(F.regexp_replace(literal, r"\?", any_one), r"\*", any_one + "*")
    return F.concat(F.lit(r"\A"), body, F.lit(r"\z"))


def _halves(pattern: str) -> tuple[Column, Column]:
    dot = F.instr(pattern, ".")
    return F.substr(pattern, F.lit(1), dot - 1), F.substr(pattern, dot + 1)


def pattern_candidates(catalog: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """(pattern, database_name, table_name) of pairs that agree in all that a pattern says at fixed places.

    That is in both halves' whole names, or first and last runs of literals. Patterns whose runs lie at the same
    places have one shape; a catalog row is cut once for every shape that occurs, so rows and patterns meet by
    equality of all these characters. Beyond ``SHAPES`` shapes the rarer ones keep their longest run only, so the
    shapes stay few however the patterns are written.
    """
    well_formed = patterns.where(F.col(column).rlike(r"(?s)\A[^.]+\..")).select(F.col(column).alias("pattern")).distinct()
    left, right = _halves("pattern")
    runs = well_formed.select("pattern", F.struct(_glob_runs(left).alias(DATABASE), _glob_runs(right).alias(TABLE)).alias("runs"))
    runs = session.materialised(runs, "patterns")  # read for the shapes, and to meet the names
    # One row per shape, up to a bound: names are short.
    counted = runs.select(F.hash(_shape(F.col("runs"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    common = [r.code for r in counted.orderBy(F.desc("n"), "code").limit(SHAPES).collect()]
    if not common:
        return catalog.sparkSession.createDataFrame([], f"pattern string, {DATABASE} string, {TABLE} string")
    if len(common) == SHAPES:
        rare = ~F.hash(_shape(F.col("runs"))).isin(common)
        runs = runs.withColumn("runs", F.when(rare, _longest_run(F.col("runs"))).otherwise(F.col("runs")))
    shapes = runs.select(_shape(F.col("runs")).alias("shape")).distinct().collect()

    def literal(half: Row) -> Column:
        return F.struct(*[F.lit(value).alias(field) for field, value in half.asDict().items()])

    listed = F.array(*[F.struct(literal(s["shape"][DATABASE]).alias(DATABASE), literal(s["shape"][TABLE]).alias(TABLE)) for s in sorted(shapes, key=str)])
    cut = catalog.select(DATABASE, TABLE, F.explode(listed).alias("shape"))
    cut = cut.withColumn("in_database", _cut(F.col(DATABASE), F.col("shape")[DATABASE])).withColumn("in_table", _cut(F.col(TABLE), F.col("shape")[TABLE]))
    placed = cut.where("in_database IS NOT NULL AND in_table IS NOT NULL").select(DATABASE, TABLE, F.xxhash64("shape", "in_database", "in_table").alias("place"))

    def text(half: str) -> Column:
        return F.concat(F.col("runs")[half]["first"]["text"], F.col("runs")[half]["last"]["text"])

    anchored = runs.select("pattern", F.xxhash64(_shape(F.col("runs")), text(DATABASE), text(TABLE)).alias("place"))
    return placed.join(anchored, "place").select("pattern", DATABASE, TABLE)


def match_pattern_table(catalog: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """(pattern, database_name, table_name) of every match of a table of qualified patterns, however many.

    Patterns meet names by equality (:func:`pattern_candidates`), and only such pairs are confirmed by the whole
    pattern. Malformed and null patterns match nothing, repeated ones count once; names are those of
    :func:`names.glob_regex`.
    """
    left, right = _halves("pattern")

    def fits(name: str, glob: Column) -> Column:
        return F.when(glob.rlike(r"[*?]"), F.rlike(F.col(name), _regex(glob))).otherwise(F.col(name) == glob)

    return pattern_candidates(catalog, patterns, column).where(fits(DATABASE, left) & fits(TABLE, right))


def malformed_patterns(spark: SparkSession, patterns: Sequence[str]) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    dot = F.instr(F.col("pattern"), ".")
    return check(
        rows,
        [
            Rule(
                "malformed-pattern",
                (dot <= 1) | (dot == F.length("pattern")),
                F.col("pattern"),
                F.lit("pattern must be qualified as database.table"),
            )
        ],
    )


def unmatched_patterns(catalog: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Findings for patterns that match nothing; malformed ones are reported elsewhere."""
    well_formed = [p for p in patterns if names.is_qualified(p)]
    return check(
        pattern_hits(catalog, well_formed),
        [
            Rule(
                "unmatched-pattern",
                F.col("matches") == 0,
                F.col("pattern"),
                F.lit("pattern matched nothing"),
            )
        ],
    )


def only_named(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalog rows named exactly in ``wanted``; Spark picks the join by the sides' sizes."""
    return catalog.join(wanted.select(DATABASE, TABLE), [DATABASE, TABLE], "left_semi")


def of_kinds(catalog: DataFrame, include_views: bool = True) -> DataFrame:
    return catalog if include_views else catalog.where(F.col("kind") != "view")


def in_databases(catalog: DataFrame, databases: Sequence[str]) -> DataFrame:
    return catalog.where(F.col(DATABASE).isin(*databases))


def without(catalog: DataFrame, excluded: DataFrame) -> DataFrame:
    """Catalog minus the tables named in ``excluded``."""
    return catalog.join(excluded.select(DATABASE, TABLE), [DATABASE, TABLE], "left_anti")


def refuse_unmatched(catalog: DataFrame, patterns: Sequence[str]) -> None:
    """Raise where a pattern matches no catalog row: a mistyped exclusion would silently export its tables."""
    lacking = pattern_hits(catalog, patterns).where("matches = 0").select("pattern").collect()  # one row per pattern
    if lacking:
        raise ValueError("patterns matched nothing: " + ", ".join(sorted(r.pattern for r in lacking)))


def resolve_scopes(
    catalog: DataFrame, drop: Sequence[str] = (), schema_only: Sequence[str] = (), within: DataFrame | None = None
) -> DataFrame:
    """Scope of every kept table: ``SCHEMA`` keeps structure only, ``ALL`` rows too.

    Dropping wins over keeping the structure. The rules are expressions of the catalog scan, so
    nothing is shuffled. Each pattern must match something of ``within`` (the catalog itself unless given,
    or a larger one that it was chosen from); one job counts that.
    """
    _refuse_malformed([*drop, *schema_only])
    refuse_unmatched(catalog if within is None else within, [*drop, *schema_only])
    database, table = F.col(DATABASE), F.col(TABLE)
    scope: Column = F.when(
        names.matches_any(schema_only, database, table), F.lit("SCHEMA")
    ).otherwise(F.lit("ALL"))
    return (
        catalog.where(~names.matches_any(drop, database, table))
        .withColumn("scope", scope)
        .withColumn("serialized", names.quoted_table(database, table))
    )


def identifier_findings(catalog: DataFrame) -> DataFrame:
    """Names that cannot be quoted, cannot head a manifest section, or are unsafe in file names."""
    rules = []
    for kind, column in (("database", DATABASE), ("table", TABLE)):
        name = F.col(column)
        rules += [
            Rule(
                "nul-in-identifier",
                F.contains(name, F.lit("\0")),
                name,
                F.lit(f"{kind} name contains NUL"),
            ),
            Rule(
                "backtick-in-section",
                F.contains(name, F.lit("`")),
                name,
                F.lit(f"{kind} name cannot head a manifest section"),
            ),
            Rule(
                "unsafe-identifier",
                ~names.is_safe_identifier(name),
                name,
                F.lit(f"unsupported {kind} name"),
            ),
        ]
    return check(catalog, rules)


def is_empty_selection(selection: DataFrame) -> bool:
    return selection.isEmpty()
