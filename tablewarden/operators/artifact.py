"""Checks of an artifact: its file names, its manifest, and how the two agree.

``files`` has one row per file (``file_name``); the manifest is a table of sections with
``database_name``, ``table_name``, ``declared_rows`` and ``view_flag`` (both as read, nullable).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.findings import Rule, all_findings, check
from tablewarden.functions import names
from tablewarden.operators import ordered
from tablewarden.operators.selection import DATABASE, TABLE

_CODEC = r"(?:\.(gz|zst))?\z"
CREATE_FILE = r"\A([A-Za-z0-9_-]+)-schema-create\.sql" + _CODEC
OBJECT_FILE = (
    r"\A([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+?)-schema(?:-(view|triggers))?\.sql" + _CODEC
)
DATA_FILE = r"\A([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)((?:\.[0-9]+)+)\.(?:sql|dat)" + _CODEC
HEADING = r"\A\[(.*)\]\z"
OBJECT_HEADING = r"\A\[`([^`]+)`\.`([^`]+)`\]\z"
LOADER_VARIABLES = "_session_variables"
PROTECTED_SWITCH = "sql_log_bin"
MANIFEST_FILE = "metadata"
INCOMPLETE_FILE = "metadata.partial"

RULE_ORDER = (
    "empty-artifact",
    "unsafe-identifier",
    "control-file",
    "incomplete-artifact",
    "unexpected-entry",
    "unsafe-path",
    "file-count",
    "binlog-override",
    "missing-create-file",
    "duplicate-section",
    "missing-section",
    "invalid-view-flag",
    "missing-schema",
    "missing-view",
    "unexpected-view",
    "missing-triggers",
    "missing-row-count",
    "missing-data",
)


def _pick(name: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(name, pattern, group)
    return F.when(name.rlike(pattern) & (found != ""), found)


def decode_files(files: DataFrame) -> DataFrame:
    """Add database, table, role, chunk and codec told by each file name."""
    name = F.col("file_name")
    role = (
        F.when(name.rlike(CREATE_FILE), "create")
        .when(
            name.rlike(OBJECT_FILE),
            F.concat_ws("-", F.lit("schema"), _pick(name, OBJECT_FILE, 3)),
        )
        .when(name.rlike(DATA_FILE), "data")
        .otherwise("other")
    )
    return (
        files.withColumn("role", role)
        .withColumn(
            DATABASE,
            F.coalesce(
                _pick(name, CREATE_FILE, 1), _pick(name, OBJECT_FILE, 1), _pick(name, DATA_FILE, 1)
            ),
        )
        .withColumn(TABLE, F.coalesce(_pick(name, OBJECT_FILE, 2), _pick(name, DATA_FILE, 2)))
        .withColumn("chunk", F.substring(_pick(name, DATA_FILE, 3), 2, 1 << 30))
        .withColumn("codec", _pick(name, r"\.(gz|zst)\z", 1))
    )


def file_rules() -> list[Rule]:
    """Files no artifact may hold."""
    name = F.col("file_name")
    return [
        Rule(
            "control-file",
            (name == "metadata.header")
            | name.startswith(INCOMPLETE_FILE)
            | name.startswith(fixed.RESERVED_PREFIX),
            name,
            F.lit("unsupported loader control file"),
        ),
        Rule(
            "incomplete-artifact",
            name == INCOMPLETE_FILE,
            name,
            F.lit("marker of an unfinished artifact"),
        ),
        Rule(
            "unsafe-path",
            names.is_unsafe_path(name),
            name,
            F.lit("path is empty, absolute or leaves the artifact"),
        ),
    ]


def file_findings(files: DataFrame) -> DataFrame:
    rules = file_rules()
    if "regular" in files.columns:
        name = F.col("file_name")
        rules.append(Rule("unexpected-entry", ~F.col("regular"), name, F.lit("not a plain file")))
    return check(files, rules)


def assign_headings(
    lines: DataFrame,
    artifact: str = "artifact",
    line_no: str = "line_no",
    text: str = "line",
    lines_per_chunk: int = 100_000,
) -> DataFrame:
    """Give every line the heading it stands under (null before the first) and that line's number."""
    trimmed = names.trimmed(F.col(text))
    heading = F.when(
        trimmed.rlike(HEADING),
        F.struct(F.col(line_no).alias("start"), trimmed.alias("heading")),
    )
    marked = lines.withColumn("_heading", heading)
    carried = ordered.carried_forward(
        marked, [artifact], line_no, "_heading", "_section", lines_per_chunk
    )
    return (
        carried.withColumn("heading", F.col("_section.heading"))
        .withColumn("section_start", F.col("_section.start"))
        .drop("_heading", "_section")
    )


def sets_switch(line: Column) -> Column:
    """Whether a line gives the protected switch a value: its part before an equals sign names it."""
    key = F.lower(names.trimmed(F.substring_index(line, "=", 1)))
    return F.contains(line, F.lit("=")) & (key == PROTECTED_SWITCH)


def is_loader_section(heading: Column, loader: str) -> Column:
    """Headings of a loader's variables: ``[<loader>_session_variables]``, or with an underscore and more."""
    start = loader.lower() + LOADER_VARIABLES
    name = F.lower(F.substring(heading, 2, F.length(heading) - 2))
    rest = F.substr(name, F.lit(len(start) + 1))
    return name.startswith(start) & ((rest == "") | (rest.startswith("_") & (F.length(rest) > 1)))


def sections(headed: DataFrame, artifact: str = "artifact", text: str = "line") -> DataFrame:
    """One row per section: its keys as read, first line winning within a section."""
    line, at = F.col(text), F.col("line_no")

    def value(key: str) -> Column:
        pattern = rf"\A{key}\s*=\s*([0-9]+)\s*\z"
        return F.min_by(F.regexp_extract(line, pattern, 1), F.when(line.rlike(pattern), at))

    return (
        headed.where(F.col("heading").isNotNull())
        .groupBy(artifact, "section_start", "heading")
        .agg(
            value("rows").alias("declared_rows"),
            value("is_view").alias("view_flag"),
            F.count_if(sets_switch(line)).alias("control_lines"),
        )
        .withColumn(DATABASE, _pick(F.col("heading"), OBJECT_HEADING, 1))
        .withColumn(TABLE, _pick(F.col("heading"), OBJECT_HEADING, 2))
    )


def section_findings(
    found: DataFrame, artifact: str = "artifact", loader: str = "loader"
) -> DataFrame:
    """Duplicate object sections, and loader sections that set a protected switch."""
    override = check(
        found,
        [
            Rule(
                "binlog-override",
                is_loader_section(F.col("heading"), loader) & (F.col("control_lines") > 0),
                F.col(artifact),
                F.col("heading"),
            )
        ],
    )
    repeated = check(
        found.where(F.col(TABLE).isNotNull())
        .groupBy(artifact, "heading")
        .agg(F.count(F.lit(1)).alias("times")),
        [
            Rule(
                "duplicate-section",
                F.col("times") > 1,
                F.concat_ws(" ", artifact, "heading"),
                F.concat(F.lit("appears "), F.col("times").cast("string"), F.lit(" times")),
            )
        ],
    )
    return all_findings([override, repeated])


def repeated_values(rows: DataFrame, columns: Sequence[str], rule: str) -> DataFrame:
    """Findings for values of some columns that more than one row has; counted before the shuffle. Nulls are no values."""
    counted = rows.where(F.concat(*[F.col(c).cast("string") for c in columns]).isNotNull()).groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
    return check(
        counted,
        [
            Rule(
                rule,
                F.col("times") > 1,
                F.concat_ws(" ", *columns),
                F.concat(F.lit("appears "), F.col("times").cast("string"), F.lit(" times")),
            )
        ],
    )


def objects_with_files(objects: DataFrame, files: DataFrame) -> DataFrame:
    """Objects with flags for the files they have; files are first reduced to one row per object."""
    per_object = (
        decode_files(files)
        .where(F.col(TABLE).isNotNull())
        .groupBy(DATABASE, TABLE)
        .agg(
            F.bool_or(F.col("role") == "schema").alias("has_schema"),
            F.bool_or(F.col("role") == "schema-view").alias("has_view"),
            F.bool_or(F.col("role") == "schema-triggers").alias("has_triggers_file"),
            F.bool_or(F.col("role") == "data").alias("has_data"),
            F.count_if(F.col("role") == "data").alias("data_files"),
        )
    )
    flags = ["has_schema", "has_view", "has_triggers_file", "has_data"]
    joined = objects.join(per_object, [DATABASE, TABLE], "left")
    return joined.na.fill(False, flags).na.fill(0, ["data_files"])


def missing_create_files(databases: DataFrame, files: DataFrame) -> DataFrame:
    """Databases without their create file."""
    created = decode_files(files).where(F.col("role") == "create").select(DATABASE).distinct()
    lacking = databases.select(DATABASE).distinct().join(created, DATABASE, "left_anti")
    return check(
        lacking,
        [
            Rule(
                "missing-create-file",
                F.lit(True),
                F.col(DATABASE),
                F.lit("database has no create file"),
            )
        ],
    )


def _needs_data() -> Column:
    rows = F.col("declared_rows")
    return rows.isNotNull() & (rows != "0") & ~F.col("has_data")


def export_findings(
    selection: DataFrame, manifest: DataFrame, files: DataFrame, triggers: bool = True
) -> DataFrame:
    """What an export must hold for every selected object (kind, scope, has_triggers)."""
    declared = (
        manifest.groupBy(DATABASE, TABLE)
        .agg(F.min_by("declared_rows", "section_start").alias("declared_rows"))
        .withColumn("has_section", F.lit(True))
    )
    rows = objects_with_files(
        selection.join(declared, [DATABASE, TABLE], "left"), files
    )
    subject = F.concat_ws(".", DATABASE, TABLE)
    view, whole = F.col("kind") == "view", F.col("scope") != "SCHEMA"
    rules = [
        Rule(
            "missing-section", F.col("has_section").isNull(), subject, F.lit("not in the manifest")
        ),
        Rule("missing-schema", ~F.col("has_schema"), subject, F.lit("no schema file")),
        Rule("missing-view", view & ~F.col("has_view"), subject, F.lit("no view definition")),
        Rule(
            "missing-row-count",
            ~view & whole & F.col("has_section") & F.col("declared_rows").isNull(),
            subject,
            F.lit("no row count"),
        ),
        Rule("missing-data", whole & _needs_data(), subject, F.lit("rows but no data file")),
    ]
    if triggers:
        rules.append(
            Rule(
                "missing-triggers",
                F.col("has_triggers") & ~F.col("has_triggers_file"),
                subject,
                F.lit("no trigger file"),
            )
        )
    return all_findings([missing_create_files(selection, files), check(rows, rules)])


def restore_findings(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What an artifact must hold for every object its manifest lists."""
    rows = objects_with_files(manifest.where(F.col(TABLE).isNotNull()), files)
    subject = F.concat_ws(".", DATABASE, TABLE)
    flag = F.col("view_flag")
    view = F.coalesce(flag == "1", F.lit(False))
    return all_findings(
        [
            missing_create_files(manifest.where(F.col(TABLE).isNotNull()), files),
            check(
                rows,
                [
                    Rule(
                        "unsafe-identifier",
                        ~names.is_safe_identifier(F.col(DATABASE)),
                        subject,
                        F.lit("unsupported database name"),
                    ),
                    Rule(
                        "unsafe-identifier",
                        ~names.is_safe_identifier(F.col(TABLE)),
                        subject,
                        F.lit("unsupported table name"),
                    ),
                    Rule(
                        "invalid-view-flag",
                        flag.isNotNull() & ~flag.isin("0", "1"),
                        subject,
                        F.concat(F.lit("view flag "), flag),
                    ),
                    Rule("missing-schema", ~F.col("has_schema"), subject, F.lit("no schema file")),
                    Rule(
                        "missing-view",
                        view & ~F.col("has_view"),
                        subject,
                        F.lit("no view definition"),
                    ),
                    Rule(
                        "unexpected-view",
                        ~view & F.col("has_view"),
                        subject,
                        F.lit("view definition of a table"),
                    ),
                    Rule("missing-data", _needs_data(), subject, F.lit("rows but no data file")),
                ],
            ),
        ]
    )


def file_count_findings(files: DataFrame, expected: Column) -> DataFrame:
    """The number of files on disk against the number a run reported."""
    counted = files.agg(F.count(F.lit(1)).alias("found")).withColumn("expected", expected)
    return check(
        counted,
        [
            Rule(
                "file-count",
                F.col("found") != F.col("expected"),
                F.lit("artifact"),
                F.concat(
                    F.lit("expected "),
                    F.col("expected").cast("string"),
                    F.lit(", found "),
                    F.col("found").cast("string"),
                ),
            )
        ],
    )


def emptiness_findings(manifest: DataFrame, database: str) -> DataFrame:
    """A manifest without one restorable object of the wanted database."""
    counted = manifest.agg(
        F.count_if((F.col(DATABASE) == database) & F.col(TABLE).isNotNull()).alias("n")
    )
    return check(
        counted,
        [
            Rule(
                "empty-artifact",
                F.col("n") == 0,
                F.lit(database),
                F.lit("no restorable objects"),
            )
        ],
    )
