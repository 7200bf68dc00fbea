"""Column expressions on names: globs, quoting, safe identifiers, slugs, lists and paths."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed

# One character of a glob; a line terminator is never matched by a wildcard.
_ANY = r"[^\n\r\x{2028}\x{2029}]"


def glob_regex(glob: str) -> str:
    """Anchored regex of a glob with ``*`` (any run) and ``?`` (one character) only."""
    wildcards = {"*": _ANY + "*", "?": _ANY}
    pieces = re.split(r"([*?])", glob)
    return r"\A" + "".join(wildcards.get(p, re.escape(p)) for p in pieces) + r"\z"


def is_qualified(pattern: str) -> bool:
    """A pattern names a database and a table, divided by its first dot."""
    database, dot, table = pattern.partition(".")
    return bool(database and dot and table)


def glob_match(pattern: str, database: Column, table: Column) -> Column:
    """True where both halves of a qualified pattern match; literal halves compare by equality."""
    left, _, right = pattern.partition(".")

    def half(glob: str, value: Column) -> Column:
        if glob.strip("*") == "" and glob:
            return value.rlike(glob_regex("*"))
        if re.search(r"[*?]", glob):
            return value.rlike(glob_regex(glob))
        return value == F.lit(glob)

    return half(left, database) & half(right, table)


def matched_patterns(patterns: Sequence[str], database: Column, table: Column) -> Column:
    """Array of the patterns matching one catalog row.

    Patterns are a driver-side list, so they become expressions of the scan: neither a cross join nor
    a broadcast is needed, whatever the size of the catalog.
    """
    if not patterns:
        return F.array().cast("array<string>")
    hits = [F.when(glob_match(p, database, table), F.lit(p)) for p in patterns]
    return F.filter(F.array(*hits), lambda p: p.isNotNull())


def matches_any(patterns: Sequence[str], database: Column, table: Column) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | glob_match(pattern, database, table)
    return F.coalesce(hit, F.lit(False))


def quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_table(database: Column, table: Column) -> Column:
    return F.concat(quoted(database), F.lit("."), quoted(table))


def section_heading(database: Column, table: Column) -> Column:
    """Heading of an object's manifest section; names with backticks have none (see the rules)."""
    return F.concat(F.lit("[`"), database, F.lit("`.`"), table, F.lit("`]"))


def is_safe_identifier(name: Column) -> Column:
    return F.coalesce(
        name.rlike(fixed.SAFE_IDENTIFIER_PATTERN) & ~name.startswith(fixed.RESERVED_PREFIX),
        F.lit(False),
    )


def safe_token(value: Column, fallback: str) -> Column:
    return F.when(value.rlike(fixed.SAFE_TOKEN_PATTERN), value).otherwise(F.lit(fallback))


def slug(name: Column) -> Column:
    """Key made from a name: runs of other characters become a dash, outer dashes go."""
    dashed = F.regexp_replace(name, "[^A-Za-z0-9_-]+", "-")
    trimmed = F.regexp_replace(F.regexp_replace(dashed, r"\A-+", ""), r"-+\z", "")
    return F.when(trimmed == "", F.lit("database")).otherwise(trimmed)


def trimmed(text: Column) -> Column:
    """Without outer white space of any kind (Spark's own trim takes blanks only)."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def name_list(text: Column) -> Column:
    """Comma-separated text as an array of trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(text, ","), trimmed), lambda item: item != "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def dated_name(key: Column, day: Column) -> Column:
    return F.concat_ws("-", key, F.date_format(day, "yyyy-MM-dd"))


def expand_date_template(text: Column, day: Column) -> Column:
    return F.replace(text, F.lit("{{date}}"), F.date_format(day, "yyyy-MM-dd"))


def leaves_root(path: Column) -> Column:
    """True where a relative path climbs above its root at any step, or ends in a ``..`` name."""
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(False).alias("climbed")
    )

    def step(state: Column, segment: Column) -> Column:
        up = segment == ".."
        at_root = F.size(state["kept"]) == 0
        kept = (
            F.when(segment.isin("", "."), state["kept"])
            .when(up & at_root, state["kept"])
            .when(up, F.slice(state["kept"], F.lit(1), F.size(state["kept"]) - 1))
            .otherwise(F.concat(state["kept"], F.array(segment)))
        )
        return F.struct(kept.alias("kept"), (state["climbed"] | (up & at_root)).alias("climbed"))

    def verdict(state: Column) -> Column:
        first = F.coalesce(F.try_element_at(state["kept"], F.lit(1)), F.lit(""))
        return state["climbed"] | first.startswith("..")

    return F.aggregate(F.split(path, "/"), start, step, verdict)


def is_unsafe_path(path: Column) -> Column:
    return (path == "") | path.startswith("/") | leaves_root(path)
