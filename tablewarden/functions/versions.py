"""Versions whose parts have any number of digits, as keys Spark can sort and compare natively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789"


def _parts(text: Column, separators: Sequence[str]) -> list[Column]:
    """Text between the separators in the order given: each is looked for in what the one before left."""
    parts, rest = [], text
    for separator in separators:
        parts.append(F.substring_index(rest, separator, 1))
        rest = F.substr(rest, F.length(parts[-1]) + 2)
    return [*parts, rest]


def _key(text: Column, separators: Sequence[str]) -> Column:
    """Sortable key of numbers of any length; null unless the text is just that, so the parts put together again."""
    parts = _parts(text, separators)
    whole = F.concat(parts[0], *[F.concat(F.lit(s), p) for s, p in zip(separators, parts[1:])])
    good = whole == text
    for part in parts:
        good = good & (part != "") & (F.translate(part, _DIGITS, "") == "")
    numbers = [F.coalesce(F.nullif(F.ltrim(part, F.lit("0")), F.lit("")), F.lit("0")) for part in parts]
    return F.when(good, F.array(*[F.struct(F.length(n).alias("len"), n.alias("digits")) for n in numbers]))


def version_key(text: Column) -> Column:
    """Sortable key of ``a.b.c-d``; null where the text is no such version."""
    return _key(text, (".", ".", "-"))


def triple_key(text: Column) -> Column:
    """Sortable key of ``a.b.c``, a ``v`` before it allowed."""
    return _key(F.when(text.startswith("v"), F.substr(text, F.lit(2))).otherwise(text), (".", "."))


def compare_keys(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two keys; keys kept in columns are built once, not once per comparison."""
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).when(a == b, F.lit(0))


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1; null where either side is no version."""
    return compare_keys(version_key(left), version_key(right))


def version_at_least(actual: Column, minimum: Column) -> Column:
    return F.coalesce(version_key(actual) >= version_key(minimum), F.lit(False))


def triple_at_least(actual: Column, minimum: Column) -> Column:
    return F.coalesce(triple_key(actual) >= triple_key(minimum), F.lit(False))


def printed_version(text: Column, tool: str) -> Column:
    """Version in a tool's own version line; null where the line is not exactly that."""
    begin, middle = f"{tool} v", ", built against "
    # One line end may follow, and nothing else.
    line = F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2)).when(
        text.endswith("\n") | text.endswith("\r"), F.left(text, F.length(text) - 1)
    ).otherwise(text)
    version = F.substring_index(F.substr(line, F.lit(len(begin) + 1)), middle, 1)
    library = F.substr(line, F.length(version) + len(begin + middle) + 1)
    exact = (
        (F.concat(F.lit(begin), version, F.lit(middle), library) == line)
        & (library != "")
        & (F.translate(library, "\r\n", "") == library)
        & version_key(version).isNotNull()
    )
    return F.when(exact, version)
