"""Scrubbing of secrets from text columns and from nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden import fixed_values as fixed

# Terminal control sequences: operating-system commands with any of their three ends, then control
# sequences, then escapes of an optional intermediate and one final character.
CONTROL_SEQUENCES = (
    r"\x1B\][^\x07\x1B\x{9C}]*(?:\x07|\x1B\\|\x{9C})"
    r"|(?:\x1B\[|\x{9B})[0-?]*[ -/]*[@-~]"
    r"|\x1B[ -/]*[0-Z\\^-~]"
)
BINARY = "[binary]"

# White space beyond ASCII is named one by one, so that every regex engine reads it alike.
_SPACE = (
    r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)


def assignment_pattern(keys: Sequence[str] = fixed.SECRET_ASSIGNMENT_KEYS) -> str:
    """The fixed pattern of an assigned secret, for other key words too, with every blank named."""
    pattern = fixed.SECRET_ASSIGNMENT_PATTERN.replace("|".join(fixed.SECRET_ASSIGNMENT_KEYS), "|".join(keys))
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]")


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_SEQUENCES, "")


def hide_literals(text: Column, secrets: Sequence[str]) -> Column:
    """Replace known secrets, longest first so that one containing another goes as a whole."""
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(fixed.REDACTED))
    return text


def hide_literals_of(text: Column, secrets: Column) -> Column:
    """Like :func:`hide_literals` with the secrets in an array column of the same row."""
    known = F.filter(F.array_distinct(secrets), lambda s: s != "")
    longest_first = F.array_sort(
        known,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1)
        .when(a > b, 1)
        .otherwise(0),
    )
    return F.aggregate(
        longest_first, text, lambda t, s: F.replace(t, s, F.lit(fixed.REDACTED))
    )


def hide_assignments(
    text: Column, keys: Sequence[str] = fixed.SECRET_ASSIGNMENT_KEYS
) -> Column:
    return F.regexp_replace(text, "(?iu)" + assignment_pattern(keys), "$1" + fixed.REDACTED)


def clean(
    text: Column,
    secrets: Sequence[str] = (),
    keys: Sequence[str] = fixed.SECRET_ASSIGNMENT_KEYS,
) -> Column:
    """One safe line: control sequences out, secrets hidden, line breaks as single spaces."""
    hidden = hide_assignments(hide_literals(strip_control(text), secrets), keys)
    return F.regexp_replace(hidden, r"[\r\n]+", " ")


def clean_lines(
    text: Column,
    secrets: Sequence[str] = (),
    keys: Sequence[str] = fixed.SECRET_ASSIGNMENT_KEYS,
) -> Column:
    """Array of safe lines."""
    return F.transform(
        F.split(strip_control(text), r"\r?\n"), lambda line: clean(line, secrets, keys)
    )


def is_sensitive(name: str | Column) -> Column:
    column = F.lit(name) if isinstance(name, str) else name
    return column.rlike(fixed.SENSITIVE_KEY_PATTERN)


def _sensitive_name(name: str) -> bool:
    import re

    return re.search(fixed.SENSITIVE_KEY_PATTERN, name) is not None


def clean_value(
    value: Column, dtype: T.DataType, secrets: Sequence[str] = (), name: str | None = None
) -> Column:
    """Safe form of a value of any type; the walk follows the schema, so it costs nothing per row.

    Sensitive fields become the marker whatever they hold. Text is cleaned. Integers too wide for
    a JSON reader, decimals, dates and times become text.
    """
    if name is not None and _sensitive_name(name):
        return F.lit(fixed.REDACTED)
    if isinstance(dtype, T.StringType):
        return clean(value, secrets)
    if isinstance(dtype, (T.LongType, T.DecimalType)):
        return value.cast("string")
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        # What is written as UTC must be UTC; times without a zone are taken as they are.
        utc = F.to_utc_timestamp(value, F.current_timezone()) if isinstance(dtype, T.TimestampType) else value
        return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(dtype, T.BinaryType):
        return F.when(value.isNotNull(), F.lit(BINARY))
    if isinstance(dtype, T.VariantType):
        return clean_json(F.to_json(value), secrets)
    if isinstance(dtype, T.StructType):
        fields = [
            clean_value(value[f.name], f.dataType, secrets, f.name).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: clean_value(item, dtype.elementType, secrets))
    if isinstance(dtype, T.MapType) and not isinstance(dtype.keyType, T.StringType):
        return F.transform_values(value, lambda key, item: clean_value(item, dtype.valueType, secrets))
    if isinstance(dtype, T.MapType):
        return F.transform_values(
            value,
            lambda key, item: F.when(is_sensitive(key), F.lit(fixed.REDACTED)).otherwise(
                _as_text(clean_value(item, dtype.valueType, secrets), dtype.valueType)
            ),
        )
    return value


def clean_json(text: Column, secrets: Sequence[str] = ()) -> Column:
    """Safe form of JSON text whose shape is not known: members with sensitive names hold the marker.

    Where such a member holds an object or a list, the whole text becomes the marker, as its end cannot
    be told without a parser.
    """
    name = rf'"(?=[^"]*"\s*:)(?:[^"\\]|\\.)*(?:{fixed.SENSITIVE_KEY_PATTERN})(?:[^"\\]|\\.)*"\s*:\s*'
    scalar = r'(?:"(?:[^"\\]|\\.)*"|[^\s"{}\[\],]+)'
    hidden = F.regexp_replace(text, f"({name}){scalar}", '$1"' + fixed.REDACTED + '"')
    return F.when(text.rlike(name + r"[\[{]"), F.lit(fixed.REDACTED)).otherwise(clean(hidden, secrets))


def _as_text(value: Column, dtype: T.DataType) -> Column:
    """Values of a scrubbed map share one type with the marker, so nested ones become JSON text."""
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def clean_records(df: DataFrame, secrets: Sequence[str] = ()) -> DataFrame:
    """Every column of a table in its safe form."""
    return df.select(
        *[
            clean_value(F.col(f"`{f.name}`"), f.dataType, secrets, f.name).alias(f.name)
            for f in df.schema.fields
        ]
    )


def public_projection(df: DataFrame, secret: str, marker: str = "passwordConfigured") -> DataFrame:
    """Drop a secret column, telling only whether it was set."""
    return df.withColumn(marker, F.col(secret).isNotNull()).drop(secret)


def public_value(value: Column, dtype: T.DataType, secret: str, marker: str = "passwordConfigured") -> Column:
    """The same inside a value: every record of a registry, in maps, lists and records at any depth.

    A record that has the field ``secret`` loses it and tells by ``marker``, in its place at the end,
    whether it was set; null records stay null, and keys of maps are kept.
    """
    if isinstance(dtype, T.StructType):
        fields = [public_value(value[f.name], f.dataType, secret, marker).alias(f.name) for f in dtype.fields if f.name != secret]
        if secret in dtype.fieldNames():
            fields.append(value[secret].isNotNull().alias(marker))
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, entry: public_value(entry, dtype.valueType, secret, marker))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda entry: public_value(entry, dtype.elementType, secret, marker))
    return value
