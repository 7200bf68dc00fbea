"""Strict reading of JSON run-log lines: typed events, or the reason a line is refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.functions import events as ev

# Why a line is refused, in the order the checks are made.
REASONS = (
    "malformed",
    "version",
    "tool",
    "seq",
    "parent_seq",
    "ts",
    "event",
    "phase",
    "status",
    "level",
    "fatal",
    "retryable",
    *(f"counter:{name}" for name in fixed.COUNTERS),
    "run_id",
    "unknown-status",
    "completion:missing",
    "completion:exit_code",
    "completion:duration_ms",
)

# Fields of a line that mean something; others may be there.
FIELDS = (
    "schema_version",
    "event_version",
    "tool",
    "seq",
    "parent_seq",
    "ts",
    "event",
    "phase",
    "status",
    "level",
    "message",
    "fatal",
    "retryable",
    "run_id",
    "database",
    "db",
    "table",
    *fixed.COUNTERS,
)

EVENT_COLUMNS = (
    "run_id",
    "sequence",
    "parent_sequence",
    "timestamp",
    "event_time",
    "phase",
    "tool",
    "type",
    "status",
    "source_event",
    "source_phase",
    "source_status",
    "database_name",
    "table_name",
    "message",
    "fatal",
    "retryable",
    "rows",
    "bytes",
    "retries",
    "warnings",
    "errors",
    "completed",
    "total",
    "files",
    "exit_code",
    "duration_ms",
)


def _one_object(line: Column, listed: Column) -> Column:
    """Variant of a line that is exactly one JSON object, else null.

    The parser ignores text after the first value, so the line is parsed as the only entry of an
    array (``listed``); a line that could close that array early is also parsed as an object's member.
    """
    member = F.try_parse_json(F.concat(F.lit('{"m":'), line, F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    closes_early = F.contains(line, F.lit("]")) & member.isNull()
    looks_like_object = line.rlike(r"\A[ \t\r\n]*\{")
    return F.when(
        looks_like_object & alone & ~closes_early, F.try_variant_get(listed, "$[0]", "variant")
    )


def _whole_number(type_: Column, text: Column) -> Column:
    """Long of a JSON number that is a safe whole number, else null."""
    numeric = type_.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    exact = F.when(numeric, text.try_cast("decimal(38,10)"))
    bound = F.lit(fixed.SAFE_INTEGER_MAX)
    return F.when((exact == F.floor(exact)) & (F.abs(exact) <= bound), exact.cast("long"))


def parse_lines(
    lines: DataFrame,
    tool: str,
    line: str = "line",
    completion_events: Sequence[str] = fixed.COMPLETION_EVENTS,
    known_keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``reason`` (null = accepted) and the event columns to a table of log lines.

    The JSON type of each value is checked besides its text, because a cast would turn a JSON number
    into a counter text, or a text into a number, without a word. Lines may hold unknown fields; when
    ``known_keys`` is given, ``unknown_keys`` lists them. Everything is one projection.
    """
    parsed = (
        lines.withColumn("_line", F.regexp_replace(line, r"\r\z", ""))
        .withColumn("_listed", F.try_parse_json(F.concat(F.lit("["), "_line", F.lit("]"))))
        .withColumn("_v", _one_object(F.col("_line"), F.col("_listed")))
        .withColumn("_members", F.try_variant_get("_v", "$", _struct_of("variant")))
        .withColumn("_texts", F.try_variant_get("_v", "$", _struct_of("string")))
        .withColumn(
            "_types", _named({n: F.schema_of_variant(F.col(f"_members.{n}")) for n in FIELDS})
        )
    )
    raw = {"types": F.col("_types"), "texts": F.col("_texts"), "malformed": F.col("_v").isNull()}
    judged = (
        parsed.withColumn("_raw", _named(raw))
        .withColumn("_read", _readings(F.col("_raw"), completion_events))
        .withColumn("_event", _judge(F.col("_read"), tool))
    )
    kept = [c for c in lines.columns if c not in EVENT_COLUMNS]
    if known_keys:
        known = F.array(*[F.lit(k) for k in known_keys])
        keys = F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>"))
        judged = judged.withColumn("unknown_keys", F.array_sort(F.array_except(keys, known)))
        kept.append("unknown_keys")
    # Unpacking through a generator keeps later filters on the result from being pushed down, where
    # each use of a parsed value would be replaced by parsing the line again.
    unpacked = judged.select(*kept, F.inline(F.array("_event")))
    ok = F.col("reason").isNull()
    columns = [F.when(ok, F.col(n)).alias(n) for n in EVENT_COLUMNS]
    return unpacked.select(*kept, "reason", *columns)


def _struct_of(type_: str) -> str:
    return "struct<" + ",".join(f"{n}:{type_}" for n in FIELDS) + ">"


def _named(columns: dict[str, Column]) -> Column:
    """Struct whose names survive any projection."""
    return F.named_struct(*[part for n, c in columns.items() for part in (F.lit(n), c)])


def _readings(raw: Column, completion_events: Sequence[str]) -> Column:
    """What the checks share: types, texts of the JSON strings, whole numbers and the event's type."""
    types, values = raw["types"], raw["texts"]
    texts = {n: F.when(types[n] == "STRING", values[n]) for n in FIELDS}
    is_fatal = values["fatal"] == "true"
    return _named(
        {
            "malformed": raw["malformed"],
            "types": types,
            "texts": _named(texts),
            "seq": _whole_number(types["seq"], values["seq"]),
            "parent": _whole_number(types["parent_seq"], values["parent_seq"]),
            "is_fatal": is_fatal,
            "retryable": values["retryable"] == "true",
            "type": ev.type_of(
                texts["status"], is_fatal, texts["level"], texts["event"], completion_events
            ),
        }
    )


def _judge(read: Column, tool: str) -> Column:
    """Struct of the reason a line is refused and of its event's fields."""

    def text(name: str) -> Column:
        return read["texts"][name]

    def given(name: str) -> Column:
        return read["types"][name].isNotNull()

    def is_boolean(name: str) -> Column:
        return read["types"][name].eqNullSafe(F.lit("BOOLEAN"))

    def absent(name: str) -> Column:
        return F.coalesce(text(name) == "", F.lit(True))

    def version(name: str) -> Column:
        return ~text(name).eqNullSafe(F.lit(fixed.SUPPORTED_LOG_VERSION))

    seq, parent, type_ = read["seq"], read["parent"], read["type"]
    finished, is_progress = type_ == "completion", type_ == "progress"
    needed = ("exit_code", "errors", "warnings", "retries", "files")
    lacks = F.array_contains(F.array(*[text(n).isNull() for n in needed]), True)
    tests: dict[str, Column] = {
        "malformed": read["malformed"],
        "version": version("schema_version") | version("event_version"),
        "tool": ~text("tool").eqNullSafe(F.lit(tool)),
        "seq": F.coalesce(seq < 0, F.lit(True)),
        "parent_seq": given("parent_seq") & F.coalesce(parent < 0, F.lit(True)),
        "ts": ~F.coalesce(text("ts").rlike(fixed.TIMESTAMP_PATTERN), F.lit(False)),
        "event": absent("event"),
        "phase": absent("phase"),
        "status": absent("status"),
        "level": absent("level"),
        "fatal": ~is_boolean("fatal"),
        "retryable": given("retryable") & ~is_boolean("retryable"),
        **{f"counter:{n}": given(n) & ~ev.is_counter(text(n)) for n in fixed.COUNTERS},
        "run_id": absent("run_id"),
        "unknown-status": ~text("status").isin(*fixed.SOURCE_STATUSES),
        "completion:missing": finished & lacks,
        "completion:exit_code": finished & ~ev.is_safe_integer(text("exit_code")),
        "completion:duration_ms": finished
        & given("duration_ms")
        & ~ev.is_safe_integer(text("duration_ms")),
    }
    fields = {
        "reason": F.coalesce(*[F.when(tests[r], F.lit(r)) for r in REASONS]),
        "run_id": text("run_id"),
        "sequence": seq,
        "parent_sequence": parent,
        "timestamp": text("ts"),
        "event_time": F.try_to_timestamp(text("ts")),
        "phase": ev.phase_of(text("phase"), text("tool")),
        "tool": text("tool"),
        "type": type_,
        "status": F.when(type_ == "status", ev.status_of(text("status"))),
        "source_event": text("event"),
        "source_phase": text("phase"),
        "source_status": text("status"),
        "database_name": F.when(
            F.coalesce(read["types"]["database"] == "VOID", F.lit(True)), text("db")
        ).otherwise(text("database")),
        "table_name": text("table"),
        "message": F.when(ev.carries_message(type_), F.coalesce(text("message"), text("event"))),
        "fatal": F.when(type_ == "error", read["is_fatal"]),
        "retryable": F.when(type_ == "error", read["retryable"]),
        "rows": F.coalesce(text("rows"), text("rows_done")),
        "bytes": text("bytes"),
        "retries": text("retries"),
        "warnings": text("warnings"),
        "errors": text("errors"),
        "completed": F.when(is_progress, F.coalesce(text("completed"), text("rows_done"))),
        "total": F.when(is_progress, F.coalesce(text("total"), text("rows_total"))),
        "files": F.when(finished, text("files")),
        "exit_code": F.when(finished, text("exit_code").try_cast("long")),
        "duration_ms": F.when(finished, text("duration_ms").try_cast("long")),
    }
    return _named(fields)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def quarantine(parsed: DataFrame, line: str = "line") -> DataFrame:
    """Refused lines with the first reason each."""
    return parsed.where(F.col("reason").isNotNull()).select(line, "reason")
