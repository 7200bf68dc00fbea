"""Column expressions that give raw run-log fields their meaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed


def phase_of(source_phase: Column, tool: Column, exporter: str = "exporter") -> Column:
    """Normal phase of a tool's own phase name; the first matching line wins."""
    name = F.lower(source_phase)
    return (
        F.when(name.rlike("start|initial"), "startup")
        .when(name.rlike("lock|snapshot"), "locking")
        .when(name.rlike("verify|check"), "verification")
        .when(name.rlike("final|cleanup|complete"), "finalization")
        .when(tool == exporter, "backup")
        .otherwise("restore")
    )


def type_of(
    status: Column,
    fatal: Column,
    level: Column,
    event: Column,
    completion_events: Sequence[str] = fixed.COMPLETION_EVENTS,
) -> Column:
    """Kind of an event; the order of the cases is their precedence."""
    return (
        F.when(status == "cancelled", "cancelled")
        .when(F.coalesce(fatal, F.lit(False)) | (status == "failed"), "error")
        .when((status == "warning") | (F.lower(level) == "warning"), "warning")
        .when(status == "progress", "progress")
        .when((status == "finished") & event.isin(*completion_events), "completion")
        .otherwise("status")
    )


def status_of(source_status: Column) -> Column:
    """State told by a status event."""
    return (
        F.when(source_status == "started", "started")
        .when(source_status == "finished", "completed")
        .otherwise("running")
    )


def carries_message(type_: Column) -> Column:
    return type_.isin("status", "warning", "error", "cancelled")


def progress_text(completed: Column, total: Column) -> Column:
    """``done/all`` only where both are known; null otherwise, never a guess."""
    return F.when(
        completed.isNotNull() & total.isNotNull(), F.concat_ws("/", completed, total)
    )


def label_of(
    phase: Column, type_: Column, completed: Column, total: Column, message: Column
) -> Column:
    done = F.when(type_ == "progress", progress_text(completed, total))
    words = F.when(carries_message(type_) & (message != ""), message)
    return F.concat(phase, F.lit(": "), F.coalesce(done, words, type_))


def shown_at(verbosity: str, type_: Column, status: Column) -> Column:
    """Whether an event is shown: ``quiet`` none, ``default`` the notable ones, ``verbose`` all."""
    if verbosity == "quiet":
        return F.lit(False)
    if verbosity == "verbose":
        return F.lit(True)
    notable = type_.isin("warning", "error", "cancelled", "completion")
    return notable | ((type_ == "status") & (status != "running"))


def public_event(columns: Mapping[str, Column]) -> Column:
    """The fields of an event that may be shown, in their fixed order."""
    hidden = set(columns) - set(fixed.PUBLIC_FIELDS)
    if hidden:
        raise ValueError(f"no public fields: {sorted(hidden)}")
    shown = [n for n in fixed.PUBLIC_FIELDS if n in columns]
    return F.named_struct(*[part for n in shown for part in (F.lit(n), columns[n])])


def _output_line(kind: str, command: str, **members: Column) -> Column:
    """One line of versioned output; absent fields are left out."""
    head = {"schemaVersion": F.lit(1), "type": F.lit(kind), "command": F.lit(command)}
    return F.to_json(F.named_struct(*[part for n, c in (head | members).items() for part in (F.lit(n), c)]))


def envelope(event: Column, command: str) -> Column:
    """Output line of an event."""
    return _output_line("event", command, event=event)


def result_envelope(result: Column, command: str) -> Column:
    """Output line that ends a command that succeeded."""
    return _output_line("result", command, ok=F.lit(True), result=result)


def error_envelope(code: Column, message: Column, command: str) -> Column:
    """Output line that ends a command that failed; ``code`` is its exit code, ``message`` is scrubbed already."""
    error = F.named_struct(F.lit("code"), outcome_name(code), F.lit("message"), message)
    return _output_line("error", command, ok=F.lit(False), error=error)


def outcome_code(cancelled: Column, usage_error: Column, failed: Column) -> Column:
    return F.when(cancelled, 130).when(usage_error, 2).when(failed, 1).otherwise(0)


def outcome_name(code: Column) -> Column:
    return (
        F.when(code == 130, "CANCELLED")
        .when(code == 2, "INVALID_USAGE")
        .when(code == 0, "OK")
        .otherwise("OPERATION_FAILED")
    )


def is_counter(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.COUNTER_PATTERN), F.lit(False))


def counter(text: Column) -> Column:
    """Exact number of a counter text; null where it has over 38 digits (the text stays)."""
    return text.try_cast("decimal(38,0)")


def is_safe_integer(text: Column) -> Column:
    """Whether a counter text fits a double without loss."""
    return F.coalesce(counter(text) <= F.lit(fixed.SAFE_INTEGER_MAX), F.lit(False))


def zero_one(text: Column) -> Column:
    """Boolean of a 0/1 text; anything else is null and a matter for a rule."""
    return F.when(text == "1", True).when(text == "0", False)
