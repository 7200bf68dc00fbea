"""Judging runs by their events.

Almost everything is a mergeable aggregate per run: the smallest position of an event, the value at
the largest. Events combine before the shuffle, so a run holding most events is no problem. Rules that
need a true scan take runs in stretches (see ``ordered``); the verdict reads the log once and folds one
summary per stretch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden import fixed_values as fixed
from tablewarden.functions import events as ev
from tablewarden.operators import ordered

# (event, phase, status); None fits anything.
Transition = tuple[str | None, str | None, str | None]


@dataclass(frozen=True)
class RunLog:
    """Typed events and the columns that order them.

    ``order`` must be unique within a run; ``at`` is the event's timestamp.
    """

    events: DataFrame
    order: tuple[str, ...] = ("sequence",)
    run: str = "run_id"
    at: str = "event_time"

    @property
    def position(self) -> Column:
        return F.struct(*self.order)

    @property
    def ordinal(self) -> Column:
        """The order as one number, so that aggregates of it hash instead of sorting.

        A time and a non-negative number make a decimal (19 digits for the number); other orders
        stay structs, which Spark aggregates by sorting.
        """
        lead, *rest = self.order
        if not rest:
            return F.col(lead)
        types = [self.events.schema[c].dataType.typeName() for c in self.order]
        if len(rest) == 1 and types[0].startswith("timestamp") and types[1] in ("long", "integer"):
            shifted = self.cutter.cast("decimal(18,0)") * F.lit(Decimal(10**19)).cast("decimal(20,0)")
            return (shifted + F.col(rest[0]).cast("decimal(19,0)")).cast("decimal(38,0)")
        return self.position

    @property
    def micros(self) -> Column:
        return F.unix_micros(F.col(self.at).cast("timestamp"))

    @property
    def cutter(self) -> Column:
        """The leading order column as a long: what hot runs are cut by."""
        lead = self.order[0]
        if self.events.schema[lead].dataType.typeName().startswith("timestamp"):
            return F.unix_micros(F.col(lead).cast("timestamp"))
        return F.col(lead).cast("long")

    @property
    def width(self) -> int:
        """How wide a stretch of ``cutter`` one scan takes."""
        timed = self.events.schema[self.order[0]].dataType.typeName().startswith("timestamp")
        return ordered.MICROS_PER_STRETCH if timed else ordered.ROWS_PER_STRETCH


def is_transition(step: Transition) -> Column:
    hit = F.lit(True)
    for name, value in zip(("source_event", "source_phase", "source_status"), step, strict=True):
        if value is not None:
            hit = hit & (F.col(name) == value)
    return F.coalesce(hit, F.lit(False))


def _lifecycle_aggregates(steps: Sequence[Transition], position: Column) -> list[Column]:
    parts = []
    for i, step in enumerate(steps):
        hit = is_transition(step)
        parts.append(F.count_if(hit).alias(f"_seen{i}"))
        parts.append(F.min(F.when(hit, position)).alias(f"_at{i}"))
    return parts


def _lifecycle_status(steps: Sequence[Transition]) -> Column:
    """Events seen once each and in order up to some step, and not at all beyond it."""

    def reached(count: int) -> Column:
        good = F.lit(True)
        for i in range(len(steps)):
            good = good & (F.col(f"_seen{i}") == (1 if i < count else 0))
            if 0 < i < count:
                good = good & (F.col(f"_at{i - 1}") < F.col(f"_at{i}"))
        return good

    partial = F.lit(False)
    for count in range(len(steps)):
        partial = partial | reached(count)
    return (
        F.when(reached(len(steps)), "complete").when(partial, "incomplete").otherwise("reordered")
    )


def lifecycle(
    log: RunLog, steps: Sequence[Transition] = fixed.EXPORT_LIFECYCLE, also_by: Sequence[Column] = ()
) -> DataFrame:
    """Per run: ``complete``, ``incomplete`` (a clean beginning) or ``reordered``.

    A recognised event that repeats or comes early makes the run ``reordered``; other events do not
    matter. No scan is needed: each step's count and first position tell everything.
    """
    seen = F.lit(0)
    for i in range(len(steps)):
        seen = seen + F.col(f"_seen{i}")
    return (
        log.events.groupBy(log.run, *also_by)
        .agg(*_lifecycle_aggregates(steps, log.ordinal))
        .select(log.run, _lifecycle_status(steps).alias("lifecycle"), seen.alias("recognised"))
    )


def alternation(df: DataFrame, key: str, turn: str, role: str, first: str, cycle: Sequence[str]) -> DataFrame:
    """Per key: whether roles follow an optional ``first``, then ``cycle`` over and over.

    Both readings (with and without the optional opening) are counted in the one aggregate, and the
    number of openings decides which applies.
    """
    words = F.array(*[F.lit(c) for c in cycle])

    def expected(shift: int) -> Column:
        return F.element_at(words, (F.pmod(F.col(turn) - shift, F.lit(len(cycle))) + 1).cast("int"))

    opening = F.col(role) == first
    at_start = opening & (F.col(turn) == 0)

    def wrong(shift: int) -> Column:
        return F.count_if(~opening & (F.col(role) != expected(shift)))

    return (
        df.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("turns"),
            F.count_if(at_start).alias("_opened"),
            F.count_if(opening & ~at_start).alias("_late"),
            wrong(0).alias("_plain"),
            wrong(1).alias("_shifted"),
            (F.max(turn) - F.min(turn) + 1 - F.count(F.lit(1))).alias("gaps"),
        )
        .select(
            key,
            "turns",
            "gaps",
            (F.col("_late") + F.when(F.col("_opened") > 0, F.col("_shifted")).otherwise(F.col("_plain"))).alias(
                "out_of_order"
            ),
        )
    )


def sequence_report(events: DataFrame, run: str, seq: str, parent: str) -> DataFrame:
    """Per run: sequence numbers that are no safe counts, repeats and gaps."""

    def bad(name: str) -> Column:
        return (F.col(name) < 0) | (F.col(name) > fixed.SAFE_INTEGER_MAX)

    once = events.groupBy(run, seq).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(bad(parent)).alias("_bad_parent")
    )
    return once.groupBy(run).agg(
        F.sum(F.when(F.col(seq).isNull() | bad(seq), F.col("_n")).otherwise(0)).alias("bad_sequence"),
        F.sum("_bad_parent").alias("bad_parent"),
        F.sum(F.col("_n") - 1).alias("repeats"),
        (F.max(seq) - F.min(seq) + 1 - F.count(seq)).alias("gaps"),
    )


def lock_windows(
    log: RunLog,
    lock: Transition = fixed.EXPORT_LIFECYCLE[0],
    progress: Transition = fixed.EXPORT_LIFECYCLE[3],
    budget_seconds: int = fixed.LOCK_BUDGET_SECONDS,
    width: int | None = None,
) -> DataFrame:
    """Every lock start that arms the watchdog, with the progress that releases it.

    A lock start arms only when none is armed, that is when no other came since the last progress.
    ``outcome`` is ``in_time``, ``late`` or ``never``; the last two are over budget.
    """
    run, stretch = log.run, ordered.STRETCH
    kind = F.when(is_transition(lock), "lock").when(is_transition(progress), "progress")
    marked = log.events.select(
        run, *log.order, log.cutter.alias("_cut"), log.micros.alias("_us"), kind.alias("_kind")
    ).where(F.col("_kind").isNotNull())
    cut = ordered.in_stretches(marked, F.col("_cut"), width or log.width)

    is_progress = F.col("_kind") == "progress"
    group = Window.partitionBy(run, stretch)
    # Looking ahead is a growing frame over the reverse order; the mirrored frame is quadratic.
    ahead = [F.col(c).desc() for c in log.order]
    backward = group.orderBy(*ahead).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn(
        "_next", F.last(F.when(is_progress, F.col("_us")), ignorenulls=True).over(backward)
    ).withColumn("_before", F.lag("_kind").over(group.orderBy(*log.order)))
    summaries = cut.groupBy(run, stretch).agg(
        F.min_by("_us", F.when(is_progress, log.position)).alias("_first_progress"),
        F.max_by("_kind", log.position).alias("_last_kind"),
    )
    earlier = Window.partitionBy(run).orderBy(stretch)
    later = Window.partitionBy(run).orderBy(F.col(stretch).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.select(
        run,
        stretch,
        F.last("_first_progress", ignorenulls=True).over(later).alias("_carried_next"),
        F.lag("_last_kind").over(earlier).alias("_carried_before"),
    )
    whole = (
        local.join(carried, [run, stretch], "left")
        .withColumn("_next", F.coalesce("_next", "_carried_next"))
        .withColumn("_before", F.coalesce("_before", "_carried_before"))
    )
    waited = F.col("_next") - F.col("_us")
    return whole.where(
        (F.col("_kind") == "lock") & ~F.col("_before").eqNullSafe(F.lit("lock"))
    ).select(
        run,
        *log.order,
        waited.alias("waited_us"),
        F.when(waited.isNull(), "never")
        .when(waited > budget_seconds * 1_000_000, "late")
        .otherwise("in_time")
        .alias("outcome"),
    )


def faults_after_unlock(
    log: RunLog,
    lock: Transition = fixed.EXPORT_LIFECYCLE[0],
    unlock: Transition = ("table_unlock", None, "finished"),
    progress: Transition = fixed.EXPORT_LIFECYCLE[3],
    width: int | None = None,
) -> DataFrame:
    """Warnings and errors that come after an unlock while the watchdog is armed.

    A fault counts when, since the last progress, there was a lock start and then an unlock. It is
    enough to look at the last unlock: any lock before an earlier one is before it too. The result
    has the fault's order columns, and the unlock's and its lock's as structs.
    """
    run, stretch, position = log.run, ordered.STRETCH, log.position
    kind = (
        F.when(is_transition(lock), "lock")
        .when(is_transition(unlock), "unlock")
        .when(is_transition(progress), "progress")
        .when(F.col("type").isin("warning", "error"), "fault")
    )
    # An unlock or a lock may itself be a warning: it is judged as a fault as well as a step.
    fault = F.col("type").isin("warning", "error")
    marked = log.events.select(
        run,
        *log.order,
        log.cutter.alias("_cut"),
        position.alias("_pos"),
        kind.alias("_kind"),
        F.coalesce(fault, F.lit(False)).alias("_fault"),
    ).where(F.col("_kind").isNotNull())
    cut = ordered.in_stretches(marked, F.col("_cut"), width or log.width)

    def at(name: str) -> Column:
        return F.when(F.col("_kind") == name, F.col("_pos"))

    group = Window.partitionBy(run, stretch).orderBy(*log.order)
    so_far = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Positions grow along the scan, so the last one seen is the largest. A progress event that is
    # itself a warning is judged before it releases the watchdog, hence the frame without it.
    opened = F.when(
        F.col("_kind") == "unlock",
        F.struct(F.col("_pos").alias("unlock"), F.col("_lock").alias("lock")),
    )
    local = (
        cut.withColumn("_lock", F.max(at("lock")).over(so_far))
        .withColumn("_progress", F.max(at("progress")).over(group.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_opened", opened)
        .withColumn("_open", F.max("_opened").over(so_far))
    )
    # What earlier stretches pass on: their last lock, progress, and unlock with the lock before it.
    before = Window.partitionBy(run).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    own_open = F.when(
        F.col("_o").isNotNull(),
        F.struct(F.col("_o.unlock").alias("unlock"), F.coalesce("_o.lock", "_lock_in").alias("lock")),
    )
    carried = (
        local.groupBy(run, stretch)
        .agg(F.max(at("lock")).alias("_l"), F.max(at("progress")).alias("_p"), F.max("_opened").alias("_o"))
        .withColumn("_lock_in", F.max("_l").over(before))
        .select(
            run,
            stretch,
            "_lock_in",
            F.max("_p").over(before).alias("_progress_in"),
            F.max(own_open).over(before).alias("_open_in"),
        )
    )
    seen = F.col("_open").isNotNull()
    whole = local.join(carried, [run, stretch], "left").select(
        run,
        *log.order,
        "_fault",
        F.when(seen, F.col("_open.unlock")).otherwise(F.col("_open_in.unlock")).alias("unlock"),
        F.when(seen, F.coalesce("_open.lock", "_lock_in")).otherwise(F.col("_open_in.lock")).alias("lock"),
        F.coalesce("_progress", "_progress_in").alias("_progress"),
    )
    since = F.col("_progress").isNull() | (F.col("lock") > F.col("_progress"))
    return whole.where(F.col("_fault") & F.col("lock").isNotNull() & since).select(
        run, *log.order, "unlock", "lock"
    )


# The watchdog for faults: nothing since the last progress, a lock, or a lock and then an unlock.
_IDLE, _LOCKED, _UNLOCKED = range(3)


def _watchdog_rows(
    events: DataFrame, log: RunLog, lock: Transition, unlock: Transition, progress: Transition, budget_us: int
) -> DataFrame:
    """Events in the order of their stretch, with what one pass over them tells of the watchdog.

    What came before the stretch is not known, so a lock with neither lock nor progress before it is
    only perhaps the one that arms, and a fault is told for each state the stretch may begin in.
    """
    scan = Window.partitionBy(log.run, ordered.STRETCH).orderBy(*log.order)
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    so_far = scan.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    armed_by = F.when(is_transition(lock), "lock").when(is_transition(progress), "progress")
    step = F.when(is_transition(lock), "lock").when(is_transition(unlock), "unlock").when(is_transition(progress), "progress")
    fault = F.coalesce(F.col("type").isin("warning", "error"), F.lit(False))

    def at(name: str) -> Column:
        return F.when(F.col("_step") == name, F.col("_pos"))

    marked = events.select(
        "*", armed_by.alias("_kind"), step.alias("_step"), fault.alias("_fault"),
        log.ordinal.alias("_pos"), log.micros.alias("_us"),
    )
    prior = F.last("_kind", ignorenulls=True).over(before)
    seen = (
        marked.withColumn("_prior", prior)
        .withColumn("_past_progress", F.max(at("progress")).over(before))
        .withColumn("_last_lock", F.max(at("lock")).over(so_far))
        .withColumn("_arms", F.coalesce((F.col("_kind") == "lock") & ~F.col("_prior").eqNullSafe(F.lit("lock")), F.lit(False)))
        .withColumn("_armed_us", F.last(F.when(F.col("_arms"), F.col("_us")), ignorenulls=True).over(so_far))
        .withColumn("_releases", F.count_if(F.col("_kind") == "progress").over(so_far))
        .withColumn("_unlock_seen", F.coalesce(F.bool_or(F.col("_step") == "unlock").over(so_far), F.lit(False)))
        # Of the last unlock: the lock before it; none counts as a position before all.
        .withColumn("_unlocks", F.when(F.col("_step") == "unlock", F.struct(F.col("_pos").alias("at"), F.col("_last_lock").alias("lock"))))
        .withColumn("_open_lock", F.max("_unlocks").over(so_far)["lock"])
    )
    from_here = F.col("_open_lock").isNotNull() & (
        F.col("_past_progress").isNull() | (F.col("_open_lock") > F.col("_past_progress"))
    )
    still = F.col("_past_progress").isNull()
    faults = {_IDLE: from_here, _LOCKED: from_here | (still & F.col("_unlock_seen")), _UNLOCKED: from_here | still}
    released = (F.col("_kind") == "progress") & (F.col("_prior") == "lock")
    late = released & (F.col("_releases") > 1) & (F.col("_us") - F.col("_armed_us") > budget_us)
    return seen.select(
        "*", late.alias("_late"), *[(F.col("_fault") & hit).alias(f"_fault{state}") for state, hit in faults.items()]
    )


def _watchdog_summary() -> list[Column]:
    """What a stretch tells to those after it, as aggregates over its rows."""

    def at(name: str) -> Column:
        return F.max(F.when(F.col("_step") == name, F.col("_pos")))

    is_progress, first_arm = F.col("_kind") == "progress", F.col("_arms") & F.col("_prior").isNull()
    last_kind = F.max_by("_kind", F.when(F.col("_kind").isNotNull(), F.col("_pos")))
    return [
        F.max(F.when(first_arm, F.col("_us"))).alias("first_arm"),
        F.max(F.when(is_progress & (F.col("_releases") == 1), F.col("_us"))).alias("first_release"),
        F.max_by("_us", F.when(F.col("_arms"), F.col("_pos"))).alias("last_arm"),
        (last_kind == "lock").alias("ends_armed"),
        F.coalesce(F.bool_or("_late"), F.lit(False)).alias("late"),
        *[F.coalesce(F.bool_or(f"_fault{s}"), F.lit(False)).alias(f"fault{s}") for s in (_IDLE, _LOCKED, _UNLOCKED)],
        at("progress").alias("last_progress"),
        at("lock").alias("last_lock"),
        at("unlock").isNotNull().alias("any_unlock"),
        F.max("_unlocks")["lock"].alias("open_lock"),
    ]


def _folded_watchdog(stretches: Column, budget_us: int) -> Column:
    """(over_budget, faults) of a run, from its stretches' summaries in order."""
    start = F.struct(
        F.lit(None).cast("long").alias("armed"), F.lit(False).alias("over"), F.lit(_IDLE).alias("state"), F.lit(False).alias("fault")
    )

    def step(so_far: Column, s: Column) -> Column:
        armed, state = F.coalesce(so_far["armed"], s["first_arm"]), so_far["state"]
        released = s["first_release"].isNotNull()
        late = F.coalesce(s["first_release"] - armed > budget_us, F.lit(False))
        passed = s["last_progress"].isNotNull()

        def since(position: Column) -> Column:
            return position.isNotNull() & (~passed | (position > s["last_progress"]))

        afresh = F.when(since(s["open_lock"]), _UNLOCKED).when(since(s["last_lock"]), _LOCKED).otherwise(_IDLE)
        onward = F.when(passed | (state == _IDLE), afresh).when(s["any_unlock"], _UNLOCKED).otherwise(state)
        fault = F.when(state == _IDLE, s["fault0"]).when(state == _LOCKED, s["fault1"]).otherwise(s["fault2"])
        return F.struct(
            F.when(~released, armed).when(s["ends_armed"], s["last_arm"]).alias("armed"),
            (so_far["over"] | s["late"] | late).alias("over"),
            onward.alias("state"),
            (so_far["fault"] | fault).alias("fault"),
        )

    return F.aggregate(
        F.array_sort(stretches), start, step,
        lambda end: F.struct((end["over"] | end["armed"].isNotNull()).alias("over_budget"), end["fault"].alias("faults")),
    )


def latest_progress(log: RunLog) -> DataFrame:
    """Per run: its last progress, told as ``done/all`` only when that event has both numbers."""
    progress = F.col("type") == "progress"
    last = F.max_by(F.struct(*log.order, "completed", "total"), F.when(progress, log.position))
    return (
        log.events.groupBy(log.run)
        .agg(last.alias("p"))
        .select(
            log.run,
            *[F.col(f"p.{c}").alias(f"progress_{c}") for c in log.order],
            "p.completed",
            "p.total",
            ev.progress_text(F.col("p.completed"), F.col("p.total")).alias("progress"),
        )
    )


def terminal_records(log: RunLog, terminal: Column) -> DataFrame:
    """Per run: the first terminal record and how many later ones are dropped."""
    first = F.min_by(F.struct(*log.order, "type"), F.when(terminal, log.position))
    return (
        log.events.groupBy(log.run)
        .agg(first.alias("t"), F.count_if(terminal).alias("n"))
        .where(F.col("n") > 0)
        .select(
            log.run,
            *[F.col(f"t.{c}").alias(f"terminal_{c}") for c in log.order],
            F.col("t.type").alias("terminal_type"),
            (F.col("n") - 1).alias("terminal_dropped"),
        )
    )


def completions(log: RunLog) -> DataFrame:
    """Per run: number of completions and the counters of the last one, exact where they fit."""
    is_completion = F.col("type") == "completion"
    counters = ("exit_code", "errors", "warnings", "retries", "files", "duration_ms")
    last = F.max_by(F.struct(*counters), F.when(is_completion, log.position))
    return (
        log.events.groupBy(log.run)
        .agg(F.count_if(is_completion).alias("completions"), last.alias("c"))
        .select(log.run, "completions", *[F.col(f"c.{n}").alias(n) for n in counters])
    )


def completion_reason() -> Column:
    """Why a completion's counters (as text) are refused; null where they are fine."""
    lacks = F.lit(False)
    for name in ("exit_code", "errors", "warnings", "retries", "files"):
        lacks = lacks | F.col(name).isNull()
    odd = F.lit(False)
    for name in ("exit_code", "errors", "warnings", "retries", "files", "duration_ms"):
        odd = odd | (F.col(name).isNotNull() & ~ev.is_counter(F.col(name)))
    return (
        F.when(odd, "counter")
        .when(lacks, "missing")
        .when(~ev.is_safe_integer(F.col("exit_code")), "exit_code")
        .when(
            F.col("duration_ms").isNotNull() & ~ev.is_safe_integer(F.col("duration_ms")),
            "duration_ms",
        )
    )


# Reasons a run fails, in the order they are looked at.
EXPORT_REASONS = (
    "lock-budget",
    "cancelled",
    "exit-code",
    "fatal",
    "lifecycle",
    "completion-count",
    "completion-errors",
    "invalid-file-count",
    "file-count",
)
RESTORE_REASONS = (
    "cancelled",
    "exit-code",
    "cancelled-event",
    "fatal",
    "completion-count",
    "exit-disagreement",
    "invalid-file-count",
)


def judge(
    log: RunLog,
    outcomes: DataFrame,
    steps: Sequence[Transition] = fixed.EXPORT_LIFECYCLE,
    lock: Transition = fixed.EXPORT_LIFECYCLE[0],
    unlock: Transition = ("table_unlock", None, "finished"),
    progress: Transition = fixed.EXPORT_LIFECYCLE[3],
    budget_seconds: int = fixed.LOCK_BUDGET_SECONDS,
    exporter: str = "exporter",
    width: int | None = None,
) -> DataFrame:
    """One verdict per run: the first failing reason of its tool's list, or success.

    ``outcomes`` tells what the log cannot: per run the tool, the process's ``exit`` code, whether
    it was ``aborted``, whether the lifecycle is required (``checked``) and ``files_found`` on disk
    (null where not counted). The log is read once: events that matter are sorted by run and stretch,
    each stretch becomes one row of counts and of the watchdog's summary, and a run's rows are added up
    and folded in order.
    """
    run, budget_us = log.run, budget_seconds * 1_000_000
    is_completion = F.col("type") == "completion"
    fatal = (F.col("type") == "error") & F.col("fatal")
    matters = is_completion | fatal | F.col("type").isin("cancelled", "warning", "error")
    for transition in (*steps, lock, unlock, progress):
        matters = matters | is_transition(transition)

    def completed(value: Column) -> Column:
        return F.when(is_completion, value)

    narrow = log.events.where(matters).select(
        run, *log.order, *({log.at} - set(log.order)), "type", "source_event", "source_phase", "source_status",
        F.coalesce(fatal, F.lit(False)).alias("_fatal"),
        completed(F.col("exit_code")).alias("exit_code"),
        completed(F.coalesce(F.col("errors") == "0", F.lit(False))).alias("no_errors"),
        completed(ev.counter(F.col("files"))).alias("files"),
        completed(~ev.is_safe_integer(F.col("files"))).alias("unsafe_files"),
    )
    cut = ordered.in_stretches(narrow, log.cutter, width or log.width)
    # Counters matter only where there is one completion, so any aggregate of it gives its value.
    totals = {
        "completions": (F.count_if(is_completion), F.sum),
        "any_cancelled": (F.bool_or(F.col("type") == "cancelled"), F.bool_or),
        "any_fatal": (F.bool_or("_fatal"), F.bool_or),
        "exit_code": (F.max("exit_code"), F.max),
        "no_errors": (F.bool_or("no_errors"), F.bool_or),
        "files": (F.max("files"), F.max),
        "unsafe_files": (F.bool_or("unsafe_files"), F.bool_or),
    }
    for i, transition in enumerate(steps):
        hit = is_transition(transition)
        totals[f"_seen{i}"] = (F.count_if(hit), F.sum)
        totals[f"_at{i}"] = (F.min(F.when(hit, F.col("_pos"))), F.min)
    watched = _watchdog_rows(cut, log, lock, unlock, progress, budget_us)
    summaries = watched.groupBy(run, ordered.STRETCH).agg(
        *[count.alias(name) for name, (count, _) in totals.items()],
        *_watchdog_summary(),
    )
    passed_on = [c for c in summaries.columns if c not in totals and c != run]
    facts = summaries.groupBy(run).agg(
        *[merge(name).alias(name) for name, (_, merge) in totals.items()],
        F.collect_list(F.struct(*passed_on)).alias("_stretches"),
    )
    facts = facts.withColumn("_watchdog", _folded_watchdog(F.col("_stretches"), budget_us)).drop("_stretches")
    no_errors = F.coalesce(F.col("no_errors"), F.lit(False))
    clean_exit = F.col("exit_code").eqNullSafe(F.lit(0).cast("long"))
    agrees = F.col("exit_code").eqNullSafe(F.col("exit").cast("long"))
    once = F.col("completions") == 1
    broken = {
        "lock-budget": F.coalesce("_watchdog.over_budget", F.lit(False)),
        "cancelled": F.col("aborted"),
        "exit-code": ~F.col("exit").eqNullSafe(F.lit(0)),
        "cancelled-event": F.col("any_cancelled"),
        "fatal": F.col("any_fatal"),
        "lifecycle": F.col("checked") & (_lifecycle_status(steps) != "complete"),
        "completion-count": ~once,
        "completion-errors": ~clean_exit | ~no_errors,
        "exit-disagreement": ~agrees | ~no_errors,
        "invalid-file-count": F.col("unsafe_files"),
        "file-count": F.col("files_found").isNotNull() & (F.col("files") != F.col("files_found")),
    }
    is_export = F.col("tool") == exporter
    # An export is also aborted by the watchdog when a fault follows an unlock.
    broken_export = {
        **broken,
        "cancelled": F.col("aborted") | F.coalesce("_watchdog.faults", F.lit(False)),
    }
    export_reason = F.coalesce(*[F.when(broken_export[r], F.lit(r)) for r in EXPORT_REASONS])
    restore_reason = F.coalesce(*[F.when(broken[r], F.lit(r)) for r in RESTORE_REASONS])
    reason = F.when(is_export, export_reason).otherwise(restore_reason)
    code = ev.outcome_code(
        F.col("reason").isin("cancelled", "cancelled-event"),
        F.lit(False),
        F.col("reason").isNotNull(),
    )
    counts = ["completions", *[f"_seen{i}" for i in range(len(steps))]]
    return (
        # A process that logged nothing that matters still gets its verdict.
        outcomes.join(facts, run, "left")
        .na.fill(0, counts)
        .na.fill(False, ["any_cancelled", "any_fatal"])
        .withColumn("reason", reason)
        .select(
            run,
            "tool",
            "completions",
            "reason",
            code.alias("code"),
            ev.outcome_name(code).alias("outcome"),
        )
    )
