"""Streaming forms of the run-log and scrub operators, and how they are started."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablewarden import fixed_values as fixed
from tablewarden.functions import redaction
from tablewarden.operators import log_parse, run_log, throttle
from tablewarden.operators.run_log import RunLog, Transition, is_transition
from tablewarden.sources.folders import Folders

# State may exceed memory, and a micro-batch stores what it changed, not all there is.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def parsed_events(
    lines: DataFrame, tool: str, completion_events: Sequence[str] = fixed.COMPLETION_EVENTS
) -> DataFrame:
    """Accepted events of a stream of lines."""
    return log_parse.accepted(log_parse.parse_lines(lines, tool, completion_events=completion_events))


def typed_events(
    lines: DataFrame,
    tool: str,
    delay: str,
    completion_events: Sequence[str] = fixed.COMPLETION_EVENTS,
) -> DataFrame:
    """Accepted events of a stream of lines, with the watermark that bounds all state."""
    return parsed_events(lines, tool, completion_events).withWatermark("event_time", delay)


def refused_lines(lines: DataFrame, tool: str) -> DataFrame:
    return log_parse.quarantine(log_parse.parse_lines(lines, tool))


def watch_locks(
    events: DataFrame,
    lock: Transition = fixed.EXPORT_LIFECYCLE[0],
    progress: Transition = fixed.EXPORT_LIFECYCLE[3],
    budget_seconds: int = fixed.LOCK_BUDGET_SECONDS,
    delay: str = "0 seconds",
) -> DataFrame:
    """Stream of closed stretches of runs, for :func:`told_locks`: their locks and the progress that may release them.

    Progress after a lock and within its budget lies in the lock's own stretch of time of the budget's
    length, or in the next one. In its own, any later progress is in time, so the latest one tells; of
    the next, the earliest one tells. So progress goes to its own stretch and, shifted by the budget, to
    the one before. Every lock is a row of state of its own, and a stretch's progress is one with two
    numbers, so no row grows with a burst; all of them leave together when the stretch is past. ``events``
    come without a watermark; rows may be late by ``delay``.
    """
    kind = F.when(is_transition(lock), "lock").when(is_transition(progress), "progress")
    budget = F.expr(f"INTERVAL {budget_seconds} SECONDS")
    own = F.named_struct(F.lit("at"), F.col("event_time"), F.lit("kind"), kind)
    before = F.named_struct(F.lit("at"), F.col("event_time") - budget, F.lit("kind"), F.lit("next"))
    position = F.struct("micros", "sequence")
    return (
        events.where(kind.isNotNull())
        .select(
            "run_id", "sequence", F.unix_micros("event_time").alias("micros"),
            F.inline(F.array_compact(F.array(own, F.when(kind == "progress", before)))),
        )
        # Shifted rows are older by the budget, which is no lateness.
        .withWatermark("at", f"{delay} {budget_seconds} seconds")
        .groupBy("run_id", F.window("at", f"{budget_seconds} seconds"), F.when(F.col("kind") == "lock", position).alias("lock"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("kind") == "progress", position)).alias("latest"),
            F.min(F.when(F.col("kind") == "next", F.col("micros"))).alias("following"),
        )
    )


def told_locks(closed: DataFrame, budget_seconds: int = fixed.LOCK_BUDGET_SECONDS) -> DataFrame:
    """(run_id, sequence of the lock, over_budget) of a micro-batch of :func:`watch_locks`."""
    stretch = Window.partitionBy("run_id", "window")
    latest, following = F.max("latest").over(stretch), F.min("following").over(stretch)
    seen = closed.select("run_id", "lock", "n", latest.alias("latest"), following.alias("following")).where("lock IS NOT NULL")
    in_time = F.coalesce(F.col("latest") > F.col("lock"), F.lit(False)) | F.coalesce(
        F.col("following") <= F.col("lock.micros") + budget_seconds * 1_000_000, F.lit(False)
    )
    each = F.explode(F.array_repeat(F.col("lock.sequence"), F.col("n").cast("int")))
    return seen.select("run_id", each.alias("sequence"), (~in_time).alias("over_budget"))


def _sessions(idle: str | None) -> list[Column]:
    return [] if idle is None else [F.session_window("event_time", idle)]


def follow_lifecycle(
    events: DataFrame, steps: Sequence[Transition] = fixed.EXPORT_LIFECYCLE, idle: str | None = None
) -> DataFrame:
    """Lifecycle state per run: the batch aggregate as it is, combined before the shuffle.

    Without ``idle`` it is a running state for update mode, and every run ever seen stays in it. With it,
    a run is told once, in append mode, when it has been idle for so long, and its state goes.
    """
    return run_log.lifecycle(RunLog(events, ("event_time", "sequence")), steps, _sessions(idle))


def run_status(events: DataFrame, idle: str | None = None) -> DataFrame:
    """Counters per run: running, or told once it has been idle, as in :func:`follow_lifecycle`."""
    return (
        events.groupBy("run_id", *_sessions(idle))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("type") == "completion").alias("completions"),
            F.coalesce(F.bool_or(F.col("fatal")), F.lit(False)).alias("any_fatal"),
            F.coalesce(F.bool_or(F.col("type") == "cancelled"), F.lit(False)).alias("any_cancelled"),
            F.max("event_time").alias("last_seen"),
        )
        .drop("session_window")
    )


def _remembered(state: GroupState) -> pd.Series:
    """Milliseconds until which each ended run of a group is remembered, by run."""
    if not state.exists:
        return pd.Series([], dtype="int64", index=pd.Index([], dtype=object))
    table = pa.ipc.open_stream(state.get[0]).read_all()
    return pd.Series(table["until"].to_numpy(), index=pd.Index(table["run_id"].to_pylist(), dtype=object))


def _remember(state: GroupState, until: pd.Series) -> None:
    """Keep what the watermark has not passed; the group is asked again when it passes the first of them."""
    until = until[until >= state.getCurrentWatermarkMs()]
    if until.empty:
        if state.exists:
            state.remove()
        return
    batch = pa.record_batch([pa.array(list(until.index), pa.string()), pa.array(until.to_numpy(), pa.int64())], names=["run_id", "until"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    state.update((sink.getvalue().to_pybytes(),))
    state.setTimeoutTimestamp(int(until.min()))


def terminal_records(events: DataFrame, terminal: Column, remember: str = "400 days", groups: int = 1024) -> DataFrame:
    """(run_id, sequence, event_time, repeat) of terminal records: all but a run's first are told as repeats.

    The state has one entry per ended run, however late a second record comes, and lets it go when
    event time has passed the run's end by ``remember``; that bounds it. Runs are dealt to ``groups`` by a hash and
    a group's runs judged together, as every group of a micro-batch costs Python milliseconds whatever its
    size; a stream that goes on from a checkpoint keeps its number. ``events`` carry a watermark.
    """
    keep_ms = int(pd.Timedelta(remember).total_seconds() * 1000)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        until = _remembered(state)
        if state.hasTimedOut:
            _remember(state, until)
            return
        rows = pd.concat(list(batches)).sort_values(["event_time", "sequence"], kind="stable")
        new = ~rows["run_id"].duplicated() & ~rows["run_id"].isin(until.index)
        ended = rows[new]
        ends = pd.Series(ended["event_time"].to_numpy("datetime64[ms]").astype("int64") + keep_ms, index=pd.Index(ended["run_id"], dtype=object))
        _remember(state, pd.concat([until, ends[ends > state.getCurrentWatermarkMs()]]))
        yield rows[["run_id", "sequence", "event_time"]].assign(repeat=~new)

    group = F.pmod(F.xxhash64("run_id"), F.lit(groups)).alias("_group")
    ends = events.where(terminal).select("run_id", "sequence", "event_time", group)
    return ends.groupBy("_group").applyInPandasWithState(
        judge, "run_id string, sequence long, event_time timestamp, repeat boolean", "ended binary", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def scrub(
    records: DataFrame,
    column: str,
    secrets: Sequence[str] = (),
    keys: Sequence[str] = fixed.SECRET_ASSIGNMENT_KEYS,
) -> DataFrame:
    return records.withColumn(column, redaction.clean(F.col(column), secrets, keys))


def _run(spark: SparkSession, start: Callable[[], object]) -> None:
    """Start a query under the library's state store and wait for its end."""
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        start().awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(
    spark: SparkSession,
    stream: DataFrame,
    folder: str,
    mode: str = "append",
    each_batch: Callable[[DataFrame, int], None] | None = None,
    shape: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    ``shape`` is applied to each micro-batch before it is written. ``each_batch`` is the caller's hook on
    every micro-batch; without either, rows go to Parquet, and in update mode each micro-batch to a
    folder of its own, told apart by ``batch_id``.
    """
    out = f"{folder}/out"

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure replaces its own folder: once and no more.
        where = f"{out}/run={batch_id}"
        rows = batch if shape is None else shape(batch)
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(where)
        if each_batch is not None:
            # The hook gets what was written, so the batch is computed once.
            each_batch(rows.sparkSession.read.schema(rows.schema).parquet(where), batch_id)

    writer = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode(mode)
    )
    if mode == "append" and each_batch is None and shape is None:
        _run(spark, lambda: writer.format("parquet").start(out))
    else:
        _run(spark, lambda: writer.foreachBatch(write).start())
    return spark.read.parquet(out)


def in_order(events: DataFrame) -> DataFrame:
    """Stream of (event_time, run_id, sequence, droppable) that leaves in time: no row is before one of an earlier micro-batch.

    Events, which may come late by the watermark's delay, wait as single rows of state until the
    watermark has passed them. Equal events of a run are one.
    """
    droppable = F.coalesce(F.col("type") == "progress", F.lit(False)).alias("droppable")
    return events.groupBy("event_time", "run_id", "sequence", droppable).agg(F.count(F.lit(1)).alias("times"))


def drain_throttled(
    spark: SparkSession, events: DataFrame, folder: str, interval_ms: int = fixed.PROGRESS_INTERVAL_MS
) -> DataFrame:
    """Thin the progress of a stream whose events may come late; returns (run_id, sequence, micros) of the events kept.

    Two queries with a table between them: the first puts events in order, the second gives each
    micro-batch of it to the batch operator, seeded with the last time kept per run. That time is
    forgotten when all that is to come is an interval past it, as the next event is then kept whatever came
    before; so the state holds the runs of the last interval. It is written under the batch's
    number, so a batch that is run again finds and leaves the same.
    """
    gap = interval_ms * 1000
    released = drain(spark, in_order(events), f"{folder}/ordered")
    out, state = f"{folder}/thinned/out", f"{folder}/thinned/state"
    folders = Folders(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = f"{state}/after={batch_id - 1}"
        seed = session.read.parquet(before) if folders.exists(before) else None
        typed = batch.withColumn("type", F.when(F.col("droppable"), "progress"))
        log = RunLog(typed, ("event_time", "sequence"))
        kept = throttle.throttle(log, interval_ms, seed=seed).select("run_id", "sequence", log.micros.alias("micros"))
        kept.write.mode("overwrite").parquet(f"{out}/run={batch_id}")
        ends = session.read.parquet(f"{out}/run={batch_id}").select("run_id", "micros")
        # Nothing that is to come is before the last event of this batch.
        now = batch.agg(F.max(F.unix_micros("event_time"))).first()[0]
        if seed is not None:
            ends = ends.unionByName(seed)
        last = ends.groupBy("run_id").agg(F.max("micros").alias("micros"))
        last.where(F.lit(now is None) | (F.col("micros") + gap > F.lit(now))).write.mode("overwrite").parquet(f"{state}/after={batch_id}")
        folders.delete(f"{state}/after={batch_id - 2}")

    follow = spark.readStream.schema(released.schema).parquet(f"{folder}/ordered/out")
    writer = follow.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/thinned/checkpoint")
    _run(spark, lambda: writer.foreachBatch(write).start())
    return spark.read.parquet(out).select("run_id", "sequence", "micros")


# Python workers get this code with the job; nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
