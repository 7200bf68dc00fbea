"""Queries that run as Structured Streaming over logs and records written as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden import session
from tablewarden.functions import events as ev
from tablewarden.operators import log_parse
from tablewarden.queries import common as c
from tablewarden.queries import runs, scrubs
from tablewarden.sources.folders import Folders
from tablewarden.sources.run_log import stream_lines
from tablewarden.streaming import streams

# Lines arrive in several micro-batches, and some of them a day late.
BATCHES = 4
LATE_DAYS = 1
DELAY = "2 days"
# A run is one user on one day, so it has ended when nothing came for longer.
IDLE = "25 hours"


def _log_lines(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """The run-log view as a stream of JSON lines in the tools' format: stretch after stretch, and a last line to close it.

    Each stretch is written by all partitions as so many files, which are one micro-batch.
    """
    log = c.run_log(spark, sf).events
    k = F.col("k").cast("string")
    counted = F.col("source_event") == "purchase"

    def counter(text):
        return F.when(counted, text)

    line = F.to_json(
        F.struct(
            F.lit("1").alias("schema_version"),
            F.lit("1").alias("event_version"),
            F.col("event_id").alias("seq"),
            "run_id",
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
            F.col("level_name").alias("level"),
            F.lit("exporter").alias("tool"),
            F.col("source_event").alias("event"),
            F.col("source_phase").alias("phase"),
            F.col("source_status").alias("status"),
            "fatal",
            counter(F.lit("0")).alias("exit_code"),
            counter(F.lit("0")).alias("errors"),
            counter(k).alias("warnings"),
            counter(F.lit("0")).alias("retries"),
            counter(k).alias("files"),
        )
    )
    path = f"{folder}/lines"
    # Each batch has the lines of a stretch of time, in no order; every other line comes late.
    micros, day = F.unix_micros(F.col("ts").cast("timestamp")), 86_400_000_000
    ends = log.agg(F.min(micros).alias("low"), F.max(micros).alias("high")).first()
    arrival = micros + (F.col("event_id") % 2) * (LATE_DAYS * day)
    number = F.least(F.floor((arrival - ends.low) / ((ends.high - ends.low) / BATCHES + day)), F.lit(BATCHES - 1))
    lines = session.materialised(log.select(F.concat(line, F.lit("\r")).alias("line"), number.alias("number")), "lines")
    files = spark.sparkContext.defaultParallelism
    for n in range(BATCHES):
        lines.where(F.col("number") == n).select("line").repartition(files).write.mode("append").text(path)
    # One event long after the others lets every timer of theirs expire.
    end = log.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    closing = end.select(
        F.concat(
            F.lit('{"schema_version":"1","event_version":"1","seq":0,"run_id":"closing","ts":"'),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            F.lit('","level":"INFO","tool":"exporter","event":"view","phase":"dump","status":"progress","fatal":false}'),
        ).alias("line")
    )
    closing.coalesce(1).write.mode("append").text(path)
    return stream_lines(spark, path, maxFilesPerTrigger=str(files))


def _drop_lines(spark: SparkSession, folder: str) -> None:
    """The copy of the lines is not needed once a stream has read them."""
    Folders(spark).delete(f"{folder}/lines")


def _events(lines: DataFrame) -> DataFrame:
    return streams.typed_events(lines, "exporter", DELAY, c.COMPLETIONS)


def stream_lock_watchdog(spark: SparkSession, sf: str) -> DataFrame:
    folder = session.scratch_dir(spark, "watchdog")
    events = streams.parsed_events(_log_lines(spark, sf, folder), "exporter", c.COMPLETIONS)
    watched = streams.watch_locks(events, c.LOCK, c.PROGRESS, runs.LOCK_BUDGET, DELAY)
    told = streams.drain(spark, watched, folder, shape=lambda batch: streams.told_locks(batch, runs.LOCK_BUDGET))
    _drop_lines(spark, folder)
    return told.select("run_id", F.col("sequence").alias("event_id"), "over_budget")


# Every lock start, armed or not: whether any progress comes within the budget.
STREAM_LOCK_WATCHDOG = f"""
SELECT run_id, event_id, coalesce(next_progress > ts + INTERVAL 6 HOUR, true) AS over_budget FROM (
  SELECT *, min(CASE WHEN source_event = 'view' THEN ts END) OVER (PARTITION BY run_id ORDER BY ts, event_id
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_progress
  FROM ({c.RUNLOG}) r) w
WHERE source_event = 'signup'
"""


def stream_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    folder = session.scratch_dir(spark, "lifecycle")
    followed = streams.follow_lifecycle(_events(_log_lines(spark, sf, folder)), c.LIFECYCLE, IDLE)
    states = streams.drain(spark, followed, folder)
    _drop_lines(spark, folder)
    return states.where(F.col("run_id") != "closing").select("run_id", F.col("lifecycle").alias("status"))


STREAM_LIFECYCLE = f"SELECT subject AS run_id, status FROM ({runs.LIFECYCLE_CHECK}) l WHERE kind = 'run'"


def stream_throttle(spark: SparkSession, sf: str) -> DataFrame:
    folder = session.scratch_dir(spark, "throttle")
    kept = streams.drain_throttled(spark, _events(_log_lines(spark, sf, folder)), folder, runs.THROTTLE_MS)
    _drop_lines(spark, folder)
    return kept.where(F.col("run_id") != "closing").select("run_id", F.col("sequence").alias("event_id"))


STREAM_THROTTLE = f"SELECT run_id, event_id FROM ({runs.PROGRESS_THROTTLE}) t"


def stream_run_status(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of each run, told when it has ended, and the runs' first terminal records, repeats told apart."""
    folder = session.scratch_dir(spark, "status")
    lines = _log_lines(spark, sf, folder)

    told = streams.drain(spark, streams.run_status(_events(lines), IDLE), f"{folder}/status")
    terminal = (F.col("type") == "completion") | F.coalesce(F.col("fatal"), F.lit(False))
    records = streams.drain(spark, streams.terminal_records(_events(lines), terminal), f"{folder}/ended")
    ended = records.where("NOT repeat").select("run_id")
    _drop_lines(spark, folder)
    ends = ended.groupBy("run_id").agg(F.count(F.lit(1)).alias("terminals"))
    return (
        told.where(F.col("run_id") != "closing")
        .join(ends, "run_id", "left")
        .select(
            "run_id", "events", "completions", "any_fatal", "any_cancelled",
            F.coalesce("terminals", F.lit(0)).cast("long").alias("terminals"),
        )
    )


STREAM_RUN_STATUS = f"""
SELECT run_id, count(*) AS events, count(*) FILTER (type = 'completion') AS completions,
       bool_or(type = 'error' AND fatal) AS any_fatal, bool_or(type = 'cancelled') AS any_cancelled,
       CASE WHEN bool_or(type = 'completion' OR (type = 'error' AND fatal)) THEN 1 ELSE 0 END AS terminals
FROM ({c.TYPED}) t GROUP BY run_id
"""


def stream_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages as JSON lines, scrubbed in flight into enveloped lines."""
    folder = session.scratch_dir(spark, "scrub")
    path = f"{folder}/lines"
    texts = scrubs.dirty_texts(spark, sf)
    texts.select(F.to_json(F.struct("source", "id", "text")).alias("line")).write.text(path)
    schema = "source string, id long, text string"
    records = stream_lines(spark, path).select(F.from_json("line", schema).alias("r")).select("r.*")
    cleaned = streams.scrub(records, "text", scrubs.SECRETS, scrubs.KEYS)
    lines = cleaned.select(
        ev.envelope(F.struct("source", "id", "text"), "scrub").alias("line")
    )
    out = streams.drain(spark, lines, folder)
    _drop_lines(spark, folder)
    envelope = "schemaVersion int, type string, command string, event struct<source string, id long, text string>"
    event = F.from_json("line", envelope)["event"]
    return out.select(event.alias("e")).select("e.source", "e.id", *scrubs.summary(F.col("e.text")))


def stream_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The lines view as a stream: accepted lines and, per reason, refused ones."""
    folder = session.scratch_dir(spark, "parse")
    path = f"{folder}/lines"
    c.view(spark, sf, c.LINES).select("line").write.text(path)
    parsed = log_parse.parse_lines(stream_lines(spark, path), "exporter")
    out = streams.drain(spark, parsed.select("reason", "sequence"), folder)
    _drop_lines(spark, folder)
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum("sequence"), F.lit(0)).alias("sequences"),
    )


STREAM_PARSE = f"""
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS lines, cast(coalesce(sum(sequence), 0) AS bigint) AS sequences
FROM ({runs.EVENT_PARSE}) p GROUP BY 1
"""

QUERIES = {
    "stream_lock_watchdog": stream_lock_watchdog,
    "stream_lifecycle": stream_lifecycle,
    "stream_throttle": stream_throttle,
    "stream_run_status": stream_run_status,
    "stream_scrub": stream_scrub,
    "stream_parse": stream_parse,
}
ORACLES = {
    "stream_lock_watchdog": STREAM_LOCK_WATCHDOG,
    "stream_lifecycle": STREAM_LIFECYCLE,
    "stream_throttle": STREAM_THROTTLE,
    "stream_run_status": STREAM_RUN_STATUS,
    "stream_scrub": scrubs.SCRUB_TEXT,
    "stream_parse": STREAM_PARSE,
}
