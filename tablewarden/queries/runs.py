"""Queries on run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions import events as ev
from tablewarden.functions import redaction
from tablewarden.operators import log_parse, run_log, throttle
from tablewarden.operators.run_log import RunLog
from tablewarden.queries import common as c

LOCK_BUDGET = 6 * 3600
THROTTLE_MS = 6 * 3600 * 1000
KNOWN_KEYS = (
    "schema_version event_version seq run_id ts level tool event phase status fatal".split()
)


def event_parse(spark: SparkSession, sf: str) -> DataFrame:
    parsed = log_parse.parse_lines(
        c.view(spark, sf, c.LINES), "exporter", known_keys=KNOWN_KEYS
    )
    return parsed.select(
        "event_id",
        "reason",
        "run_id",
        "sequence",
        "timestamp",
        "phase",
        "type",
        "source_event",
        "rows",
        F.array_join("unknown_keys", ",").alias("unknown_keys"),
    )


EVENT_PARSE = """
WITH r AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN 'malformed' WHEN event_id % 83 = 0 THEN 'version'
                 WHEN event_id % 73 = 0 THEN 'fatal' WHEN event_id % 89 = 0 THEN 'counter:rows'
                 WHEN event_id % 79 = 0 THEN 'run_id' END AS reason
  FROM events)
SELECT event_id, reason,
       CASE WHEN reason IS NULL THEN cast(user_id AS varchar) END AS run_id,
       CASE WHEN reason IS NULL THEN event_id END AS sequence,
       CASE WHEN reason IS NULL THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.0' END AS timestamp,
       CASE WHEN reason IS NULL THEN 'backup' END AS phase,
       CASE WHEN reason IS NULL THEN 'progress' END AS type,
       CASE WHEN reason IS NULL THEN event_type END AS source_event,
       CASE WHEN reason IS NULL THEN cast(event_id AS varchar) END AS rows,
       CASE WHEN event_id % 97 <> 0 THEN 'rows' END AS unknown_keys
FROM r
"""


def _with_counters(log: RunLog) -> RunLog:
    """Counters as a log would carry them, some broken, derived from each event's number."""
    k = F.col("k")
    text = k.cast("string")
    events = (
        log.events.withColumn(
            "exit_code",
            F.when(k % 13 == 0, "23").when(k % 19 == 0, "9007199254740993").otherwise("0"),
        )
        .withColumn("errors", F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, "1").otherwise("0"))
        .withColumn("warnings", text)
        .withColumn("retries", F.when(k % 23 == 0, "01").otherwise("0"))
        .withColumn("files", F.when(k % 17 == 0, "18446744073709551615").otherwise(text))
        .withColumn("duration_ms", F.when(k % 2 == 0, (k * 10).cast("string")))
        .withColumn("completed", text)
        .withColumn("total", F.when(F.col("event_id") % 2 == 0, "100"))
    )
    return RunLog(events, log.order, log.run, log.at)


COUNTED = f"""
SELECT *, CASE WHEN k % 13 = 0 THEN '23' WHEN k % 19 = 0 THEN '9007199254740993' ELSE '0' END AS exit_code,
       CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN '1' ELSE '0' END AS errors,
       cast(k AS varchar) AS warnings,
       CASE WHEN k % 23 = 0 THEN '01' ELSE '0' END AS retries,
       CASE WHEN k % 17 = 0 THEN '18446744073709551615' ELSE cast(k AS varchar) END AS files,
       CASE WHEN k % 2 = 0 THEN cast(k * 10 AS varchar) END AS duration_ms,
       cast(k AS varchar) AS completed,
       CASE WHEN event_id % 2 = 0 THEN '100' END AS total
FROM ({c.TYPED}) t
"""


def event_classify(spark: SparkSession, sf: str) -> DataFrame:
    log = _with_counters(c.run_log(spark, sf))
    label = ev.label_of(
        F.col("phase"), F.col("type"), F.col("completed"), F.col("total"), F.col("source_event")
    )
    return log.events.select("event_id", "phase", "type", "status", label.alias("label"))


EVENT_CLASSIFY = f"""
SELECT event_id, phase, type,
       CASE WHEN type = 'status' THEN CASE status WHEN 'started' THEN 'started' WHEN 'finished' THEN 'completed'
            ELSE 'running' END END AS status,
       phase || ': ' || CASE WHEN type = 'progress' AND total IS NOT NULL THEN completed || '/' || total
            WHEN type IN ('status', 'warning', 'error', 'cancelled') THEN source_event ELSE type END AS label
FROM ({COUNTED}) e
"""


def completion_fields(spark: SparkSession, sf: str) -> DataFrame:
    found = run_log.completions(_with_counters(c.run_log(spark, sf)))
    return found.where(F.col("completions") > 0).select(
        "run_id",
        "completions",
        "exit_code",
        "errors",
        "files",
        "duration_ms",
        ev.counter(F.col("files")).cast("string").alias("files_exact"),
        run_log.completion_reason().alias("reason"),
    )


COMPLETION_FIELDS = f"""
WITH c AS (
  SELECT run_id, count(*) AS completions,
         arg_max(struct_pack(e := exit_code, r := errors, w := warnings, t := retries, f := files, d := duration_ms),
                 (ts, event_id)) AS x
  FROM ({COUNTED}) e WHERE type = 'completion' GROUP BY run_id)
SELECT run_id, completions, x.e AS exit_code, x.r AS errors, x.f AS files, x.d AS duration_ms,
       cast(cast(x.f AS decimal(38, 0)) AS varchar) AS files_exact,
       CASE WHEN x.t = '01' THEN 'counter' WHEN x.r IS NULL THEN 'missing'
            WHEN x.e = '9007199254740993' THEN 'exit_code' END AS reason
FROM c
"""


def lifecycle_check(spark: SparkSession, sf: str) -> DataFrame:
    runs = run_log.lifecycle(c.run_log(spark, sf), c.LIFECYCLE).select(
        F.lit("run").alias("kind"),
        F.col("run_id").alias("subject"),
        F.col("lifecycle").alias("status"),
        F.col("recognised").cast("long").alias("recognised"),
    )
    talks = run_log.alternation(
        c.table(spark, sf, "conversations"),
        "conv_id",
        "turn",
        "role",
        "system",
        ("user", "assistant"),
    ).select(
        F.lit("conversation").alias("kind"),
        F.col("conv_id").cast("string").alias("subject"),
        F.when((F.col("out_of_order") == 0) & (F.col("gaps") == 0), "complete")
        .otherwise("reordered")
        .alias("status"),
        F.col("turns").cast("long").alias("recognised"),
    )
    return runs.unionByName(talks)


LIFECYCLE_CHECK = f"""
WITH seen AS (
  SELECT run_id, coalesce(list(source_event ORDER BY ts, event_id) FILTER (source_event <> 'error'), []) AS steps
  FROM ({c.RUNLOG}) r GROUP BY run_id),
talk AS (
  SELECT conv_id, turn, role, count(*) FILTER (role = 'system' AND turn = 0) OVER (PARTITION BY conv_id) AS opened
  FROM conversations)
SELECT 'run' AS kind, run_id AS subject,
       CASE WHEN steps = ['signup', 'view', 'click', 'purchase'] THEN 'complete'
            WHEN len(steps) < 4 AND steps = ['signup', 'view', 'click', 'purchase'][1:len(steps)] THEN 'incomplete'
            ELSE 'reordered' END AS status,
       len(steps) AS recognised
FROM seen
UNION ALL
SELECT 'conversation', cast(conv_id AS varchar),
       CASE WHEN max(CASE WHEN role = 'system' THEN turn <> 0
                          ELSE role <> CASE WHEN (turn - opened) % 2 = 0 THEN 'user' ELSE 'assistant' END END) = false
             AND max(turn) - min(turn) + 1 = count(*) THEN 'complete' ELSE 'reordered' END,
       count(*)
FROM talk GROUP BY conv_id
"""


def sequence_check(spark: SparkSession, sf: str) -> DataFrame:
    events = c.run_log(spark, sf).events.select(
        "run_id",
        F.when(F.col("k") % 31 == 0, F.lit(None)).otherwise(F.col("event_id")).alias("seq"),
        (F.col("event_id") - F.col("k")).alias("parent"),
    )
    return run_log.sequence_report(events, "run_id", "seq", "parent")


SEQUENCE_CHECK = f"""
WITH e AS (SELECT run_id, CASE WHEN k % 31 = 0 THEN NULL ELSE event_id END AS seq, event_id - k AS parent
           FROM ({c.RUNLOG}) r)
SELECT run_id, count(*) FILTER (seq IS NULL) AS bad_sequence, count(*) FILTER (parent < 0) AS bad_parent,
       count(*) - count(DISTINCT seq) - max(CASE WHEN seq IS NULL THEN 1 ELSE 0 END) AS repeats,
       max(seq) - min(seq) + 1 - count(DISTINCT seq) AS gaps
FROM e GROUP BY run_id
"""

# Lock starts that arm the watchdog, each with the progress after it.
ARMED = f"""
SELECT run_id, event_id, ts, next_progress FROM (
  SELECT *, lag(source_event) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS before,
         min(CASE WHEN source_event = 'view' THEN ts END) OVER (PARTITION BY run_id ORDER BY ts, event_id
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_progress
  FROM ({c.RUNLOG}) r WHERE source_event IN ('signup', 'view')) w
WHERE source_event = 'signup' AND before IS DISTINCT FROM 'signup'
"""


def lock_budget(spark: SparkSession, sf: str) -> DataFrame:
    return run_log.lock_windows(
        c.run_log(spark, sf), c.LOCK, c.PROGRESS, LOCK_BUDGET
    ).select("run_id", "event_id", "waited_us", "outcome")


LOCK_BUDGET_SQL = f"""
SELECT run_id, event_id, date_diff('microsecond', ts, next_progress) AS waited_us,
       CASE WHEN next_progress IS NULL THEN 'never' WHEN next_progress > ts + INTERVAL 6 HOUR THEN 'late'
            ELSE 'in_time' END AS outcome
FROM ({ARMED}) a
"""


def fault_after_unlock(spark: SparkSession, sf: str) -> DataFrame:
    return run_log.faults_after_unlock(
        c.run_log(spark, sf), c.LOCK, c.UNLOCK, c.PROGRESS
    ).select(
        "run_id",
        "event_id",
        F.col("unlock.event_id").alias("unlock_event_id"),
        F.col("lock.event_id").alias("lock_event_id"),
    )


# Every fault against every lock and unlock before it in its run.
FAULTS = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM ({c.TYPED}) r),
p AS (SELECT *, coalesce(max(CASE WHEN source_event = 'view' THEN seq END) OVER (PARTITION BY run_id ORDER BY seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM t)
SELECT f.run_id, f.event_id, arg_max(u.event_id, u.seq) AS unlock_event_id, max(u.seq) AS useq, max(f.since) AS since,
       arg_max(l.event_id, (u.seq, l.seq)) AS lock_event_id
FROM p f JOIN t u ON u.run_id = f.run_id AND u.source_event = 'purchase' AND u.seq <= f.seq AND u.seq > f.since
JOIN t l ON l.run_id = f.run_id AND l.source_event = 'signup' AND l.seq < u.seq AND l.seq > f.since
WHERE f.type IN ('warning', 'error')
GROUP BY f.run_id, f.event_id
"""

FAULT_AFTER_UNLOCK = f"SELECT run_id, event_id, unlock_event_id, lock_event_id FROM ({FAULTS}) f"


def run_verdict(spark: SparkSession, sf: str) -> DataFrame:
    log = _with_counters(c.run_log(spark, sf))
    events = log.events.withColumn("exit_code", F.col("exit_code").try_cast("long"))
    k = F.col("k")
    outcomes = events.groupBy("run_id", "tool").agg(
        F.when(F.max(k) >= 98, 23).otherwise(0).alias("exit"),
        (F.min(k) == 0).alias("aborted"),
        (F.count(F.lit(1)) % 3 == 0).alias("checked"),
        F.when(F.count(F.lit(1)) % 5 == 0, F.sum(k)).cast("decimal(38,0)").alias("files_found"),
    )
    return run_log.judge(
        RunLog(events, log.order, log.run, log.at),
        outcomes,
        steps=c.LIFECYCLE,
        lock=c.LOCK,
        unlock=c.UNLOCK,
        progress=c.PROGRESS,
        budget_seconds=LOCK_BUDGET,
    )


RUN_VERDICT = f"""
WITH e AS (SELECT * FROM ({COUNTED}) x),
o AS (SELECT run_id, tool, CASE WHEN max(k) >= 98 THEN 23 ELSE 0 END AS exit, min(k) = 0 AS aborted,
             count(*) % 3 = 0 AS checked, CASE WHEN count(*) % 5 = 0 THEN sum(k) END AS files_found,
             count(*) FILTER (type = 'completion') AS completions,
             bool_or(type = 'cancelled') AS any_cancelled,
             bool_or(type = 'error' AND fatal) AS any_fatal,
             coalesce(list(source_event ORDER BY ts, event_id) FILTER (source_event <> 'error'), [])
                 = ['signup', 'view', 'click', 'purchase'] AS complete,
             arg_max(struct_pack(x := exit_code, r := errors, f := files), (ts, event_id))
                 FILTER (type = 'completion') AS c
      FROM e GROUP BY run_id, tool),
b AS (SELECT run_id, bool_or(next_progress IS NULL OR next_progress > ts + INTERVAL 6 HOUR) AS over_budget
      FROM ({ARMED}) a GROUP BY run_id),
f AS (SELECT run_id, count(*) AS faults FROM ({FAULTS}) y GROUP BY run_id),
v AS (
  SELECT o.run_id, tool, completions,
    CASE WHEN tool = 'exporter' THEN
      CASE WHEN coalesce(over_budget, false) THEN 'lock-budget'
           WHEN aborted OR coalesce(faults, 0) > 0 THEN 'cancelled'
           WHEN exit <> 0 THEN 'exit-code' WHEN any_fatal THEN 'fatal'
           WHEN checked AND NOT complete THEN 'lifecycle' WHEN completions <> 1 THEN 'completion-count'
           WHEN c.x <> '0' OR coalesce(c.r, '?') <> '0' THEN 'completion-errors'
           WHEN cast(c.f AS decimal(38, 0)) > 9007199254740991 THEN 'invalid-file-count'
           WHEN files_found <> cast(c.f AS decimal(38, 0)) THEN 'file-count' END
    ELSE
      CASE WHEN aborted THEN 'cancelled' WHEN exit <> 0 THEN 'exit-code' WHEN any_cancelled THEN 'cancelled-event'
           WHEN any_fatal THEN 'fatal' WHEN completions <> 1 THEN 'completion-count'
           WHEN c.x <> cast(exit AS varchar) OR coalesce(c.r, '?') <> '0' THEN 'exit-disagreement'
           WHEN cast(c.f AS decimal(38, 0)) > 9007199254740991 THEN 'invalid-file-count' END
    END AS reason
  FROM o LEFT JOIN b ON o.run_id = b.run_id LEFT JOIN f ON o.run_id = f.run_id)
SELECT run_id, tool, completions, reason,
       CASE WHEN reason LIKE 'cancelled%' THEN 130 WHEN reason IS NOT NULL THEN 1 ELSE 0 END AS code,
       CASE WHEN reason LIKE 'cancelled%' THEN 'CANCELLED' WHEN reason IS NOT NULL THEN 'OPERATION_FAILED'
            ELSE 'OK' END AS outcome
FROM v
"""


def progress_throttle(spark: SparkSession, sf: str) -> DataFrame:
    log = c.run_log(spark, sf)
    narrow = RunLog(log.events.select("run_id", "ts", "event_id", "type"), log.order, log.run, log.at)
    return throttle.throttle(narrow, THROTTLE_MS).select("run_id", "event_id", "type")


PROGRESS_THROTTLE = f"""
WITH RECURSIVE s AS (
  SELECT run_id, event_id, ts, type, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq
  FROM ({c.TYPED}) t),
walk AS (
  SELECT run_id, event_id, type, seq, ts AS kept_at, true AS kept FROM s WHERE seq = 1
  UNION ALL
  SELECT s.run_id, s.event_id, s.type, s.seq,
         CASE WHEN s.type <> 'progress' OR s.ts - w.kept_at >= INTERVAL 6 HOUR THEN s.ts ELSE w.kept_at END,
         s.type <> 'progress' OR s.ts - w.kept_at >= INTERVAL 6 HOUR
  FROM walk w JOIN s ON s.run_id = w.run_id AND s.seq = w.seq + 1)
SELECT run_id, event_id, type FROM walk WHERE kept
"""


def latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    log = _with_counters(c.run_log(spark, sf))
    is_fatal = (F.col("type") == "error") & F.col("fatal")
    terminal = (F.col("type") == "completion") | is_fatal
    latest = run_log.latest_progress(log).select(
        "run_id", F.col("progress_event_id").alias("progress_event_id"), "progress"
    )
    ends = run_log.terminal_records(log, terminal).select(
        "run_id", "terminal_event_id", "terminal_type", "terminal_dropped"
    )
    return latest.join(ends, "run_id", "left")


LATEST_PROGRESS = f"""
SELECT run_id, arg_max(event_id, (ts, event_id)) FILTER (type = 'progress') AS progress_event_id,
       arg_max(struct_pack(p := CASE WHEN total IS NOT NULL THEN completed || '/' || total END), (ts, event_id))
           FILTER (type = 'progress').p AS progress,
       arg_min(event_id, (ts, event_id)) FILTER (type = 'completion' OR (type = 'error' AND fatal)) AS terminal_event_id,
       arg_min(type, (ts, event_id)) FILTER (type = 'completion' OR (type = 'error' AND fatal)) AS terminal_type,
       CASE WHEN count(*) FILTER (type = 'completion' OR (type = 'error' AND fatal)) > 0
            THEN count(*) FILTER (type = 'completion' OR (type = 'error' AND fatal)) - 1 END AS terminal_dropped
FROM ({COUNTED}) e GROUP BY run_id
"""


def verbosity_filter(spark: SparkSession, sf: str) -> DataFrame:
    events = _with_counters(c.run_log(spark, sf)).events
    is_progress, is_error = F.col("type") == "progress", F.col("type") == "error"
    public = ev.public_event(
        {
            "runId": F.col("run_id"),
            "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            "phase": F.col("phase"),
            "tool": F.col("tool"),
            "type": F.col("type"),
            "status": F.col("status"),
            "message": F.when(ev.carries_message(F.col("type")), F.col("source_event")),
            "completed": F.when(is_progress, F.col("completed")),
            "total": F.when(is_progress, F.col("total")),
            "fatal": F.when(is_error, F.col("fatal")),
        }
    )
    levels = F.filter(
        F.array(
            *[
                F.when(ev.shown_at(v, F.col("type"), F.col("status")), F.lit(v))
                for v in ("quiet", "default", "verbose")
            ]
        ),
        lambda v: v.isNotNull(),
    )
    lines = events.withColumn("line", ev.envelope(public, "backup"))
    shown = lines.select("event_id", F.explode(levels).alias("verbosity"), "line")
    # A run's own last word: the result of one that completed, the error of one that failed for good.
    completed, failed = F.col("type") == "completion", is_error & F.col("fatal")
    message = redaction.clean(F.col("source_event"))
    last = (
        F.when(completed, ev.result_envelope(F.struct(F.col("run_id").alias("runId")), "backup"))
        .when(failed, ev.error_envelope(F.lit(1), message, "backup"))
    )
    terminal = events.select("event_id", F.lit("terminal").alias("verbosity"), last.alias("line"))
    return shown.unionByName(terminal.where(F.col("line").isNotNull()))


VERBOSITY_FILTER = f"""
WITH e AS (
  SELECT *, CASE WHEN type = 'status' THEN CASE status WHEN 'started' THEN 'started' WHEN 'finished' THEN 'completed'
            ELSE 'running' END END AS state FROM ({COUNTED}) x),
l AS (
  SELECT event_id, type, state,
    '{{"schemaVersion":1,"type":"event","command":"backup","event":{{"runId":"' || run_id || '","timestamp":"' ||
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","phase":"' || phase || '","tool":"' || tool || '","type":"' || type || '"' ||
    coalesce(',"status":"' || state || '"', '') ||
    CASE WHEN type IN ('status', 'warning', 'error', 'cancelled') THEN ',"message":"' || source_event || '"' ELSE '' END ||
    CASE WHEN type = 'progress' THEN ',"completed":"' || completed || '"' || coalesce(',"total":"' || total || '"', '') ELSE '' END ||
    CASE WHEN type = 'error' THEN ',"fatal":' || fatal ELSE '' END || '}}}}' AS line
  FROM e)
SELECT event_id, 'verbose' AS verbosity, line FROM l
UNION ALL
SELECT event_id, 'default', line FROM l
WHERE type IN ('warning', 'error', 'cancelled', 'completion') OR state <> 'running'
UNION ALL
SELECT event_id, 'terminal', CASE WHEN type = 'completion'
  THEN '{{"schemaVersion":1,"type":"result","command":"backup","ok":true,"result":{{"runId":"' || run_id || '"}}}}'
  ELSE '{{"schemaVersion":1,"type":"error","command":"backup","ok":false,"error":{{"code":"OPERATION_FAILED","message":"' ||
       source_event || '"}}}}' END
FROM e WHERE type = 'completion' OR (type = 'error' AND fatal)
"""

QUERIES = {
    "event_parse": event_parse,
    "event_classify": event_classify,
    "completion_fields": completion_fields,
    "lifecycle_check": lifecycle_check,
    "sequence_check": sequence_check,
    "lock_budget": lock_budget,
    "fault_after_unlock": fault_after_unlock,
    "run_verdict": run_verdict,
    "progress_throttle": progress_throttle,
    "latest_progress": latest_progress,
    "verbosity_filter": verbosity_filter,
}
ORACLES = {
    "event_parse": EVENT_PARSE,
    "event_classify": EVENT_CLASSIFY,
    "completion_fields": COMPLETION_FIELDS,
    "lifecycle_check": LIFECYCLE_CHECK,
    "sequence_check": SEQUENCE_CHECK,
    "lock_budget": LOCK_BUDGET_SQL,
    "fault_after_unlock": FAULT_AFTER_UNLOCK,
    "run_verdict": RUN_VERDICT,
    "progress_throttle": PROGRESS_THROTTLE,
    "latest_progress": LATEST_PROGRESS,
    "verbosity_filter": VERBOSITY_FILTER,
}
