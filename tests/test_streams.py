import json
import os
import time

from pyspark.sql import functions as F

from tablewarden.sources.log_tail import tail_lines
from tablewarden.sources.run_log import read_lines, stream_lines
from tablewarden.streaming import streams

BASE = {"schema_version": "1", "event_version": "1", "level": "INFO", "tool": "exporter", "fatal": False}
LOCK = ("lock", "global_lock", "started")
CONSISTENT = ("backup_consistency", "startup", "finished")
UNLOCK = ("table_unlock", "startup", "finished")
PROGRESS = ("dump_phase", "wait_database_finish", "progress")


def line(run, seq, ms, step):
    event, phase, status = step
    at = f"2026-01-01 00:{ms // 60000:02}:{ms // 1000 % 60:02}.{ms % 1000:03}"
    return json.dumps(BASE | {"run_id": run, "seq": seq, "ts": at, "event": event, "phase": phase, "status": status})


def write(folder, name, lines, age):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as out:
        out.write("\n".join(lines) + "\n")
    os.utime(path, (time.time() - age, time.time() - age))


def events(spark, folder, **options):
    return streams.typed_events(stream_lines(spark, folder, **options), "exporter", "0 seconds")


def test_lines_of_either_ending_and_no_blanks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes("é1\r\n\r\n\nb\nc".encode())
    assert sorted(r.line for r in read_lines(spark, str(tmp_path)).collect()) == ["b", "c", "é1"]


def test_watchdog_reports_at_the_deadline_across_micro_batches(spark, tmp_path):
    logs = str(tmp_path / "logs")
    first = [
        line("late", 1, 0, LOCK),
        line("never", 1, 1000, LOCK),
        line("ok", 1, 5000, LOCK),
        line("ok", 2, 15_000, PROGRESS),
        line("tie", 2, 5000, PROGRESS),
        line("tie", 3, 5000, LOCK),
        line("next", 1, 9999, LOCK),
    ]
    write(logs, "1.jsonl", first, 100)
    write(logs, "2.jsonl", [line("late", 2, 10_001, PROGRESS), line("next", 2, 19_000, PROGRESS)], 50)
    write(logs, "3.jsonl", [line("closing", 1, 600_000, PROGRESS)], 10)
    # The watermark moves between the files; a delay lets the second file's rows count.
    slow = streams.parsed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter")
    got = streams.drain(spark, streams.watch_locks(slow, delay="1 minute"), str(tmp_path / "w"), shape=streams.told_locks)
    assert {(r.run_id, r.sequence): r.over_budget for r in got.collect()} == {
        ("late", 1): True,
        ("never", 1): True,
        ("ok", 1): False,
        ("tie", 3): True,
        ("next", 1): False,
    }


def test_lifecycle_is_followed_across_micro_batches(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(logs, "1.jsonl", [line("good", 1, 0, LOCK), line("bad", 1, 0, UNLOCK)], 100)
    rest = [line("good", i + 2, 10 * i, s) for i, s in enumerate([CONSISTENT, UNLOCK, PROGRESS], 1)]
    write(logs, "2.jsonl", rest, 50)
    followed = streams.follow_lifecycle(events(spark, logs, maxFilesPerTrigger="1"))
    rows = streams.drain(spark, followed, str(tmp_path / "l"), mode="update").collect()
    states = {(r.run_id, r.batch_id): r.lifecycle for r in rows}
    assert states[("good", 0)] == "incomplete" and states[("good", 1)] == "complete"
    assert states[("bad", 0)] == "reordered"


def test_state_goes_when_runs_have_ended(spark, tmp_path):
    logs = str(tmp_path / "logs")
    steps = [LOCK, CONSISTENT, UNLOCK, PROGRESS]
    for n in range(6):  # one run per file, minutes apart
        write(logs, f"{n}.jsonl", [line(f"r{n}", i, 90_000 * n + 10 * i, s) for i, s in enumerate(steps)], 100 - n)
    write(logs, "9.jsonl", [line("closing", 1, 3_000_000, PROGRESS)], 10)
    source = streams.typed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "1 second")
    followed = streams.follow_lifecycle(source, idle="20 seconds")
    query = (
        followed.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
        .outputMode("append").format("parquet").start(str(tmp_path / "o"))
    )
    query.awaitTermination()
    told = spark.read.parquet(str(tmp_path / "o"))
    assert {r.run_id: r.lifecycle for r in told.collect()} == {f"r{n}": "complete" for n in range(6)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 6 and max(held) <= 3 and held[-1] <= 1


def test_a_burst_of_locks_keeps_state_rows_small(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(logs, "1.jsonl", [line("hot", i, 100 + i % 3, LOCK) for i in range(4000)] + [line("hot", 9000, 9000, PROGRESS)], 100)
    write(logs, "2.jsonl", [line("closing", 1, 600_000, PROGRESS)], 10)
    slow = streams.parsed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter")
    watched = streams.watch_locks(slow, delay="1 minute")
    seen = []

    def told(batch):
        seen.append(watched.schema)
        return streams.told_locks(batch)

    got = streams.drain(spark, watched, str(tmp_path / "w"), shape=told)
    assert got.count() == 4000 and got.where("over_budget").isEmpty()
    # A lock is a row of its own: no row holds a list.
    assert seen and not any(f.dataType.typeName() == "array" for f in watched.schema)


def test_throttle_of_late_lines_across_micro_batches(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(logs, "1.jsonl", [line("r", i, 100 * i, PROGRESS) for i in (0, 2, 3, 7, 5)] + [line("gone", 1, 0, PROGRESS)], 100)
    write(logs, "2.jsonl", [line("r", i, 100 * i, PROGRESS) for i in (9, 1, 4, 8, 6)], 50)
    write(logs, "3.jsonl", [line("closing", i, 600_000 + 60_000 * i, PROGRESS) for i in range(2)], 10)
    events = streams.typed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "2 seconds")
    kept = streams.drain_throttled(spark, events, str(tmp_path / "t"))
    assert sorted(r.sequence for r in kept.where("run_id = 'r'").collect()) == [0, 3, 6, 9]


def test_throttle_goes_on_across_batches_and_forgets(spark, tmp_path, monkeypatch):
    logs, folder = str(tmp_path / "logs"), str(tmp_path / "t")
    slices = [range(0, 5), range(5, 10), range(10, 15)]
    for n, part in enumerate(slices):
        rows = [line("r", i, 100 * i, PROGRESS) for i in part] + [line(f"once{n}", 0, 100 * part[0], PROGRESS)]
        write(logs, f"{n}.jsonl", rows, 100 - n)
        events = streams.typed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "0 seconds")
        streams.drain_throttled(spark, events, folder)  # goes on where the last call ended
    write(logs, "9.jsonl", [line("closing", 1, 600_000, PROGRESS), line("closing", 2, 900_000, PROGRESS)], 10)
    events = streams.typed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "0 seconds")
    kept = streams.drain_throttled(spark, events, folder)
    assert sorted(r.sequence for r in kept.where("run_id = 'r'").collect()) == [0, 3, 6, 9, 12]
    state = spark.read.parquet(f"{folder}/thinned/state")
    newest = state.where(F.col("after") == state.agg(F.max("after")).first()[0])
    assert {r.run_id for r in newest.collect()} <= {"closing"}


def test_one_terminal_status_and_hook(spark, tmp_path):
    logs = str(tmp_path / "logs")
    failed = ("x", "dump", "failed")
    write(logs, "1.jsonl", [line("r", 1, 0, failed), line("r", 2, 5, failed), line("s", 1, 0, LOCK)], 100)
    write(logs, "2.jsonl", [line("r", 3, 10, failed), "{torn"], 50)

    def source():
        return streams.typed_events(
            stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "1 hour"
        )

    ended = streams.drain(
        spark, streams.terminal_records(source(), F.col("type") == "error"), str(tmp_path / "e")
    )
    assert sorted((r.run_id, r.sequence, r.repeat) for r in ended.collect()) == [("r", 1, False), ("r", 2, True), ("r", 3, True)]
    seen = []
    status = streams.drain(
        spark,
        streams.run_status(source()),
        str(tmp_path / "s"),
        mode="update",
        each_batch=lambda batch, n: seen.append((n, batch.count())),
    )
    last = status.groupBy("run_id").agg(F.max_by("events", "batch_id").alias("n"))
    assert {r.run_id: r.n for r in last.collect()} == {"r": 3, "s": 1}
    assert seen[:2] == [(0, 2), (1, 1)]
    refused = streams.drain(
        spark, streams.refused_lines(stream_lines(spark, logs), "exporter"), str(tmp_path / "q")
    )
    assert [tuple(r) for r in refused.collect()] == [("{torn", "malformed")]


def test_a_second_terminal_record_is_a_repeat_long_after_the_watermark(spark, tmp_path):
    logs = str(tmp_path / "logs")
    failed = ("x", "dump", "failed")
    write(logs, "1.jsonl", [line("r", 1, 0, failed), line("s", 1, 0, failed)], 100)
    for n in range(3):
        write(logs, f"{n + 2}.jsonl", [line("other", n, 600_000 * (n + 1), failed)], 90 - n)
    write(logs, "6.jsonl", [line("r", 2, 2_400_000, failed), line("t", 1, 2_400_000, failed)], 50)
    source = streams.typed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "1 second")
    for remember, repeat in (("2 hours", True), ("15 minutes", False)):
        told = streams.drain(spark, streams.terminal_records(source, F.col("type") == "error", remember), str(tmp_path / remember[:2]))
        found = {(r.run_id, r.sequence): r.repeat for r in told.collect()}
        assert found[("r", 1)] is found[("t", 1)] is found[("s", 1)] is False
        assert found[("r", 2)] is repeat


def test_runs_are_judged_in_groups_and_forgotten_after_a_repeat_too(spark, tmp_path):
    logs, folder = str(tmp_path / "logs"), str(tmp_path / "e")
    failed = ("x", "dump", "failed")
    minute = 60_000
    runs = [f"r{n}" for n in range(60)]
    batches = [
        [line(r, 1, minute, failed) for r in runs[:40]] + [line(r, 2, minute + 5, failed) for r in runs[:5]],
        [line(r, 3, 5 * minute, failed) for r in runs[:20]] + [line(r, 1, 5 * minute, failed) for r in runs[40:]],
        [line("other", 1, 50 * minute, failed)],
        [line("other", 2, 50 * minute, failed)],  # by now the first batch's runs have been forgotten
        [line(r, 4, 51 * minute, failed) for r in runs[:20]],
    ]
    for n, rows in enumerate(batches):
        write(logs, f"{n}.jsonl", rows, 100 - n)
    source = streams.typed_events(stream_lines(spark, logs, maxFilesPerTrigger="1"), "exporter", "1 second")
    told = streams.drain(spark, streams.terminal_records(source, F.col("type") == "error", "30 minutes", groups=3), folder)
    found = {(r.run_id, r.sequence): r.repeat for r in told.collect()}
    assert len(found) == sum(map(len, batches))
    assert {k for k, repeat in found.items() if repeat} == {(r, 2) for r in runs[:5]} | {(r, 3) for r in runs[:20]} | {("other", 2)}
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert 0 < state.count() <= 3  # a row a group, not a row a run


def test_scrub_in_flight(spark, tmp_path):
    logs = str(tmp_path / "logs")
    write(logs, "1.txt", ["pwd=x y"], 10)
    out = streams.drain(
        spark, streams.scrub(stream_lines(spark, logs), "line"), str(tmp_path / "c")
    )
    assert [r.line for r in out.collect()] == ["pwd=[redacted] y"]


def test_a_log_that_grows_in_the_middle_of_a_line_loses_and_doubles_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    whole = "".join(f"línea {i} {'x' * (i % 50)}{chr(13) if i % 3 else ''}\n" for i in range(400)).encode()
    cuts = [0, 5, 6, 7, 900, 901, 5000, len(whole) - 1, len(whole)]
    seen = []
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        with open(logs / "a.log", "ab") as out:
            out.write(whole[low:high])
        if n == 4:
            (logs / "b.log").write_bytes(b"other\n\nhalf")
        stream = tail_lines(spark, str(logs), splitBytes="700")
        query = (
            stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c"))
            .format("parquet").start(str(tmp_path / "o"))
        )
        query.awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "o")).count())
    told = [(r.file, r.at, r.line) for r in spark.read.parquet(str(tmp_path / "o")).orderBy("file", "at").collect()]
    lines = whole.decode().split("\n")[:-1]
    assert [t[2] for t in told if t[0] == "a.log"] == [line.rstrip("\r") for line in lines]
    assert [t for t in told if t[0] == "b.log"] == [("b.log", 0, "other")]
    assert seen == sorted(seen) and seen[0] == 0 and len(set(told)) == len(told)
