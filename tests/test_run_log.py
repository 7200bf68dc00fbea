"""Run-log operators against plain Python on random runs, with and without cutting hot runs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import ordered, run_log, throttle
from tablewarden.operators.run_log import RunLog

START = datetime(2026, 1, 1)
KINDS = {
    "lock": ("lock", "global_lock", "started", "status"),
    "consistent": ("backup_consistency", "startup", "finished", "status"),
    "unlock": ("table_unlock", "startup", "finished", "status"),
    "progress": ("dump_phase", "wait_database_finish", "progress", "progress"),
    "warned_progress": ("dump_phase", "wait_database_finish", "progress", "warning"),
    "warning": ("x", "dump", "warning", "warning"),
    "error": ("x", "dump", "failed", "error"),
    "other": ("x", "dump", "started", "status"),
}
SCHEMA = (
    "run_id string, sequence long, event_time timestamp, source_event string, source_phase string, "
    "source_status string, type string, fatal boolean, exit_code long, errors string, files string"
)


def make_run(run, steps):
    """steps: (kind, milliseconds)"""
    rows = []
    for seq, (kind, ms) in enumerate(steps):
        event, phase, status, type_ = KINDS[kind]
        at = START + timedelta(milliseconds=ms)
        rows.append((run, seq, at, event, phase, status, type_, False, None, None, None))
    return rows


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(7)
    made = {}
    for n in range(16):
        at, steps = 0, []
        for _ in range(rng.choice([1, 3, 10, 120])):
            at += rng.choice([0, 1, 50, 249, 250, 251, 4000, 9999, 10_001])
            steps.append((rng.choice(list(KINDS)), at))
        made[f"run-{n}"] = steps
    return made


@pytest.fixture(scope="module")
def log(spark, runs):
    rows = [row for run, steps in runs.items() for row in make_run(run, steps)]
    return RunLog(spark.createDataFrame(rows, SCHEMA).repartition(4))


WIDTHS = [None, 5]


@pytest.mark.parametrize("width", WIDTHS)
def test_lock_windows(log, runs, width):
    expected = set()
    for run, steps in runs.items():
        armed = None
        for seq, (kind, ms) in enumerate(steps):
            if kind == "lock" and armed is None:
                armed = (seq, ms)
            elif kind in ("progress", "warned_progress") and armed is not None:
                outcome = "late" if ms - armed[1] > 10_000 else "in_time"
                expected.add((run, armed[0], (ms - armed[1]) * 1000, outcome))
                armed = None
        if armed is not None:
            expected.add((run, armed[0], None, "never"))
    got = run_log.lock_windows(log, width=width).collect()
    assert {(r.run_id, r.sequence, r.waited_us, r.outcome) for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("width", WIDTHS)
def test_faults_after_unlock(log, runs, width):
    expected = set()
    for run, steps in runs.items():
        armed = unlocked = False
        for seq, (kind, _) in enumerate(steps):
            armed = armed or kind == "lock"
            unlocked = unlocked or (armed and kind == "unlock")
            if unlocked and KINDS[kind][3] in ("warning", "error"):
                expected.add((run, seq))
            if kind in ("progress", "warned_progress"):
                armed = unlocked = False
    got = run_log.faults_after_unlock(log, width=width).collect()
    assert {(r.run_id, r.sequence) for r in got} == expected
    assert len(got) == len(expected) > 0


def kept_of(steps, gap, last=None):
    kept = []
    for seq, (kind, ms) in enumerate(steps):
        if KINDS[kind][3] == "progress" and last is not None and ms - last < gap:
            continue
        kept.append(seq)
        last = ms
    return kept


# Stretches of microseconds: shorter than the gap, so that it spans many of them, and longer.
@pytest.mark.parametrize(("width", "gap"), [(None, 250), (10_000, 250), (1_000_000, 250), (100_000, 5000), (300_000, 30_000)])
def test_throttle(log, runs, width, gap):
    expected = {(run, seq) for run, steps in runs.items() for seq in kept_of(steps, gap)}
    got = throttle.throttle(log, gap, width).collect()
    assert {(r.run_id, r.sequence) for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("width", [None, 700_000])
def test_throttle_goes_on_from_a_seed(spark, log, runs, width):
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    names = [r for i, r in enumerate(runs) if i % 2]
    seed = spark.createDataFrame([(r, base - 100_000) for r in names], "run_id string, micros long")
    expected = {
        (run, seq)
        for run, steps in runs.items()
        for seq in kept_of(steps, 5000, -100 if run in names else None)
    }
    got = throttle.throttle(log, 5000, width, seed).collect()
    assert {(r.run_id, r.sequence) for r in got} == expected


def test_step_functions_compose_in_any_grouping():
    rng = random.Random(9)
    for _ in range(60):
        gap = rng.choice([1, 5, 40, 200])
        at, pieces = 0, []
        for _ in range(rng.choice([2, 3, 5])):
            times, drops = [], []
            for _ in range(rng.choice([1, 4, 30])):
                at += rng.choice([0, 1, 3, 50]) if times else rng.choice([1, 2, 60])
                times.append(at)
                drops.append(rng.random() < 0.9)
            by_time = sorted({t: all(d for s, d in zip(times, drops) if s == t) for t in times}.items())
            pieces.append(throttle.step_function(np.array([t for t, _ in by_time]), np.array([d for _, d in by_time]), gap))
        left, right = pieces[0], pieces[-1]
        for piece in pieces[1:]:
            left = throttle.composed(left, piece, gap)
        for piece in reversed(pieces[:-1]):
            right = throttle.composed(piece, right, gap)
        assert left == right
        for last in [None, *range(-gap - 2, 2)]:
            one_by_one = last
            for piece in pieces:
                one_by_one = throttle.applied(piece, one_by_one, gap)
            assert throttle.applied(left, last, gap) == one_by_one


def test_throttle_of_a_burst_at_one_time(spark):
    steps = [("progress", 0)] * 40 + [("other", 0), ("progress", 0)] + [("progress", 300)] * 50
    hot = RunLog(spark.createDataFrame(make_run("hot", steps), SCHEMA))
    got = [r.sequence for r in throttle.throttle(hot, 250, 50_000).orderBy("sequence").collect()]
    assert got == kept_of(steps, 250)


@pytest.mark.parametrize("width", [None, 20_000, 300_000])
def test_throttle_of_dense_progress_in_one_hot_run(spark, width):
    rng = random.Random(3)
    at, steps = 0, []
    for _ in range(3000):
        at += rng.choice([0, 1, 2, 7])
        steps.append(("progress" if rng.random() < 0.999 else "other", at))
    hot = RunLog(spark.createDataFrame(make_run("hot", steps), SCHEMA))
    got = [r.sequence for r in throttle.throttle(hot, 100, width).orderBy("sequence").collect()]
    assert got == kept_of(steps, 100)


@pytest.mark.parametrize(
    ("steps", "expected"),
    [
        (["lock", "consistent", "unlock", "progress"], "complete"),
        (["other", "lock", "warning", "consistent", "unlock", "progress", "other"], "complete"),
        (["lock", "consistent"], "incomplete"),
        (["other"], "incomplete"),
        (["consistent", "lock", "unlock", "progress"], "reordered"),
        (["lock", "lock", "consistent"], "reordered"),
        (["lock", "consistent", "unlock", "progress", "progress"], "reordered"),
        (["unlock"], "reordered"),
    ],
)
def test_lifecycle(spark, steps, expected):
    rows = make_run("r", [(k, i) for i, k in enumerate(steps)])
    state = run_log.lifecycle(RunLog(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [s.lifecycle for s in state] == [expected]


def test_numbers_and_headings_survive_cutting(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), i, rng.choice([None, None, "h" + str(i)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at long, h string")
    plain = ordered.numbered(df, ["k"], ["at"], "n", F.col("at")).collect()
    cut = ordered.numbered(df, ["k"], ["at"], "n", F.col("at"), width=37).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, cut))
    last, expected = {}, {}
    for k, at, h in rows:
        last[k] = h or last.get(k)
        expected[(k, at)] = last[k]
    for size in (7, 100_000):
        got = ordered.carried_forward(df, ["k"], "at", "h", "c", size).collect()
        assert {(r.k, r.at): r.c for r in got} == expected


def outcome(tool="exporter", exit_code=0, aborted=False, checked=True, files=None):
    return (tool, exit_code, aborted, checked, files)


GOOD = ["lock", "consistent", "unlock", "progress"]


@pytest.mark.parametrize(
    ("steps", "done", "facts", "reason"),
    [
        (GOOD, [(0, "0", "9")], outcome(files=9), None),
        (GOOD, [(0, "0", "9")], outcome(files=8), "file-count"),
        (GOOD, [(0, "0", "9" * 20)], outcome(), "invalid-file-count"),
        (GOOD, [(0, "1", "9")], outcome(), "completion-errors"),
        (GOOD, [(23, "0", "9")], outcome(), "completion-errors"),
        (GOOD, [], outcome(), "completion-count"),
        (GOOD, [(0, "0", "9")] * 2, outcome(), "completion-count"),
        (["lock"], [(0, "0", "9")], outcome(), "lock-budget"),
        (["lock", "progress"], [(0, "0", "9")], outcome(), "lifecycle"),
        (["lock", "progress"], [(0, "0", "9")], outcome(checked=False), None),
        (GOOD, [(0, "0", "9")], outcome(exit_code=1), "exit-code"),
        (GOOD, [(0, "0", "9")], outcome(exit_code=None), "exit-code"),
        (GOOD, [(0, "0", "9")], outcome(exit_code=1, aborted=True), "cancelled"),
        (["lock", "unlock", "warning", "progress"], [(0, "0", "9")], outcome(), "cancelled"),
        (["error"], [(0, "0", "9")], outcome("loader"), None),
        ([], [(0, "0", "9")], outcome("loader"), None),
        ([], [(0, "1", "9")], outcome("loader"), "exit-disagreement"),
        ([], [], outcome("loader"), "completion-count"),
    ],
)
def test_verdicts(spark, steps, done, facts, reason):
    rows = make_run("r", [(k, i) for i, k in enumerate(steps)])
    for i, (code, errors, files) in enumerate(done):
        at = START + timedelta(seconds=5 + i)
        rows.append(("r", 1000 + i, at, "x", "x", "finished", "completion", None, code, errors, files))
    outcomes = spark.createDataFrame(
        [("r", *facts)],
        "run_id string, tool string, exit int, aborted boolean, checked boolean, files_found long",
    )
    log = RunLog(spark.createDataFrame(rows, SCHEMA))
    verdict = run_log.judge(log, outcomes).collect()
    assert run_log.judge(log, outcomes, width=1).collect() == verdict
    assert [v.reason for v in verdict] == [reason]
    assert verdict[0].code == (0 if reason is None else 130 if reason == "cancelled" else 1)


@pytest.mark.parametrize("width", [None, 1, 5])
def test_the_watchdog_of_a_verdict_agrees_with_its_rows(spark, log, runs, width):
    """Runs cut at any place have the verdict that their locks and faults give."""
    over = {r.run_id for r in run_log.lock_windows(log).collect() if r.outcome != "in_time"}
    faults = {r.run_id for r in run_log.faults_after_unlock(log).collect()}
    rows = [(r, "exporter", 0, False, False, None) for r in runs]
    outcomes = spark.createDataFrame(
        rows, "run_id string, tool string, exit int, aborted boolean, checked boolean, files_found long"
    )
    found = {r.run_id: r.reason for r in run_log.judge(log, outcomes, width=width).collect()}
    assert found == {r: "lock-budget" if r in over else "cancelled" if r in faults else "completion-count" for r in runs}
    assert over and faults


def test_a_verdict_plans_without_a_job_and_reads_the_log_once(spark, log):
    outcomes = spark.createDataFrame(
        [("r", "exporter", 0, False, False, 1)],
        "run_id string, tool string, exit int, aborted boolean, checked boolean, files_found long",
    )
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = sorted(jobs())
    verdict = run_log.judge(log, outcomes)
    assert sorted(jobs()) == before
    plan = verdict._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_progress_and_terminals(spark):
    schema = "run_id string, sequence long, event_time timestamp, type string, completed string, total string"
    rows = [
        ("r", 1, START, "progress", "1", "9"),
        ("r", 3, START, "progress", "2", None),
        ("r", 2, START, "completion", None, None),
        ("r", 4, START, "error", None, None),
    ]
    log = RunLog(spark.createDataFrame(rows, schema))
    latest = run_log.latest_progress(log).collect()[0]
    assert (latest.progress_sequence, latest.completed, latest.progress) == (3, "2", None)
    ends = run_log.terminal_records(log, F.col("type").isin("completion", "error")).collect()[0]
    assert (ends.terminal_sequence, ends.terminal_type, ends.terminal_dropped) == (2, "completion", 1)


def test_fixture_log_of_the_driver_tables(spark):
    """Known answers on the small tables, counting progress by status alone."""
    from tablewarden.queries import common as c

    log = c.run_log(spark, "/root/testdata/sf0.01")
    plain = log.events.withColumn("type", F.col("source_status"))
    kept = throttle.throttle(RunLog(plain, log.order, log.run, log.at), 6 * 3600 * 1000)
    assert kept.count() == 9262
