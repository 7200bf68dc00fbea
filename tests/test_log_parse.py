import json

import pytest

from tablewarden.operators import log_parse

LINE = {
    "schema_version": "1",
    "event_version": "1",
    "seq": 1,
    "run_id": "r",
    "ts": "2026-07-20 23:08:25.390001",
    "level": "INFO",
    "tool": "exporter",
    "event": "dump_started",
    "phase": "dump_start",
    "status": "started",
    "fatal": False,
    "kind": "event",
}
DONE = LINE | {
    "event": "dump_completed",
    "status": "finished",
    "phase": "dump_finish",
    "exit_code": "0",
    "errors": "0",
    "warnings": "1",
    "retries": "0",
    "files": "18446744073709551615",
    "duration_ms": "329",
}


def parse(spark, lines, **options):
    texts = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)]
    df = spark.createDataFrame(texts, "i int, line string")
    return log_parse.parse_lines(df, "exporter", **options).orderBy("i").collect()


CASES = [
    (LINE, None),
    (json.dumps(LINE) + "\r", None),
    ("{bad}", "malformed"),
    ("[1]", "malformed"),
    ('"x"', "malformed"),
    ("null", "malformed"),
    (json.dumps(LINE)[:-5], "malformed"),
    (json.dumps(LINE) + " trailing", "malformed"),
    (json.dumps(LINE) + json.dumps(LINE), "malformed"),
    (json.dumps(LINE) + "," + json.dumps(LINE), "malformed"),
    (json.dumps(LINE) + "] [", "malformed"),
    (json.dumps(LINE) + "]", "malformed"),
    (LINE | {"extra": [1, {"a": "]"}]}, None),
    (json.dumps(LINE)[:-1] + ', "x": {"a": 1, "a": 2}, "x": []}', None),
    (json.dumps(LINE)[:-1] + ', "seq": "2", "seq": 3}', None),
    (json.dumps(LINE)[:-1] + ', "seq": "2"}', "seq"),
    (LINE | {"schema_version": "2"}, "version"),
    (LINE | {"event_version": 1}, "version"),
    (LINE | {"tool": "loader"}, "tool"),
    (LINE | {"seq": "1"}, "seq"),
    (LINE | {"seq": -1}, "seq"),
    (LINE | {"seq": 1.5}, "seq"),
    (LINE | {"seq": 1.0}, None),
    (LINE | {"seq": 9007199254740991}, None),
    (LINE | {"seq": 9007199254740992}, "seq"),
    (LINE | {"parent_seq": None}, "parent_seq"),
    (LINE | {"parent_seq": 0}, None),
    (LINE | {"ts": "2026-07-20 23:08:25"}, "ts"),
    (LINE | {"ts": "2026-07-20 23:08:25.1234567"}, "ts"),
    (LINE | {"ts": 5}, "ts"),
    (LINE | {"event": ""}, "event"),
    (LINE | {"phase": 1}, "phase"),
    ({k: v for k, v in LINE.items() if k != "level"}, "level"),
    (LINE | {"fatal": "true"}, "fatal"),
    (LINE | {"retryable": None}, "retryable"),
    (LINE | {"rows": 5}, "counter:rows"),
    (LINE | {"rows": "05"}, "counter:rows"),
    (LINE | {"bytes": None}, "counter:bytes"),
    (LINE | {"run_id": ""}, "run_id"),
    (LINE | {"status": "odd"}, "unknown-status"),
    (DONE, None),
    ({k: v for k, v in DONE.items() if k != "files"}, "completion:missing"),
    (DONE | {"exit_code": "9007199254740993"}, "completion:exit_code"),
    (DONE | {"duration_ms": "9007199254740993"}, "completion:duration_ms"),
    (LINE | {"exit_code": "9007199254740993"}, None),
]


@pytest.fixture(scope="module")
def judged(spark):
    return parse(spark, [line for line, _ in CASES])


@pytest.mark.parametrize("i", range(len(CASES)))
def test_first_reason(judged, i):
    assert judged[i].reason == CASES[i][1], CASES[i][0]


def test_completion_keeps_its_exact_counters(spark):
    row = parse(spark, [DONE])[0]
    assert (row.type, row.files, row.exit_code, row.duration_ms) == (
        "completion",
        "18446744073709551615",
        0,
        329,
    )
    assert (row.phase, row.message, row.status, row.run_id) == ("backup", None, None, "r")


def test_fields_fall_back(spark):
    progress = LINE | {"status": "progress", "rows_done": "3", "rows_total": "9", "db": "a", "database": None}
    row, warn, quoted = parse(
        spark,
        [
            progress,
            LINE | {"level": "WARNING", "database": "b", "db": "a", "table": "t"},
            LINE | {"message": 'say "hi"\né'},
        ],
    )
    assert (row.rows, row.completed, row.total, row.database_name) == ("3", "3", "9", "a")
    assert (warn.type, warn.message, warn.database_name, warn.table_name) == (
        "warning",
        "dump_started",
        "b",
        "t",
    )
    assert quoted.message == 'say "hi"\né'


def test_unknown_keys_are_told(spark):
    row = parse(spark, [LINE], known_keys=[k for k in LINE if k not in ("kind", "seq")])[0]
    assert row.reason is None and row.unknown_keys == ["kind", "seq"]


def test_refused_lines_have_no_fields_and_go_to_quarantine(spark):
    df = spark.createDataFrame([("{bad}",), (json.dumps(LINE),)], "line string")
    parsed = log_parse.parse_lines(df, "exporter")
    assert [(r.line, r.reason) for r in log_parse.quarantine(parsed).collect()] == [
        ("{bad}", "malformed")
    ]
    assert [r.run_id for r in log_parse.accepted(parsed).collect()] == ["r"]


def test_filters_do_not_parse_again(spark):
    df = spark.createDataFrame([(json.dumps(LINE),)], "line string")
    plan = log_parse.accepted(log_parse.parse_lines(df, "exporter")).where("type = 'status'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson") <= 3
