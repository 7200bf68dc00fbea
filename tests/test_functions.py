import pytest
from pyspark.sql import functions as F

from tablewarden.functions import events as ev
from tablewarden.functions import redaction, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ("1.0.3-9007199254740992", "1.0.3-9007199254740993", -1),
        ("1.0.3-999999999999999999999999", "1.0.3-4", 1),
        ("01.000.0003-0001", "1.0.3-1", 0),
        ("invalid", "1.0.3-1", None),
        ("1.0.3-1\n", "1.0.3-1", None),
    ],
)
def test_versions_compare_by_unbounded_parts(spark, left, right, expected):
    assert one(spark, versions.compare_versions(F.lit(left), F.lit(right))) == expected


@pytest.mark.parametrize(
    ("actual", "minimum", "expected"),
    [
        ("22.18.0", "22.18.0", True),
        ("v22.17.999999999999999999999999", "22.18.0", False),
        ("999999999999999999999999.0.0", "24.0.0", True),
        ("22.18.0-rc.1", "22.18.0", False),
        ("22.18.0garbage", "22.18.0", False),
    ],
)
def test_triples_at_least(spark, actual, minimum, expected):
    assert one(spark, versions.triple_at_least(F.lit(actual), F.lit(minimum))) is expected


def test_only_the_exact_version_line_is_read(spark):
    good = "loader v1.0.3-1, built against DB 8.0.46 with SSL support\n"
    assert one(spark, versions.printed_version(F.lit(good), "loader")) == "1.0.3-1"
    for bad in ("prefix loader v1.0.3-1\n", "exporter v1.0.3-1, built against x\n", good + "more"):
        assert one(spark, versions.printed_version(F.lit(bad), "loader")) is None


@pytest.mark.parametrize(
    ("text", "secrets", "expected"),
    [
        ("\x1b[31mhush\x1b[0m password=hunter2", ["hush"], "[redacted] password=[redacted]"),
        ("secret-suffix secret", ["secret", "secret-suffix"], "[redacted] [redacted]"),
        ("PWD : 'a b' x", [], "PWD : [redacted] x"),
        ('passwd="q\nr", y', [], "passwd=[redacted], y"),
        ("a\r\n\nb", [], "a b"),
        ("\x1b]0;title\x07x", [], "x"),
        ("a.b $1 \\x", [".b", "$1"], "a[redacted] [redacted] \\x"),
        ("pass\x1b[1mword=x1", [], "password=[redacted]"),
        ("\x1bcpa\x1b( Bss\x1b7word=x1 \x1b]8;;u\x9cz", [], "password=[redacted] z"),
    ],
)
def test_text_is_cleaned(spark, text, secrets, expected):
    assert one(spark, redaction.clean(F.lit(text), secrets)) == expected


def test_secrets_of_the_same_row_go_longest_first(spark):
    secrets = F.array(F.lit("ab"), F.lit("abc"), F.lit(""), F.lit("ab"))
    assert one(spark, redaction.hide_literals_of(F.lit("abc ab"), secrets)) == "[redacted] [redacted]"


def test_lines_are_cleaned_one_by_one(spark):
    assert one(spark, redaction.clean_lines(F.lit("a\r\npwd=x\n"))) == ["a", "pwd=[redacted]", ""]


def test_records_are_scrubbed_by_their_schema(spark):
    df = spark.sql(
        """SELECT 5L AS count, 'pwd=x' AS note, named_struct('apiToken', 't', 'deep',
           array(named_struct('Authorization', 'a', 'n', 1))) AS r, map('api-key', 1, 'b', 2) AS m,
           date'2024-01-02' AS d, cast(NULL AS struct<password:string>) AS gone, 1.5D AS ratio"""
    )
    row = redaction.clean_records(df).collect()[0].asDict(recursive=True)
    assert row == {
        "count": "5",
        "note": "pwd=[redacted]",
        "r": {"apiToken": "[redacted]", "deep": [{"Authorization": "[redacted]", "n": 1}]},
        "m": {"api-key": "[redacted]", "b": "2"},
        "d": "2024-01-02",
        "gone": None,
        "ratio": 1.5,
    }


def test_maps_variants_and_binaries_hold_no_secret(spark):
    df = spark.sql(
        """SELECT map(1, 'password=hunter2', 2, 'fine') AS by_number, X'70776430' AS raw,
           parse_json('{"password":"hunter2","a":{"apiToken" : 5,"n":1},"t":"pwd=x y"}') AS free,
           parse_json('{"credentials":{"user":"u"}}') AS nested, parse_json('[1,null]') AS plain"""
    )
    row = redaction.clean_records(df).collect()[0]
    assert row.by_number == {1: "password=[redacted]", 2: "fine"}
    assert row.raw == redaction.BINARY
    assert row.free == '{"a":{"apiToken":"[redacted]","n":1},"password":"[redacted]","t":"pwd=[redacted] y"}'
    assert row.nested == "[redacted]" and row.plain == "[1,null]"


def test_times_are_written_in_utc_whatever_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("SELECT timestamp'2024-01-02T03:04:05Z' AS t")
        assert redaction.clean_records(df).collect()[0].t == "2024-01-02T03:04:05.000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_public_projection_tells_only_whether_a_secret_is_set(spark):
    df = spark.createDataFrame([("h", None), ("i", "p")], "host string, password string")
    rows = redaction.public_projection(df, "password").orderBy("host").collect()
    assert [r.asDict() for r in rows] == [
        {"host": "h", "passwordConfigured": False},
        {"host": "i", "passwordConfigured": True},
    ]


@pytest.mark.parametrize(
    ("phase", "tool", "expected"),
    [
        ("dump_start", "exporter", "startup"),
        ("global_LOCK", "exporter", "locking"),
        ("checksum", "loader", "verification"),
        ("complete", "loader", "finalization"),
        ("dump", "exporter", "backup"),
        ("load", "loader", "restore"),
        ("start_lock", "loader", "startup"),
    ],
)
def test_phases(spark, phase, tool, expected):
    assert one(spark, ev.phase_of(F.lit(phase), F.lit(tool))) == expected


@pytest.mark.parametrize(
    ("status", "fatal", "level", "event", "expected"),
    [
        ("cancelled", True, "ERROR", "x", "cancelled"),
        ("progress", True, "INFO", "x", "error"),
        ("failed", False, "WARNING", "x", "error"),
        ("progress", False, "Warning", "x", "warning"),
        ("progress", False, "INFO", "x", "progress"),
        ("finished", False, "INFO", "dump_completed", "completion"),
        ("finished", False, "INFO", "x", "status"),
    ],
)
def test_type_precedence(spark, status, fatal, level, event, expected):
    columns = [F.lit(v) for v in (status, fatal, level, event)]
    assert one(spark, ev.type_of(*columns)) == expected


def test_labels_never_invent_a_total(spark):
    none = F.lit(None).cast("string")

    def label(type_, done, total, message="m"):
        return one(spark, ev.label_of(F.lit("backup"), F.lit(type_), done, total, F.lit(message)))

    assert label("progress", F.lit("2"), none) == "backup: progress"
    assert label("progress", F.lit("2"), F.lit("5")) == "backup: 2/5"
    assert label("warning", none, none) == "backup: m"
    assert label("warning", none, none, "") == "backup: warning"


def test_counters_beyond_doubles_stay_exact(spark):
    big = "18446744073709551615"
    assert str(one(spark, ev.counter(F.lit(big)))) == big
    assert not one(spark, ev.is_safe_integer(F.lit(big)))
    assert one(spark, ev.is_safe_integer(F.lit("9007199254740991")))
    assert one(spark, ev.counter(F.lit("9" * 39))) is None
    for text, ok in (("0", True), ("01", False), ("-1", False), ("1\n", False), ("", False)):
        assert one(spark, ev.is_counter(F.lit(text))) is ok


def test_outcomes_and_switches(spark):
    t, f = F.lit(True), F.lit(False)
    codes = [ev.outcome_code(*c) for c in ((t, t, t), (f, t, t), (f, f, t), (f, f, f))]
    assert [one(spark, c) for c in codes] == [130, 2, 1, 0]
    assert [one(spark, ev.zero_one(F.lit(v))) for v in ("0", "1", "2")] == [False, True, None]


def test_result_and_error_lines(spark):
    result = ev.result_envelope(F.struct(F.lit("r").alias("runId")), "backup")
    assert one(spark, result) == '{"schemaVersion":1,"type":"result","command":"backup","ok":true,"result":{"runId":"r"}}'
    names = {2: "INVALID_USAGE", 130: "CANCELLED", 1: "OPERATION_FAILED"}
    for code, name in names.items():
        line = ev.error_envelope(F.lit(code), F.lit("m"), "restore")
        assert one(spark, line) == (
            f'{{"schemaVersion":1,"type":"error","command":"restore","ok":false,"error":{{"code":"{name}","message":"m"}}}}'
        )


def test_envelope_leaves_out_absent_fields(spark):
    event = F.struct(F.lit("r").alias("runId"), F.lit(None).cast("string").alias("message"))
    assert one(spark, ev.envelope(event, "backup")) == (
        '{"schemaVersion":1,"type":"event","command":"backup","event":{"runId":"r"}}'
    )
