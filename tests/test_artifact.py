import pytest
from pyspark.sql import functions as F

from conftest import rules
from tablewarden.operators import artifact, reconcile
from tablewarden.plans.restore import verify_dump
from tablewarden.sources.artifact_files import list_entries, list_files, read_sections


def files(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_name string")


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("app-schema-create.sql", ("create", "app", None, None, None)),
        ("app-schema-create.sql.zst", ("create", "app", None, None, "zst")),
        ("app.users-schema.sql.gz", ("schema", "app", "users", None, "gz")),
        ("app.users-schema-view.sql", ("schema-view", "app", "users", None, None)),
        ("app.users-schema-triggers.sql", ("schema-triggers", "app", "users", None, None)),
        ("app.users.00000.sql.zst", ("data", "app", "users", "00000", "zst")),
        ("app.users.00000.00001.dat", ("data", "app", "users", "00000.00001", None)),
        ("app.users.x.sql", ("other", None, None, None, None)),
        ("app.users.1.sql.bz2", ("other", None, None, None, None)),
        ("metadata", ("other", None, None, None, None)),
        ("app.a-schema-schema.sql", ("schema", "app", "a-schema", None, None)),
    ],
)
def test_file_names(spark, name, expected):
    row = artifact.decode_files(files(spark, name)).collect()[0]
    assert (row.role, row.database_name, row.table_name, row.chunk, row.codec) == expected


def test_files_no_artifact_may_hold(spark):
    names = ["metadata.header", "metadata.partial", "metadata.partial.0", "tablewarden_x.sql", "../x", "ok.sql"]
    assert rules(artifact.file_findings(files(spark, *names))) == [
        ("control-file", "metadata.header"),
        ("control-file", "metadata.partial"),
        ("control-file", "metadata.partial.0"),
        ("control-file", "tablewarden_x.sql"),
        ("incomplete-artifact", "metadata.partial"),
        ("unsafe-path", "../x"),
    ]


MANIFEST = """# started
[config]
rows = 7
[loader_session_variables]
 sql_log_bin=1
[`app`.`users`]\r
real_table_name=users
rows = 5
rows = 6
[`app`.`summary`]
is_view = 1
[`app`.`users`]
rows = 0
[other]
SQL_LOG_BIN = 1
"""
SECTIONS = [
    ("[`app`.`summary`]", "app", "summary", None, "1"),
    ("[`app`.`users`]", "app", "users", "0", None),
    ("[`app`.`users`]", "app", "users", "5", None),
    ("[config]", None, None, "7", None),
    ("[loader_session_variables]", None, None, None, None),
    ("[other]", None, None, None, None),
]


def by_text(row):
    return tuple("" if v is None else v for v in row)


def test_sections_from_numbered_lines(spark):
    lines = [("m", i, line) for i, line in enumerate(MANIFEST.split("\n"))]
    df = spark.createDataFrame(lines, "artifact string, line_no long, line string")
    for size in (2, 100_000):
        found = artifact.sections(artifact.assign_headings(df, lines_per_chunk=size))
        got = [(r.heading, r.database_name, r.table_name, r.declared_rows, r.view_flag) for r in found.collect()]
        assert sorted(got, key=by_text) == sorted(SECTIONS, key=by_text)
    assert rules(artifact.section_findings(found)) == [
        ("binlog-override", "m"),
        ("duplicate-section", "m [`app`.`users`]"),
    ]


def test_sections_straight_from_a_text_file(spark, tmp_path):
    (tmp_path / "metadata").write_bytes(MANIFEST.encode())
    found = read_sections(spark, str(tmp_path / "metadata"))
    got = [
        (r.heading, r.database_name, r.table_name, r.declared_rows, r.view_flag)
        for r in found.collect()
    ]
    assert sorted(got, key=by_text) == sorted(SECTIONS, key=by_text)
    assert found.where("control_lines > 0").count() == 2


def test_files_are_listed_without_their_contents(spark, tmp_path):
    (tmp_path / "artifact" / "sub").mkdir(parents=True)
    (tmp_path / "artifact" / "a.sql").write_text("x")
    (tmp_path / "artifact" / "sub" / "b.sql").write_text("yz")
    listed = list_files(spark, str(tmp_path / "artifact"))
    assert sorted(map(tuple, listed.collect())) == [("a.sql", 1), ("sub/b.sql", 2)]


def test_nothing_escapes_the_listing_of_an_artifact(spark, tmp_path):
    root = tmp_path / "data" / "bigdata"
    (root / "sub").mkdir(parents=True)
    for name in ("app.data.0.sql", ".hidden", "_x.sql", "metadata.header"):
        (root / name).write_text("x")
    (root / "sub" / "metadata.partial").write_text("x")
    entries = list_entries(spark, str(root))
    assert sorted(map(tuple, entries.select("file_name", "regular").collect())) == [
        (".hidden", True), ("_x.sql", True), ("app.data.0.sql", True), ("metadata.header", True), ("sub", False),
    ]
    assert rules(artifact.file_findings(entries)) == [("control-file", "metadata.header"), ("unexpected-entry", "sub")]


def test_a_whole_dump_is_verified(spark, tmp_path):
    root = tmp_path / "dump"
    root.mkdir()
    for name in ("app-schema-create.sql", "app.t-schema.sql", "app.t.00000.sql"):
        (root / name).write_text("x")
    (root / "metadata").write_text("[`app`.`t`]\nrows = 3\n")
    assert rules(verify_dump(spark, str(root), "app", 3)) == []
    assert rules(verify_dump(spark, str(root), "other")) == [("empty-artifact", "other")]
    (root / ".hidden").write_text("x")
    (root / "sub").mkdir()
    (root / "metadata.partial").write_text("x")
    (root / "app.t.00000.sql").unlink()
    (root / "metadata").write_text("[`app`.`t`]\nrows = 3\n[`app`.`t`]\nrows = 4\n[loader_session_variables]\nsql_log_bin = 1\n")
    assert {r for r, _ in rules(verify_dump(spark, str(root), "app", 3))} >= {
        "unexpected-entry", "incomplete-artifact", "file-count", "binlog-override", "duplicate-section", "missing-data",
    }
    assert rules(verify_dump(spark, str(tmp_path / "none"), "app")) == [("not-an-artifact", str(tmp_path / "none"))]


def test_values_that_must_be_unique(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2), (None, 2)], "name string, size int")
    assert rules(artifact.repeated_values(rows, ["name"], "twice")) == [("twice", "a")]
    assert rules(artifact.repeated_values(rows, ["size", "name"], "twice")) == [("twice", "1 a")]


def test_an_indented_heading_hides_no_switch(spark, tmp_path):
    text = "[`app`.`t`]\nrows = 3\n  [loader_session_variables] \n SQL_LOG_BIN = 1\n[x]\ny = [1\n"
    (tmp_path / "metadata").write_text(text)
    found = read_sections(spark, str(tmp_path / "metadata")).withColumn("artifact", F.lit("m"))
    assert sorted(r.heading for r in found.collect()) == ["[`app`.`t`]", "[loader_session_variables]", "[x]"]
    assert rules(artifact.section_findings(found)) == [("binlog-override", "m")]


SELECTED = "database_name string, table_name string, kind string, scope string, has_triggers boolean"
SECTION = "database_name string, table_name string, section_start long, declared_rows string, view_flag string"
ALL_FILES = ("app-schema-create.sql", "app.t-schema.sql", "app.t.0.sql")


def export_rules(spark, selected=(), section=(), names=ALL_FILES, triggers=True):
    table = ("app", "t", "base-table", "ALL", False)
    objects = spark.createDataFrame([selected or table], SELECTED)
    manifest = spark.createDataFrame([section or ("app", "t", 1, "5", None)], SECTION)
    found = artifact.export_findings(objects, manifest, files(spark, *names), triggers)
    return [r for r, _ in rules(found)]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({"names": ALL_FILES[1:]}, ["missing-create-file"]),
        ({"names": ALL_FILES[:2]}, ["missing-data"]),
        ({"names": ALL_FILES[:2], "section": ("app", "t", 1, "0", None)}, []),
        ({"names": ("app-schema-create.sql", "app.t.0.sql")}, ["missing-schema"]),
        ({"section": ("app", "other", 1, "5", None)}, ["missing-section"]),
        ({"section": ("app", "t", 1, None, None)}, ["missing-row-count"]),
        ({"selected": ("app", "t", "base-table", "SCHEMA", False), "names": ALL_FILES[:2]}, []),
        ({"selected": ("app", "t", "view", "ALL", False), "section": ("app", "t", 1, None, "1")}, ["missing-view"]),
        ({"selected": ("app", "t", "base-table", "ALL", True)}, ["missing-triggers"]),
        ({"selected": ("app", "t", "base-table", "ALL", True), "triggers": False}, []),
    ],
)
def test_export_rules(spark, change, expected):
    assert export_rules(spark, **change) == expected


@pytest.mark.parametrize(
    ("section", "names", "expected"),
    [
        (("app", "t", 1, "5", None), ALL_FILES, []),
        (("app", "t", 1, None, None), ALL_FILES[:2], []),
        (("app", "t", 1, "5", None), ALL_FILES[:2], ["missing-data"]),
        (("app", "t", 1, "0", "2"), ALL_FILES, ["invalid-view-flag"]),
        (("app", "t", 1, None, "1"), ALL_FILES, ["missing-view"]),
        (("app", "t", 1, "0", "0"), (*ALL_FILES, "app.t-schema-view.sql"), ["unexpected-view"]),
        (("app", "t$", 1, "0", None), ALL_FILES, ["missing-schema", "unsafe-identifier"]),
        (("web", "t", 1, "0", None), ALL_FILES, ["missing-create-file", "missing-schema"]),
    ],
)
def test_restore_rules(spark, section, names, expected):
    manifest = spark.createDataFrame([section], SECTION)
    assert [r for r, _ in rules(artifact.restore_findings(manifest, files(spark, *names)))] == expected


def test_checksums_see_every_change(spark):
    df = spark.sql("SELECT id, if(id % 3 = 0, NULL, concat('v', id)) AS v, id * 0.001D AS x, map('k', id) AS m FROM range(50)")
    base = reconcile.checksum(df).collect()[0]
    assert reconcile.checksum(df.repartition(7)).collect()[0] == base
    for change in ("x + IF(id = 7, 1e-12, 0) AS x", "x"):
        other = df.selectExpr("id", "v", change, "m")
        assert (reconcile.checksum(other).collect()[0] == base) is (change == "x")
    swapped = df.selectExpr("id", "v", "x", "m").withColumn("v", reconcile.F.expr("IF(id = 0, 'new', v)"))
    assert reconcile.checksum(swapped).collect()[0].checksum != base.checksum
    nulls = spark.createDataFrame([("a", None)], "p string, q string")
    moved = spark.createDataFrame([(None, "a")], "p string, q string")
    assert reconcile.checksum(nulls).collect()[0] != reconcile.checksum(moved).collect()[0]
    assert reconcile.checksum(df.limit(0)).collect()[0].checksum == 0


def test_checksum_matches_a_plain_sum(spark):
    df = spark.range(1000)
    hashes = [r.h % (1 << 64) for r in df.select(reconcile.row_hash(df).alias("h")).collect()]
    assert int(reconcile.checksum(df).collect()[0].checksum) == sum(hashes)


def test_differences(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k int, v string")
    surplus = {(r.k, r.v): r.surplus for r in reconcile.row_surplus(left, right).collect()}
    assert surplus == {(1, "a"): 1, (2, "b"): 1, (2, "c"): -1, (4, "d"): -1}
    keyed = reconcile.keyed_difference(left.distinct(), right, ["k"]).collect()
    assert sorted((r.k, r.status, r.columns) for r in keyed) == [
        (2, "changed", ["v"]),
        (4, "right-only", None),
    ]


def test_reconcile_statuses(spark):
    source = [
        ("same", "base-table", "ALL", 5),
        ("less", "base-table", "ALL", 5),
        ("shape", "base-table", "SCHEMA", 5),
        ("filled", "base-table", "SCHEMA", 5),
        ("out", "base-table", "EXCLUDED", 5),
        ("leaked", "base-table", "EXCLUDED", 5),
        ("view", "view", "ALL", None),
        ("flat", "view", "ALL", None),
        ("gone", "base-table", "ALL", 5),
    ]
    restored = [
        ("same", "base-table", 5),
        ("less", "base-table", 4),
        ("shape", "base-table", 0),
        ("filled", "base-table", 1),
        ("leaked", "base-table", 5),
        ("view", "view", None),
        ("flat", "base-table", 3),
        ("new", "base-table", 1),
    ]
    got = reconcile.reconcile(
        spark.createDataFrame(source, "t string, kind string, scope string, rows long"),
        spark.createDataFrame(restored, "t string, kind string, rows long"),
        ["t"],
    )
    assert {r.t: r.status for r in got.collect()} == {
        "same": "match",
        "less": "rows-differ",
        "shape": "schema-only",
        "filled": "unexpected-rows",
        "out": "excluded",
        "leaked": "unexpected",
        "view": "match",
        "flat": "kind-changed",
        "gone": "missing",
        "new": "unexpected",
    }


def test_only_parts_that_differ_are_compared(spark):
    left = spark.range(200_000).select("id", (F.col("id") % 7).alias("v"), F.lit(None).cast("string").alias("t"))
    right = left.where("id <> 17").withColumn("v", F.when(F.col("id") == 55_555, 99).otherwise(F.col("v")))
    right = right.unionByName(spark.createDataFrame([(900_000, 1, "new")], "id long, v long, t string")).repartition(5)
    a, b = reconcile.narrowed(left, right, ["id"])
    assert a.count() < 20 and b.count() < 20
    found = {r.id: (r.status, r["columns"]) for r in reconcile.keyed_difference(a, b, ["id"]).collect()}
    assert found == {17: ("left-only", None), 55_555: ("changed", ["v"]), 900_000: ("right-only", None)}
    assert [d.count() for d in reconcile.narrowed(left, left.repartition(3), ["id"])] == [0, 0]
    twice = left.unionByName(left.where("id = 3"))
    surplus = reconcile.row_surplus(*reconcile.narrowed(twice, left, left.columns)).collect()
    assert [(r.id, r.surplus) for r in surplus] == [(3, 1)]
    assert [d.count() for d in reconcile.narrowed(left.limit(0), left.limit(3), ["id"])] == [0, 3]
