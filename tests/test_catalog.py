import random

import pytest
from pyspark.sql import functions as F

from conftest import rules
from tablewarden import fixed_values as fixed
from tablewarden.findings import check
from tablewarden.functions import names
from tablewarden.operators import catalog, grants, selection
from tablewarden.sources.catalog import dumped_catalog

TABLES = "database_name string, table_name string, kind string, engine string, has_key boolean"


def test_engines_and_keys(spark):
    rows = [
        ("a", "good", "base-table", "innodb", True),
        ("a", "old", "base-table", "MyISAM", True),
        ("a", "none", "base-table", None, False),
        ("a", "view", "view", None, False),
    ]
    assert rules(catalog.catalog_findings(spark.createDataFrame(rows, TABLES))) == [
        ("keyless-table", "a.none"),
        ("unsafe-engine", "a.none"),
        ("unsafe-engine", "a.old"),
    ]


def test_counts_of_absent_databases_are_zero(spark):
    def of(*names):
        return spark.createDataFrame([(n,) for n in names], "database_name string")

    counted = catalog.object_counts(of("a", "b"), of("a", "a", "z"), of("a"), of())
    assert sorted(map(tuple, counted.collect())) == [("a", 3), ("b", 0)]
    assert [r.database_name for r in catalog.missing_members(of("a", "b"), of("a"), "database_name").collect()] == ["b"]


@pytest.mark.parametrize(
    ("version", "comment", "product"),
    [("8.4.1", "x", "mysql"), ("8.4.1", "MariaDB", "mariadb"), ("5.7", "", "unknown"), ("80.1", "", "unknown")],
)
def test_products(spark, version, comment, product):
    df = spark.range(1).select(catalog.product_of(F.lit(version), F.lit(comment)).alias("p"))
    assert df.collect()[0].p == product


DESTINATION = (
    "database string, objects string, destination_policy string, overwrite_policy string, "
    "log_bin string, session_log_bin string, binlog_policy string"
)


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (("d", "0", "require-empty", "reject", "1", "1", "enable"), []),
        (("", "0", "require-empty", "reject", "1", "1", "enable"), ["invalid-destination"]),
        (("a\0b", "0", "require-empty", "reject", "1", "1", "enable"), ["invalid-destination"]),
        (("MySQL", "0", "require-empty", "reject", "1", "1", "enable"), ["system-destination"]),
        (("d", "2", "require-empty", "reject", "1", "1", "enable"), ["destination-not-empty"]),
        (("d", "2", "allow-existing", "drop", "1", "1", "enable"), []),
        (("d", "0", "require-empty", "drop", "1", "1", "enable"), ["overwrite-needs-existing"]),
        (("d", "02", "allow-existing", "reject", "1", "1", "enable"), ["invalid-object-count"]),
        (("d", "9" * 30, "allow-existing", "reject", "1", "1", "enable"), ["invalid-object-count"]),
        (("d", "0", "require-empty", "reject", "2", "1", "enable"), ["invalid-binlog-value"]),
        (("d", "0", "require-empty", "reject", "0", "1", "enable"), ["binlog-unavailable"]),
        (("d", "0", "require-empty", "reject", "1", "1", "disable"), ["binlog-not-disabled"]),
    ],
)
def test_destination_rules(spark, row, expected):
    df = spark.createDataFrame([row], DESTINATION)
    found = check(df, [*catalog.destination_rules(), *catalog.binlog_rules()])
    assert [r for r, _ in rules(found)] == expected


REPLICA = "server string, replica_io_running string, slave_io_running string, replica_sql_running string, slave_sql_running string"


@pytest.mark.parametrize(
    ("flags", "expected"),
    [
        (("Yes", None, "YES", None), []),
        ((None, "yes", None, "Yes"), []),
        (("No", "Yes", "Yes", None), ["replica-stopped"]),
        (("Yes", None, None, None), ["replica-stopped"]),
        ((None, None, None, None), ["not-a-replica"]),
    ],
)
def test_replicas(spark, flags, expected):
    rows = spark.createDataFrame([("s", *flags)], REPLICA)
    assert [r for r, _ in rules(catalog.replica_findings(rows))] == expected
    told = catalog.replica_findings(rows.withColumn("reported", F.lit(True)))
    assert [r for r, _ in rules(told)] == (["replica-stopped"] if flags == (None,) * 4 else expected)


@pytest.mark.parametrize(
    ("status", "lag"),
    [
        ({}, 0),
        ({"Seconds_Behind_Source": "5"}, 5),
        ({"Seconds_Behind_Master": "7"}, 7),
        ({"Seconds_Behind_Source": None}, None),
        ({"Seconds_Behind_Source": "5", "Seconds_Behind_Master": None}, None),
    ],
)
def test_lag_keeps_unknown(spark, status, lag):
    df = spark.createDataFrame([(status,)], "status map<string,string>")
    assert df.select(catalog.replica_lag().alias("x")).collect()[0].x == lag


def parsed(spark, *statements):
    df = spark.createDataFrame([("u", s) for s in statements], "grantee string, stmt string")
    return grants.parse_grants(df)


@pytest.mark.parametrize(
    ("statement", "expected"),
    [
        ("GRANT SELECT, show view ON *.* TO `u`@`%`", ("GRANT", ["SELECT", "SHOW VIEW"], None)),
        ("grant ALL PRIVILEGES ON `app`.* TO u", ("GRANT", ["ALL PRIVILEGES"], "app")),
        (r"GRANT SELECT ON `a\_b\%\\c\d`.* TO u", ("GRANT", ["SELECT"], "a_b%\\c\\d")),
        ("GRANT SELECT ON `a``b`.* TO u", ("GRANT", ["SELECT"], "a`b")),
        ("REVOKE INSERT ON `app`.* FROM u", ("REVOKE", ["INSERT"], "app")),
        ("GRANT SELECT ON `app`.`t` TO u", None),
        ("GRANT SELECT (`c`) ON `app`.* TO u", None),
        ("GRANT PROXY ON ''@'' TO u", None),
    ],
)
def test_statements(spark, statement, expected):
    row = parsed(spark, statement).collect()[0]
    got = (row.action, row.privileges, row.database) if row.understood else None
    assert got == expected


def gaps(spark, statements, everywhere, per_database, databases=("a", "b")):
    accounts = spark.createDataFrame([("u",)], "grantee string")
    dbs = spark.createDataFrame([(d,) for d in databases], "database string")
    found = grants.privilege_gaps(accounts, parsed(spark, *statements), dbs, everywhere, per_database)
    return sorted((r.privilege, r.missing_databases) for r in found.collect())


@pytest.mark.parametrize(
    ("statements", "expected"),
    [
        (["GRANT SELECT, RELOAD ON *.* TO u"], []),
        (["GRANT ALL PRIVILEGES ON *.* TO u"], []),
        ([], [("RELOAD", 2), ("SELECT", 2)]),
        (["GRANT RELOAD ON *.* TO u", "GRANT SELECT ON `a`.* TO u"], [("SELECT", 1)]),
        (["GRANT RELOAD ON *.* TO u", "GRANT SELECT ON `a`.* TO u", "GRANT ALL PRIVILEGES ON `b`.* TO u"], []),
        (["GRANT RELOAD, SELECT ON *.* TO u", "REVOKE SELECT ON `a`.* FROM u"], [("SELECT", 1)]),
        (["GRANT RELOAD, SELECT ON *.* TO u", "REVOKE ALL PRIVILEGES ON `a`.* FROM u"], [("SELECT", 1)]),
        (["GRANT RELOAD, SELECT ON *.* TO u", "REVOKE SELECT ON `z`.* FROM u"], []),
        (["GRANT RELOAD ON `a`.* TO u", "GRANT SELECT ON *.* TO u"], [("RELOAD", 2)]),
        (["GRANT RELOAD ON *.* TO u", "GRANT SELECT ON `a`.* TO u", "GRANT SELECT ON `a`.* TO u"], [("SELECT", 1)]),
        (["GRANT RELOAD, SELECT ON *.* TO u", "REVOKE RELOAD ON *.* FROM u"], []),
    ],
)
def test_privilege_gaps(spark, statements, expected):
    assert gaps(spark, statements, ["RELOAD"], ["SELECT"]) == expected


def test_required_privileges():
    assert grants.required_global("mysql", "auto", "production") == ["RELOAD", "PROCESS", "BACKUP_ADMIN"]
    assert grants.required_global("mysql", "safe-no-lock", "replica") == ["REPLICATION CLIENT"]
    assert grants.required_global("mysql", "no-lock", "replica") == ["REPLICATION CLIENT"]
    assert grants.required_data("mysql", "auto", views=False) == ["SELECT", "TRIGGER"]
    assert grants.required_data("mariadb", "auto")[:2] == ["SELECT", "LOCK TABLES"]


@pytest.mark.parametrize(
    ("statements", "visible"),
    [
        (["GRANT ALL PRIVILEGES ON *.* TO u"], True),
        (["GRANT ALL PRIVILEGES ON `a`.* TO u"], True),
        (["GRANT ALL PRIVILEGES ON `b`.* TO u"], False),
        (["GRANT " + ", ".join(fixed.ALL_STATIC_PRIVILEGES) + " ON *.* TO u"], True),
        (["GRANT " + ", ".join(fixed.ALL_STATIC_PRIVILEGES) + " ON `a`.* TO u"], False),
        (
            [
                "GRANT " + ", ".join(fixed.ALL_STATIC_PRIVILEGES[:15]) + " ON *.* TO u",
                "GRANT " + ", ".join(fixed.ALL_STATIC_PRIVILEGES[15:]) + " ON *.* TO u",
            ],
            False,
        ),
        (["GRANT ALL PRIVILEGES ON *.* TO u", "REVOKE INSERT ON `a`.* FROM u"], False),
        (["GRANT ALL PRIVILEGES ON *.* TO u", "REVOKE INSERT ON `b`.* FROM u"], True),
    ],
)
def test_visibility(spark, statements, visible):
    requests = spark.createDataFrame([("u", "a")], "grantee string, database string")
    rows = grants.visibility(requests, parsed(spark, *statements)).collect()
    assert [r.visible for r in rows] == [visible]


def test_a_table_of_patterns_matches_as_the_list_does(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ab.c(1_é") for _ in range(rng.choice([1, 2, 3, 6])))
    tables = [(rng.choice(["app", "a", "ab", "b(", "c"]), word()) for _ in range(300)] + [("app", "x\ny"), ("app", "*")]
    globs = lambda: "".join(rng.choice(["a", "b", "*", "?", ".", "c", "é", "(", "*"]) for _ in range(rng.choice([1, 2, 4])))
    patterns = [f"{rng.choice(['app', 'a*', '*', '?', 'b(', '*b', 'a?'])}.{globs()}" for _ in range(150)]
    patterns += ["app.x*", "*.*", "??.?", "no-dot", ".x", "app.", None, "app.x*", r"app.\E*", "*.*"]
    catalog_rows = spark.createDataFrame(tables, "database_name string, table_name string")
    found = selection.match_pattern_table(catalog_rows, spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    good = sorted({p for p in patterns if p and names.is_qualified(p)})
    want = selection.select_tables(catalog_rows, good).select(F.explode("patterns"), "database_name", "table_name")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert found.count() > 100
    assert selection.match_pattern_table(catalog_rows, spark.createDataFrame([], "pattern string")).count() == 0


def test_ten_thousand_patterns_meet_names_by_equality(spark):
    catalog_rows = spark.range(1_000_000).select(F.concat(F.lit("db"), F.col("id") % 100).alias("database_name"), F.concat(F.lit("t_"), "id").alias("table_name"))
    patterns = spark.range(10_000).select(F.concat(F.lit("db?*.t_"), F.col("id") + 100_000, F.lit("*")).alias("pattern"))
    found = selection.match_pattern_table(catalog_rows, patterns)
    assert found.count() == 10_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_shapes_are_cut_and_the_others_meet_by_their_longest_run(spark, monkeypatch):
    monkeypatch.setattr(selection, "SHAPES", 2)
    test_a_table_of_patterns_matches_as_the_list_does(spark)


def test_patterns_of_one_database_meet_names_by_both_halves(spark):
    # All name one database, which is longer than any run of their tables'.
    code = F.lpad(F.col("id").cast("string"), 4, "0")
    tail = F.right(code, F.lit(2))
    tables = spark.range(4000).select(F.lit("warehouse").alias("database_name"), F.concat(F.lit("x"), code, F.lit("_"), tail).alias("table_name"))
    patterns = spark.range(4000).select(F.concat(F.lit("warehouse.?"), code, F.lit("*"), tail).alias("pattern"))
    assert selection.pattern_candidates(tables, patterns).count() == 4000  # not 16 million
    found = selection.match_pattern_table(tables, patterns).collect()
    assert len(found) == 4000 and all(r.pattern[11:15] == r.table_name[1:5] for r in found)


def test_a_dumped_catalog_keeps_digits_and_databases(spark, tmp_path):
    views = {
        "SCHEMATA": ['{"SCHEMA_NAME":"app"}', '{"SCHEMA_NAME":"other"}'],
        "TABLES": [
            '{"TABLE_SCHEMA":"app","TABLE_NAME":"t","TABLE_TYPE":"BASE TABLE","ENGINE":"InnoDB","TABLE_ROWS":18446744073709551615}',
            '{"TABLE_SCHEMA":"app","TABLE_NAME":"v","TABLE_TYPE":"VIEW","ENGINE":null,"TABLE_ROWS":null}',
            '{"TABLE_SCHEMA":"other","TABLE_NAME":"t","TABLE_TYPE":"BASE TABLE","ENGINE":"InnoDB","TABLE_ROWS":"1"}',
        ],
        "STATISTICS": ['{"TABLE_SCHEMA":"app","TABLE_NAME":"t","NON_UNIQUE":"0"}', '{"TABLE_SCHEMA":"app","TABLE_NAME":"u","NON_UNIQUE":1}'],
        "TRIGGERS": ['{"EVENT_OBJECT_SCHEMA":"app","EVENT_OBJECT_TABLE":"t"}'],
        "ROUTINES": ['{"ROUTINE_SCHEMA":"app"}', '{"ROUTINE_SCHEMA":"other"}'],
        "EVENTS": [],
    }
    for name, lines in views.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(lines))
    facts = dumped_catalog(spark, str(tmp_path), ["app"])
    assert [(r.table_name, r.kind, None if r.estimated_rows is None else str(r.estimated_rows)) for r in facts["tables"].orderBy("table_name").collect()] == [
        ("t", "base-table", "18446744073709551615"), ("v", "view", None),
    ]
    assert [tuple(r) for r in facts["keys"].collect()] == [("app", "t")]
    assert {n: f.count() for n, f in facts.items()} == {"databases": 1, "tables": 2, "keys": 1, "triggers": 1, "routines": 1, "events": 0}
    plan = facts["tables"]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(TABLE_SCHEMA" in plan or "PushedFilters: [IsNotNull(TABLE_SCHEMA), EqualTo(TABLE_SCHEMA,app)" in plan
