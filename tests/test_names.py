import pytest
from pyspark.sql import functions as F

from conftest import rules
from tablewarden.functions import names
from tablewarden.operators import selection

CATALOG = [("app", "users"), ("app", "cache_1"), ("app+", "literal.table"), ("app", "a\nb")]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "database_name string, table_name string")


def chosen(df):
    return sorted((r.database_name, r.table_name) for r in df.collect())


def test_only_star_and_question_mark_are_special(catalog):
    assert chosen(selection.select_tables(catalog, ["app.cache_?"])) == [("app", "cache_1")]
    assert chosen(selection.select_tables(catalog, ["app+.literal.table"])) == [
        ("app+", "literal.table")
    ]
    assert chosen(selection.select_tables(catalog, ["app.users.*"])) == []


def test_wildcards_do_not_cross_lines(catalog):
    assert ("app", "a\nb") not in chosen(selection.select_tables(catalog, ["app.*"]))


def test_overlapping_patterns_give_each_table_once(catalog):
    rows = selection.select_tables(catalog, ["app.*", "*.users"]).collect()
    assert sorted((r.table_name, len(r.patterns)) for r in rows) == [("cache_1", 1), ("users", 2)]


@pytest.mark.parametrize("pattern", ["users", ".users", "app."])
def test_unqualified_patterns_are_refused(spark, catalog, pattern):
    with pytest.raises(ValueError, match="qualified"):
        selection.select_tables(catalog, [pattern])
    assert rules(selection.malformed_patterns(spark, [pattern, "a.b"])) == [
        ("malformed-pattern", pattern)
    ]


def test_unmatched_patterns_are_found(catalog):
    assert rules(selection.unmatched_patterns(catalog, ["app.missing*", "app.users"])) == [
        ("unmatched-pattern", "app.missing*")
    ]


def test_dropping_wins_over_structure_only(catalog):
    scoped = selection.resolve_scopes(
        catalog.where("table_name <> 'a\nb'"), ["app.cache_*"], ["app.users", "app.cache_*"]
    )
    assert sorted((r.serialized, r.scope) for r in scoped.collect()) == [
        ("`app+`.`literal.table`", "ALL"),
        ("`app`.`users`", "SCHEMA"),
    ]


def test_an_exclusion_that_matches_nothing_is_refused(catalog):
    with pytest.raises(ValueError, match="nope"):
        selection.resolve_scopes(catalog, ["nope.*"])
    chosen = catalog.where("table_name = 'users'")
    with pytest.raises(ValueError, match="app.c"):
        selection.resolve_scopes(chosen, ["app.c*"])
    assert selection.resolve_scopes(chosen, ["app.c*"], within=catalog).count() == 1


def test_scopes_need_no_shuffle(catalog):
    plan = selection.resolve_scopes(catalog, ["app.c*"], ["*.users"])
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_identifier_rules(spark):
    rows = [("app", "ok-1"), ("app", "price$"), ("app", "a`b"), ("app", "n\0"), ("app", "tablewarden_x")]
    found = rules(
        selection.identifier_findings(
            spark.createDataFrame(rows, "database_name string, table_name string")
        )
    )
    assert [r for r in found if r[0] == "unsafe-identifier"] == [
        ("unsafe-identifier", n) for n in sorted(["price$", "a`b", "n\0", "tablewarden_x"])
    ]
    assert ("backtick-in-section", "a`b") in found and ("nul-in-identifier", "n\0") in found


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    ("path", "unsafe"),
    [
        ("data/chunk.sql", False),
        ("", True),
        ("/etc/x", True),
        ("../outside", True),
        ("a/../../b", True),
        ("a/../b", False),
        ("a/./../b/../c", False),
        ("..hidden", True),
        ("a/..hidden", False),
    ],
)
def test_paths_stay_below_their_root(spark, path, unsafe):
    assert one(spark, names.is_unsafe_path(F.lit(path))) is unsafe


def test_quoting_lists_tokens_and_slugs(spark):
    assert one(spark, names.quoted(F.lit("a`b"))) == "`a``b`"
    assert one(spark, names.name_list(F.lit(" a, ,b\t,"))) == ["a", "b"]
    assert one(spark, names.is_blank(F.lit(" \t\n")))
    assert one(spark, names.safe_token(F.lit("ER_1"), "X")) == "ER_1"
    assert one(spark, names.safe_token(F.lit("er 1"), "X")) == "X"
    assert one(spark, names.slug(F.lit("--a b!!c--"))) == "a-b-c"
    assert one(spark, names.slug(F.lit("!!"))) == "database"
    day = F.lit("2026-07-21").cast("date")
    assert one(spark, names.dated_name(F.lit("app"), day)) == "app-2026-07-21"
    assert one(spark, names.expand_date_template(F.lit("x/{{date}}"), day)) == "x/2026-07-21"
