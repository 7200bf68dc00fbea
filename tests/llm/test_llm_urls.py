import pytest

from tablewarden.llm import url_filter
from tablewarden.llm.rules import URL_RULES

URLS = [
    ("https://www.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("http://m.example.com/en/2#t", "m.example.com", "/en/2", "example.com/en/", "block"),
    ("http://m.example.com/de/", "m.example.com", "/de/", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/ES/1", "a.net", "/ES/1", None, "allow"),
    ("http://notcom/es/", "notcom", "/es/", None, "allow"),
    ("http://x.com", "x.com", "", None, "allow"),
    ("x://a.com?/en/", "a.com", "", None, "allow"),
    ("no scheme/en/", "", "", None, "allow"),
    ("http://u/p://a.com/", "u", "/p://a.com/", None, "allow"),
    ("http://.com/", ".com", "/", "com/", "allow"),
    ("http://é.com/\n", "é.com", "/\n", "com/", "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_every_case_with_clashing_columns_nulls_and_repeats(spark):
    rows = [(i, u, "x") for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "y"), (None, URLS[1][0], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES), "page_id").collect()
    want = [(i, *rest) for i, (_, *rest) in enumerate(URLS)] + [(0, *URLS[0][1:]), (None, *URLS[1][1:])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rules", [[], [("", "/", "block"), (None, "/", "block"), ("com", None, "block")]])
def test_without_rules_all_is_default(spark, rules):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules), "page_id", default="block").collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "block")]


def test_ties_and_repeated_rules(spark):
    rules = [("a.com", "/b", "allow"), ("a.com", "/b", "block"), ("a.com", "/b", "block"), ("com", "/b/cc", "allow")]
    pages = spark.createDataFrame([(1, "http://a.com/b/cc")], "page_id long, url string")
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules), "page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("com/b/cc", "allow")]
    got = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules[:3]), "page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("a.com/b", "block")]


def test_empty_table_and_very_long_url(spark):
    rules = url_filter.rule_table(spark, URL_RULES)
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), rules, "page_id").count() == 0
    long = "http://" + "a." * 300 + "net/fr/" + "x" * 100_000
    got = url_filter.filter_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), rules, "page_id").collect()
    assert got[0].rule == "net/fr/"
