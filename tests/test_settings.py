import random

import pytest
from pyspark.sql import functions as F

from conftest import rules
from tablewarden.findings import check, first_failure
from tablewarden.operators import naming, settings


def merged(higher, lower):
    if isinstance(higher, dict) and isinstance(lower, dict):
        return {k: merged(higher[k], lower[k]) if k in higher and k in lower else higher.get(k, lower.get(k)) for k in {*higher, *lower}}
    return higher


def leaves(node, path=""):
    for key, value in node.items():
        name = f"{path}.{key}" if path else key
        if isinstance(value, dict):
            yield from leaves(value, name)
        else:
            yield name, value


def random_layer(rng, depth=0):
    layer = {}
    for key in "abc":
        roll = rng.random()
        if roll < 0.35 and depth < 2:
            nested = random_layer(rng, depth + 1)
            if nested:
                layer[key] = nested
        elif roll < 0.6:
            layer[key] = rng.choice([None, "x", "y"])
    return layer


def test_overlay_is_a_deep_merge(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for entity in range(60):
        layers = [random_layer(rng) for _ in range(4)]
        result = {}
        for layer in reversed(layers):
            result = merged(layer, result)
        for prio, layer in enumerate(layers):
            rows += [(entity, path, prio, value) for path, value in leaves(layer)]
        for path, value in leaves(result):
            expected[(entity, path)] = value
    df = spark.createDataFrame(rows, "entity long, path string, prio int, val string")
    got = settings.overlay(df).collect()
    assert {(r.entity, r.path): r.val for r in got} == expected
    assert len(got) == len(expected)


def greedy_keys(slugs):
    taken, keys = set(), []
    for slug in slugs:
        key, n = slug, 2
        while key in taken:
            key, n = f"{slug}-{n}", n + 1
        taken.add(key)
        keys.append(key)
    return keys


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("width", [1_000_000, 9])
def test_keys_are_those_of_taking_names_in_turn(spark, seed, width):
    rng = random.Random(seed)
    pool = ["a", "a", "a", "a-2", "a-3", "a-2-2", "a-2-2-2", "a-02", "a-1", "b", "b-2", "c-9", "a-4", "a-10"]
    slugs = [rng.choice(pool) for _ in range(70)]
    df = spark.createDataFrame(list(enumerate(slugs)), "at long, name string").repartition(3)
    got = [r.key for r in naming.unique_keys(df, "name", "at", width).orderBy("at").collect()]
    assert got == greedy_keys(slugs)


def test_a_name_may_have_very_many_numbered_children(spark):
    rng = random.Random(9)
    slugs = ["a"] * 3000 + [f"a-{n}" for n in range(2, 8002)] + ["a-5-2", "a-5", "a-5"]
    rng.shuffle(slugs)
    df = spark.createDataFrame(list(enumerate(slugs)), "at long, name string").repartition(3)
    got = [r.key for r in naming.unique_keys(df, "name", "at", 700).orderBy("at").collect()]
    assert got == greedy_keys(slugs)


def test_a_family_of_many_depths_is_one_pass(spark):
    rng = random.Random(2)
    slugs = ["a"] * 30 + [f"a-{n}" for n in range(2, 100_002)] + ["a" + "-2" * n for n in range(1, 12)] * 3 + ["a-7-2", "a-7"]
    rng.shuffle(slugs)
    df = spark.createDataFrame(list(enumerate(slugs)), "at long, name string").repartition(3)
    got = [r.key for r in naming.unique_keys(df, "name", "at").orderBy("at").collect()]
    assert got == greedy_keys(slugs)


def pick(spark, keys, listing):
    found = naming.pick_artifacts(
        spark.createDataFrame([(k,) for k in keys], "id string"),
        spark.createDataFrame([(n,) for n in listing], "name string"),
    )
    return {r.id: (r.matches, r.path) for r in found.collect()}


def test_one_match_is_picked_and_other_numbers_are_problems(spark):
    many = [f"m-{n:02}" for n in range(11)]
    got = pick(spark, ["app", "two", "none", "m", "x-y"], ["app-1", "two-a", "two-b", "x-y-1", "nodash", *many])
    assert got == {
        "app": (1, "app-1"),
        "two": (2, None),
        "none": (0, None),
        "m": (11, None),
        "x-y": (1, "x-y-1"),
    }
    keys = spark.createDataFrame([("m",), ("none",)], "id string")
    listing = spark.createDataFrame([(n,) for n in ["two-a", *many, many[0]]], "name string")
    found = naming.artifact_candidates(keys, listing).collect()
    assert sorted((r.id, r.name) for r in found) == [("m", n) for n in many]


def test_keys_and_names_are_dealt_to_as_many_tasks_as_there_are_rows_for(spark, monkeypatch):
    monkeypatch.setattr(naming, "ROWS_PER_TASK", 100)
    rng = random.Random(3)
    word = lambda: "-".join(rng.choice(["a", "b", "", "c1"]) for _ in range(rng.choice([1, 2, 3, 5])))
    ids, listed = [word() for _ in range(40)] + [None, "a"], [word() for _ in range(2000)] + [None, "a-x"]
    keys, listing = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(n,) for n in listed], "name string")
    want = sorted((i, n) for i in {i for i in ids if i is not None} for n in {n for n in listed if n} if n.startswith(i + "-"))
    found = naming.artifact_candidates(keys, listing)
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() == 21  # 2002 names, whatever spark.sql.shuffle.partitions says
    picked = naming.pick_artifacts(keys, listing)
    names_of = {i: [n for k, n in want if k == i] for i in ids}
    expected = [(i, len(names_of[i]), names_of[i][0] if len(names_of[i]) == 1 else None) for i in ids]
    assert sorted(map(tuple, picked.collect()), key=str) == sorted(expected, key=str)
    empty = spark.createDataFrame([], "id string")
    assert naming.pick_artifacts(empty, listing).count() == naming.artifact_candidates(empty, listing).count() == 0


SETTINGS = "id int, port int, threads int, threshold int, profile string, mode string, protect_ddl boolean, tls string"


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({"port": 0}, ["port-range"]),
        ({"port": None}, ["port-range"]),
        ({"port": 65536}, ["port-range"]),
        ({"threads": 1}, ["too-few-threads"]),
        ({"threshold": 0}, ["threshold-range"]),
        ({"threshold": 1}, []),
        ({"profile": "odd"}, ["unknown-profile"]),
        ({"mode": "no-lock"}, ["unsafe-consistency"]),
        ({"mode": "no-lock", "protect_ddl": False}, []),
        ({"mode": "auto", "protect_ddl": False}, ["unsafe-consistency"]),
        ({"mode": "safe-no-lock", "protect_ddl": False}, ["unsafe-consistency"]),
        ({"mode": "safe-no-lock", "protect_ddl": False, "profile": "expert"}, []),
        ({"mode": None}, ["unknown-mode", "unsafe-consistency"]),
        ({"tls": "verify-ca"}, ["certificate-needed"]),
    ],
)
def test_settings_rules(spark, change, expected):
    base = dict(id=1, port=3306, threads=4, threshold=None, profile="production", mode="auto", protect_ddl=True, tls="preferred")
    row = tuple((base | change).values())
    df = spark.createDataFrame([row], SETTINGS)
    found = check(df, [*settings.settings_rules(F.col("id")), settings.tls_rule(F.col("id"))])
    assert [r for r, _ in rules(found)] == expected


def test_references_and_known_keys(spark):
    used = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    known = spark.createDataFrame([("a",), ("c",)], "id string")
    found = settings.dangling_references(used, "k", known, "id", "server").collect()
    assert [(r.rule, r.subject, r.detail) for r in found] == [
        ("unknown-server", "b", "referred to by 2 rows")
    ]
    assert sorted(r.known for r in settings.known_keys(known.union(known), "id").collect()) == ["a", "c"]
    many = spark.range(5000)
    assert settings.known_keys(many, "id").count() == 5000
    assert settings.known_keys(known.limit(0), "id").count() == 0


def test_first_failure_follows_the_rule_order(spark):
    found = spark.createDataFrame(
        [("b", "2", "error", "x"), ("a", "9", "warning", "x"), ("c", "1", "error", "x"), ("b", "1", "error", "y")],
        "rule string, subject string, severity string, detail string",
    )
    assert [tuple(r)[:2] for r in first_failure(found, ["a", "b", "c"]).collect()] == [("b", "1")]
