import os
import shutil
import uuid

import pytest

from conftest import rules
from tablewarden.findings import FINDINGS, RuleViolation
from tablewarden.operators import reconcile
from tablewarden.plans import snapshot
from tablewarden.plans.backup import Backup
from tablewarden.plans.restore import NotApproved, Restore, find_artifact, list_artifacts
from tablewarden.plans.snapshot import Snapshot

OBJECTS = "database_name string, table_name string, kind string, scope string, definition string"
ROWS = [
    ("app", "rows", "base-table", "ALL", None),
    ("app", "shape", "base-table", "SCHEMA", None),
    ("app", "empty", "base-table", "ALL", None),
    ("app", "row_view", "view", "ALL", "SELECT * FROM {database}.rows WHERE id < 10"),
]


def reader(spark, database, table):
    if table == "empty":
        return spark.range(0).selectExpr("id", "'x' AS value")
    return spark.range(5000).selectExpr("id", "concat('v', id) AS value")


@pytest.fixture()
def objects(spark):
    return spark.createDataFrame(ROWS, OBJECTS)


@pytest.fixture()
def artifact(spark, objects, tmp_path):
    target = str(tmp_path / "out" / "app-2026-07-21")
    Snapshot(spark, objects, reader, with_checksum=True).export(target)
    return target


@pytest.fixture()
def destination(spark):
    name = f"db_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def restore(spark, artifact, destination, **options):
    return Restore(spark, artifact, "app", destination, **options)


def test_round_trip(spark, objects, artifact, destination):
    manifest = {r.table_name: r for r in spark.read.parquet(f"{artifact}/manifest").collect()}
    assert (manifest["rows"].rows, manifest["shape"].rows, manifest["empty"].rows) == (5000, None, 0)
    whole = reconcile.checksum(reader(spark, "app", "rows")).collect()[0]
    assert manifest["rows"].checksum == whole.checksum
    assert snapshot.verify(spark, artifact).count() == 0
    back = restore(spark, artifact, destination).apply(True)
    assert {r.table_name: (r.kind, r.rows) for r in back.collect()} == {
        "rows": ("base-table", 5000),
        "shape": ("base-table", 0),
        "empty": ("base-table", 0),
        "row_view": ("view", None),
    }
    assert spark.table(f"{destination}.row_view").count() == 10
    assert spark.table(f"{destination}.shape").columns == ["id", "value"]
    copy = spark.table(f"{destination}.rows")
    assert reconcile.checksum(copy).collect()[0] == whole
    with pytest.raises(RuleViolation, match="destination-not-empty"):
        restore(spark, artifact, destination).apply(True)


def test_nothing_but_the_artifact_is_left(artifact):
    assert os.listdir(os.path.dirname(artifact)) == ["app-2026-07-21"]


def test_existing_target_is_refused(spark, objects, artifact):
    with pytest.raises(FileExistsError):
        Snapshot(spark, objects, reader).export(artifact)


def test_target_created_meanwhile_is_refused_and_kept(spark, objects, tmp_path):
    target = tmp_path / "out" / "late"

    def meddling(spark, database, table):
        target.mkdir(parents=True, exist_ok=True)
        return reader(spark, database, table)

    with pytest.raises(Exception, match="late"):
        Snapshot(spark, objects, meddling).export(str(target))
    assert os.listdir(tmp_path / "out") == ["late"] and os.listdir(target) == []


def test_failed_export_leaves_nothing(spark, objects, tmp_path):
    def broken(spark, database, table):
        if table == "empty":
            raise OSError("no such table")
        return reader(spark, database, table)

    with pytest.raises(OSError, match="no such table"):
        Snapshot(spark, objects, broken).export(str(tmp_path / "out" / "x"))
    assert os.listdir(tmp_path / "out") == []


def test_extra_rules_stop_the_publication(spark, objects, tmp_path):
    def refuse(manifest, files):
        return spark.createDataFrame([("house-rule", "x", "error", "no")], FINDINGS)

    with pytest.raises(RuleViolation, match="house-rule"):
        Snapshot(spark, objects, reader, extra_rules=[refuse]).export(str(tmp_path / "out" / "x"))


@pytest.mark.parametrize(
    ("options", "message"), [({"compression": "lzma"}, "compression"), ({"threads": 1}, "threads")]
)
def test_options_are_checked(spark, objects, tmp_path, options, message):
    with pytest.raises(ValueError, match=message):
        Snapshot(spark, objects, reader, **options).export(str(tmp_path / "x"))


def test_empty_selection_is_an_error(spark, objects, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        Snapshot(spark, objects.limit(0), reader).export(str(tmp_path / "x"))


def test_unsafe_names_are_refused_before_any_work(spark, tmp_path):
    bad = spark.createDataFrame([("app", "price$", "base-table", "ALL", None)], OBJECTS)
    with pytest.raises(RuleViolation, match="unsafe-identifier"):
        Snapshot(spark, bad, reader).export(str(tmp_path / "x"))


@pytest.mark.parametrize("compression", ["none", "gzip", "zstd"])
def test_compressions(spark, objects, tmp_path, compression):
    target = str(tmp_path / "x")
    Snapshot(spark, objects, reader, compression=compression, rows_per_file=1000).export(target)
    files = [f for f in os.listdir(f"{target}/data/app.rows") if f.endswith(".parquet")]
    assert len(files) >= 5
    assert all((compression == "none") != (f".{compression[:2]}" in f) for f in files)


def test_faults_are_found(spark, artifact):
    shutil.rmtree(f"{artifact}/data/app.shape")
    rows = f"{artifact}/data/app.rows"
    for name in sorted(os.listdir(rows))[:1]:
        os.remove(os.path.join(rows, name))
    extra = next(f for f in os.listdir(f"{artifact}/data/app.empty") if f.endswith(".parquet"))
    other = next(f for f in os.listdir(rows) if f.endswith(".parquet"))
    shutil.copy(os.path.join(rows, other), f"{artifact}/data/app.empty/{extra}-2.parquet")
    found = rules(snapshot.verify(spark, artifact))
    assert ("missing-schema", "app.shape") in found
    assert ("row-count", "app.empty") in found
    shutil.rmtree(f"{artifact}/manifest")
    assert [r for r, _ in rules(snapshot.verify(spark, artifact))] == ["not-an-artifact"]


def test_what_does_not_belong_to_the_artifact_is_found(spark, artifact):
    inside = next(os.path.join(artifact, "data", d) for d in sorted(os.listdir(os.path.join(artifact, "data"))))
    os.makedirs(os.path.join(inside, "deeper"))
    os.makedirs(os.path.join(artifact, "data", "app.unknown"))
    for name in (".hidden", "notes.txt", "data/stray.sql", f"data/{os.path.basename(inside)}/deeper/x"):
        with open(os.path.join(artifact, name), "w") as out:
            out.write("x")
    found = [s for r, s in rules(snapshot.verify(spark, artifact)) if r == "unexpected-entry"]
    own = os.path.basename(inside)
    assert found == sorted([".hidden", "data/app.unknown", f"data/{own}/deeper/x", "data/stray.sql", "notes.txt"])


def test_nothing_is_changed_without_approval(spark, artifact, destination):
    plans = []
    job = restore(spark, artifact, destination)
    with pytest.raises(NotApproved):
        job.apply(lambda plan: plans.append(plan))
    assert not spark.catalog.databaseExists(destination)
    plan = plans[0]
    assert (plan.source, plan.database, plan.destination_exists, plan.restored_objects) == (
        "app",
        destination,
        False,
        4,
    )


@pytest.mark.parametrize("policy", ["drop", "truncate", "delete"])
def test_overwrite_policies(spark, artifact, destination, policy):
    spark.sql(f"CREATE DATABASE {destination}")
    spark.sql(f"CREATE TABLE {destination}.rows (value STRING, id BIGINT) USING parquet")
    spark.sql(f"INSERT INTO {destination}.rows VALUES ('old', 1)")
    with pytest.raises(RuleViolation, match="overwrite-needs-existing"):
        restore(spark, artifact, destination, overwrite_policy=policy).apply(True)
    job = restore(
        spark, artifact, destination, destination_policy="allow-existing", overwrite_policy=policy
    )
    job.apply(True)
    table = spark.table(f"{destination}.rows")
    assert table.count() == 5000 and table.where("value = 'old'").count() == 0
    assert table.columns == (["id", "value"] if policy == "drop" else ["value", "id"])


def test_reject_finds_clashes_before_loading(spark, artifact, destination):
    spark.sql(f"CREATE DATABASE {destination}")
    spark.sql(f"CREATE TABLE {destination}.empty (id BIGINT) USING parquet")
    job = restore(spark, artifact, destination, destination_policy="allow-existing")
    with pytest.raises(FileExistsError):
        job.apply(True)
    assert [t.name for t in spark.catalog.listTables(destination)] == ["empty"]


def test_discovery(spark, artifact):
    root = os.path.dirname(artifact)
    assert [r.name for r in list_artifacts(spark, root).collect()] == ["app-2026-07-21"]
    assert find_artifact(spark, root, "app") == artifact
    assert find_artifact(spark, root, "app", "other") == f"{root}/other"
    with pytest.raises(LookupError, match="none matched"):
        find_artifact(spark, root, "web")
    with pytest.raises(ValueError):
        find_artifact(spark, root, "web", " ")
    os.mkdir(f"{root}/app-2026-07-22")
    with pytest.raises(LookupError, match="app-2026-07-21, app-2026-07-22"):
        find_artifact(spark, root, "app")
    assert list_artifacts(spark, f"{root}/nowhere").count() == 0


@pytest.mark.parametrize("database", ["app", "data"])
def test_tables_named_like_the_folders_make_the_round_trip(spark, tmp_path, destination, database):
    names = ["data", "bigdata", "metadata", "manifest"]
    rows = [(database, name, "base-table", "ALL", None) for name in names]
    target = str(tmp_path / "data" / "bigdata" / "out")
    Snapshot(spark, spark.createDataFrame(rows, OBJECTS), reader).export(target)
    assert snapshot.verify(spark, target).count() == 0
    back = Restore(spark, target, database, destination).apply(True)
    assert {r.table_name: r.rows for r in back.collect()} == dict.fromkeys(names, 5000)


CATALOG = [
    ("app", "rows", "base-table", "InnoDB"),
    ("app", "shape", "base-table", "InnoDB"),
    ("app", "tmp_x", "base-table", "MyISAM"),
    ("other", "t", "base-table", "InnoDB"),
]


def backup(spark, **options):
    tables = spark.createDataFrame(CATALOG, "database_name string, table_name string, kind string, engine string")
    keys = spark.createDataFrame([("app", "rows")], "database_name string, table_name string")
    return Backup(spark, {"tables": tables, "keys": keys}, reader, **{"databases": ["app"], **options})


def test_a_backup_checks_scopes_and_exports_in_one_call(spark, tmp_path):
    target = str(tmp_path / "out" / "app-1")
    manifest, warnings = backup(spark, drop=["app.tmp_*"], schema_only=["app.shape"], options={"with_checksum": True}).run(target)
    assert {(r.table_name, r.scope, r.rows) for r in manifest.collect()} == {("rows", "ALL", 5000), ("shape", "SCHEMA", None)}
    assert rules(warnings) == [("keyless-table", "app.shape")]
    assert snapshot.verify(spark, target).count() == 0


@pytest.mark.parametrize(
    ("options", "rule"),
    [({}, "unsafe-engine"), ({"databases": ["app", "none"], "drop": ["app.tmp_*"]}, "missing-database")],
)
def test_a_backup_stops_before_it_writes(spark, tmp_path, options, rule):
    with pytest.raises(RuleViolation, match=rule):
        backup(spark, **options).run(str(tmp_path / "x"))
    assert not os.path.exists(tmp_path / "x") and os.listdir(tmp_path) == []
