import shutil
from datetime import datetime
from decimal import Decimal

import pytest

from assaylake import schemas
from assaylake.operators import accounts
from assaylake.sources import sinks, snapshots, tables, uploads
from test_accounts import T0, make_patches, make_users
from test_logins import PEOPLE


def test_snapshots(spark, rows, tmp_path):
    root = str(tmp_path / "users")
    assert snapshots.current_version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root)
    assert snapshots.write_snapshot(make_users(spark, PEOPLE), root) == 1
    users = snapshots.read_snapshot(spark, root)
    patches = make_patches(spark, [{"seq": 1, "user_id": 1, "role": "admin"}])
    changed = accounts.apply_patches(users, accounts.decide_patches(patches, users))
    assert snapshots.write_snapshot(changed, root) == 2
    assert rows(snapshots.read_snapshot(spark, root), "id", "role") == [(1, "admin"), (2, "user")]
    assert rows(snapshots.read_snapshot(spark, root, 1), "id", "role") == [(1, "user"), (2, "user")]


def test_append_users(spark, rows, tmp_path):
    path = str(tmp_path / "users")
    sinks.append(make_users(spark, PEOPLE), path)
    users = tables.read_users(spark, path)
    request = spark.createDataFrame([(1, "new", "n@x.org", "h", T0)], schemas.REGISTER_REQUEST)
    new = accounts.register(request, users).drop("seq")
    sinks.append(new.select(*schemas.USER.names), path)
    assert rows(tables.read_users(spark, path), "id", "username") == [(1, "bob"), (2, "Élan"), (3, "new")]


def test_audit_by_day(spark, rows, tmp_path):
    path = str(tmp_path / "audit")
    audit = spark.createDataFrame(
        [(i, i, "u", None, True, datetime(2024, 1, i, 12)) for i in range(1, 6)], schemas.AUDIT
    )
    sinks.append_audit(audit, path)
    some = tables.read_audit(spark, path, "2024-01-02", "2024-01-03")
    assert rows(some, "id") == [(2,), (3,)]
    assert "PartitionFilters: [isnotnull(dt" in some._jdf.queryExecution().toString()


HEADER = ",".join(schemas.UPLOAD.names)


def test_uploads(spark, rows, tmp_path):
    folder = tmp_path / "up"
    folder.mkdir()
    (folder / "a.csv").write_text(
        f"{HEADER}\ne1,1,reaction,20.5,1,7,true\ne2,1,reaction,hot,1,7,true\ne3,1\n,2,reaction,1,1,1,false\n"
        "e5,me,reaction,1,-1,,maybe\ne6,1,alchemy,1,1,1,true\n"
    )
    (folder / "b.CSV").write_text(f"{HEADER}\ne4,2,,1,1,1,true\n")
    (folder / "notes.txt").write_text("not an upload")
    (folder / "sheet.xlsx").write_bytes(b"PK\x03\x04e9,1,reaction,1,1,1,true\n")
    good, bad = uploads.process_uploads(uploads.read_uploads(spark, str(folder)))
    assert rows(good, "experiment_id", "temperature", "success", "file_name") == [
        ("e1", 20.5, True, "a.csv")
    ]
    assert [f.dataType for f in good.schema][:7] == [f.dataType for f in schemas.UPLOAD]
    assert rows(bad, "file_name", "errors") == [
        ("a.csv", ["id_missing"]), ("a.csv", ["line_incomplete"]), ("a.csv", ["temperature_unreadable"]),
        ("a.csv", ["type_unknown"]),
        ("a.csv", ["user_id_unreadable", "success_unreadable", "pressure_negative", "outcome_missing"]),
        ("b.CSV", ["type_missing"]),
    ]
    assert rows(bad.filter("experiment_id = 'e2'"), "temperature") == [("hot",)]


def test_a_file_counts_once(spark, rows, tmp_path):
    folder, root = tmp_path / "up", str(tmp_path / "taken")
    (folder / "deep").mkdir(parents=True)
    line = "{},1,reaction,20.5,1,7,true\n"
    (folder / "a.csv").write_text(HEADER + "\n" + line.format("e1"))
    (folder / "deep" / "copy-of-a.csv").write_text(HEADER + "\n" + line.format("e1"))
    (folder / "sheet.xlsx").write_bytes(b"PK")
    assert uploads.ingest_uploads(spark, str(folder), root) == 1
    assert rows(uploads.ledger(spark, root), "file_name", "status") == [
        ("a.csv", "new"), ("copy-of-a.csv", "repeated"), ("sheet.xlsx", "not_csv")
    ]
    (folder / "b.csv").write_text(HEADER + "\n" + line.format("e2"))
    assert uploads.ingest_uploads(spark, str(folder), root) == 2
    assert uploads.ingest_uploads(spark, str(folder), root) == 3
    taken = spark.read.parquet(f"{root}/rows")
    assert rows(taken, "batch", "experiment_id") == [(1, "e1"), (2, "e2")]
    # An intake that died before its ledger is done again under its own number.
    shutil.rmtree(f"{root}/ledger/batch=3")
    shutil.rmtree(f"{root}/ledger/batch=2")
    assert uploads.ingest_uploads(spark, str(folder), root) == 2
    assert rows(spark.read.parquet(f"{root}/rows"), "batch", "experiment_id") == [(1, "e1"), (2, "e2")]


def test_template(spark, tmp_path):
    path = str(tmp_path / "template")
    uploads.write_template(spark, path)
    assert spark.read.option("header", True).csv(path).columns == schemas.UPLOAD.names


def test_experiment_json(spark, rows, tmp_path):
    (tmp_path / "in.json").write_text(
        '{"experiment_id": "e1", "user_id": 1, "experiment_type": "reaction", "params": {"ph": 7.5}}\n'
        '{"experiment_id": \n'
    )
    read = tables.read_experiment_json(spark, str(tmp_path / "in.json")).persist()
    assert rows(read.filter("_bad is null"), "experiment_id", "params") == [("e1", {"ph": 7.5})]
    assert read.filter("_bad is not null").count() == 1
    path = str(tmp_path / "experiments")
    sinks.append(read.filter("_bad is null").select(*schemas.EXPERIMENT.names), path)
    assert rows(tables.read_experiments(spark, path), "experiment_id", "user_id") == [("e1", 1)]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_export(spark, rows, tmp_path, kind):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    path = str(tmp_path / kind)
    sinks.export(df, path, kind)
    reader = spark.read.schema(df.schema)
    back = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    assert rows(back) == [(1, "a")]
    with pytest.raises(ValueError):
        sinks.export(df, path, "xlsx")


def test_corpus_and_literature(spark, rows, tmp_path):
    (tmp_path / "one.txt").write_text("line 1\nline 2")
    assert rows(tables.read_text_files(spark, str(tmp_path / "one.txt")), "text") == [("line 1\nline 2",)]
    path = str(tmp_path / "lit")
    mined = spark.createDataFrame(
        [(1, "solubility", "temperature", 25.0, "°C"), (2, "other", "pressure", 1.0, "atm")],
        schemas.LITERATURE,
    )
    sinks.write_literature(mined, path)
    assert rows(spark.read.parquet(path).filter("data_type = 'other'"), "doc_id") == [(2,)]
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, "t", "en")], "doc_id long, text string, lang string").write.parquet(docs)
    assert tables.read_corpus(spark, docs).columns == ["doc_id", "text"]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    from assaylake.operators.experiments import with_parameters

    frames = {
        "b_experiments": spark.createDataFrame([("e1", 1, "reaction", None)], schemas.EXPERIMENT),
        "b_parameters": spark.createDataFrame([("e1", "t", Decimal(1))], schemas.PARAMETER),
        "b_results": spark.createDataFrame([("e1", Decimal(1), True)], schemas.RESULT),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, frame in frames.items():
            sinks.save_bucketed(frame, name, "experiment_id", 4, str(tmp_path / name))
        joined = with_parameters(
            spark.table("b_experiments"), spark.table("b_parameters"), spark.table("b_results")
        )
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in frames:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_shared_folder_is_asked_for_on_a_cluster():
    from assaylake.session import shared_folder

    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(spark_master="yarn"))
    assert shared_folder(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(Session(spark_master="local[2]"))
