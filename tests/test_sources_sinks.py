"""Sources S1-S7 and sinks K1-K4 round trips, rejects (D5), log by day."""

from __future__ import annotations

import datetime as dt
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartcast.operators.extensions import log_by_day
from cartcast.operators.features import ui_features
from cartcast.operators.training import assemble, feature_columns, write_libsvm
from cartcast.schema import UI_COLUMNS
from cartcast.sinks.writers import write_log, write_table
from cartcast.sources.log import log_rejects, parse_log, read_log, read_log_text
from cartcast.sources.tables import read_catalogue, read_keyed_features, read_libsvm, read_ui_features
from conftest import ORIGIN

RAW = """user_id,item_id,behavior_type,user_geohash,item_category,time
u1,i1,1,96ts,cat1,2014-12-15 23
u1,i1,4,,cat1,2014-12-15 23

u2,i2,4,geo,cat2,2014-12-01 05
u2,i2,4,geo,cat2,2014-12-01 05
u3,i3,1,geo,cat3
u4,i4,9,geo,cat4,2014-12-02 01
u5,i5,,geo,cat5,2014-12-02 01
u6,i6,2,geo,cat6,2014-10-01 00
,i7,1,geo,cat7,2014-12-02 01
u8,i8,3,geo,cat8,not a time
"""


@pytest.fixture()
def workdir():
    return Path(tempfile.mkdtemp(prefix="cartcast-test-"))


@pytest.fixture()
def raw_csv(workdir):
    path = workdir / "raw.csv"
    path.write_text(RAW)
    return str(path)


def test_read_log_and_rejects(spark, raw_csv):
    text = read_log_text(spark, raw_csv)
    good = parse_log(text)
    rows = sorted((r.user_id, r.item_id, r.behavior_type, r.ts, r.user_geohash) for r in good.collect())
    assert rows == [
        ("u1", "i1", 1, dt.datetime(2014, 12, 15, 23), "96ts"),
        ("u1", "i1", 4, dt.datetime(2014, 12, 15, 23), None),  # empty field -> NULL, still valid
        ("u2", "i2", 4, dt.datetime(2014, 12, 1, 5), "geo"),
        ("u2", "i2", 4, dt.datetime(2014, 12, 1, 5), "geo"),  # duplicates count twice
        ("u6", "i6", 2, dt.datetime(2014, 10, 1, 0), "geo"),  # outside the old calendar, valid here
    ]
    bad = log_rejects(text).where("reject_reason != 'blank line'")
    reasons = {r.user_id: r.reject_reason for r in bad.collect()}
    assert reasons == {
        "u3": "bad time",
        "u4": "bad behavior_type",
        "u5": "bad behavior_type",
        None: "missing user_id",
        "u8": "bad time",
    }
    assert log_rejects(text).where("reject_reason = 'blank line'").count() == 1


def test_filtered_log_csv_round_trip(spark, raw_csv, workdir):
    log = read_log(spark, raw_csv)
    out = str(workdir / "filtered")
    write_log(log, out, fmt="csv")
    write_log(log, out, fmt="csv")  # overwrite, not append
    back = read_log(spark, out)  # no header in the filtered file
    cols = ["user_id", "item_id", "behavior_type", "ts"]
    assert sorted(back.select(cols).collect()) == sorted(log.select(cols).collect())


def test_catalogue_and_feature_tables(spark, golden_log, workdir):
    cat = workdir / "items.csv"
    cat.write_text("item_id,item_geohash,item_category\ni1,g,c\ni1,g,c\ni3,,c\n")
    assert sorted(r.item_id for r in read_catalogue(spark, str(cat)).collect()) == ["i1", "i1", "i3"]

    feats = ui_features(golden_log, "2014-12-16", ORIGIN)
    path = str(workdir / "ui")
    write_table(feats, path, fmt="csv", header=True)
    back = read_ui_features(spark, path)
    assert back.columns == UI_COLUMNS
    assert sorted(back.collect()) == sorted(feats.collect())

    users = workdir / "users"
    users.mkdir()
    (users / "part.csv").write_text("user_id,score,segment\nu1,9007199254740993,gold\nu2,1.5,\n")
    uf = read_keyed_features(spark, str(users), "user_id")
    assert uf.columns == ["user_id", "score", "segment"]
    assert sorted(tuple(r) for r in uf.collect()) == [("u1", "9007199254740993", "gold"), ("u2", "1.5", None)]
    numbers = assemble(uf, ["score"], keep=("user_id",))
    assert sorted(r.features[0] for r in numbers.collect()) == [1.5, 9007199254740992.0]
    with pytest.raises(Exception, match="not a number: gold"):
        assemble(uf, ["score", "segment"], keep=("user_id",)).collect()
    with pytest.raises(ValueError):
        read_keyed_features(spark, str(users), "item_id")


def test_libsvm_round_trip(spark, golden_log, workdir):
    feats = ui_features(golden_log, "2014-12-16", ORIGIN).withColumn("label", F.lit(1))
    cols = feature_columns(feats)
    assert len(cols) == 47
    path = str(workdir / "svm")
    width = write_libsvm(feats, cols, path)
    back = read_libsvm(spark, path, width)
    assembled = assemble(feats, cols, keep=())
    got = sorted((r.label, tuple(r.features.toArray())) for r in back.collect())
    want = sorted((r.label, tuple(r.features.toArray())) for r in assembled.collect())
    assert got == want


def test_unlabelled_and_partly_labelled_libsvm(spark, workdir):
    rows = spark.createDataFrame([("u", "i", 0.0, 2.0, 1), ("u", "j", 3.0, 0.0, None)], "user_id string, item_id string, a double, b double, label int")
    path = str(workdir / "svm")
    assert write_libsvm(rows.drop("label"), ["a", "b"], path) == 2
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["0.0 1:0.0 2:2.0", "0.0 1:3.0 2:0.0"]
    write_libsvm(rows, ["a", "b"], path)  # an unknown label is not a negative
    assert [r.value for r in spark.read.text(path).collect()] == ["1.0 1:0.0 2:2.0"]


def test_log_by_day_files_follow_size(spark, workdir):
    log = spark.range(4000).selectExpr("id user_id", "id % 7 item_id", "1 behavior_type", "timestamp_ntz'2014-12-01 00:00:00' + make_interval(0, 0, 0, cast(id % 20 as int)) ts")
    path = workdir / "many"
    log_by_day(spark, log.repartition(40), str(path))
    files = [p for p in path.rglob("*.parquet")]
    assert len(files) <= 40  # 20 days; one file per task and day would be 800


def test_log_by_day(spark, golden_log, workdir):
    path = str(workdir / "by_day")
    back = log_by_day(spark, golden_log, path)
    days = sorted(p.name for p in Path(path).iterdir() if p.name.startswith("day="))
    assert days[0] == "day=2014-11-18" and len(days) == 6
    one = back.where(F.col("day") == F.lit(dt.date(2014, 12, 16)))
    assert one.count() == 4
    assert "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_log_time_ignores_session_time_zone(spark):
    from cartcast.functions.time import parse_log_time

    texts = ["2014-03-09 02", "2014-12-15 23", "2014-12-5 3", "2014-02-30 10", "2014-12-15 24", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "time string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(parse_log_time("time")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [
        dt.datetime(2014, 3, 9, 2),  # a skipped hour in New York, kept as written
        dt.datetime(2014, 12, 15, 23),
        dt.datetime(2014, 12, 5, 3),
        None,
        None,
        None,
        None,
    ]


def test_day_partitioned_log_prunes_folders(spark, golden_log, workdir):
    from cartcast.operators.features import horizon, ui_features
    from cartcast.operators.labels import day_buys

    back = log_by_day(spark, golden_log, str(workdir / "by_day_prune"))
    buys = day_buys(back, "2014-12-16")
    plan = buys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert sorted(tuple(r) for r in buys.collect()) == [("u1", "i2"), ("u2", "i1")]
    h = horizon(back, "2014-12-16", ORIGIN)
    assert "PartitionFilters: [isnotnull(day" in h._jdf.queryExecution().executedPlan().toString()
    cols = sorted(ui_features(golden_log, "2014-12-16", ORIGIN).columns)
    assert sorted(ui_features(back, "2014-12-16", ORIGIN).select(cols).collect()) == sorted(
        ui_features(golden_log, "2014-12-16", ORIGIN).select(cols).collect()
    )


def test_calendar_bound_rejects_other_days(spark, raw_csv):
    text = read_log_text(spark, raw_csv)
    calendar = ("2014-11-18", "2014-12-18")
    kept = {r.user_id for r in parse_log(text, calendar).collect()}
    assert kept == {"u1", "u2"}  # u6's row of 2014-10-01 is outside the calendar
    reasons = {r.user_id: r.reject_reason for r in log_rejects(text, calendar).collect()}
    assert reasons["u6"] == "outside calendar" and reasons["u4"] == "bad behavior_type"
