"""Counts told by the job that writes, rejects split off in one pass, hot items split in the catalogue join."""

from __future__ import annotations

import datetime as dt
import uuid
from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cartcast.operators.filter import filter_log, filter_log_split
from cartcast.operators.models import predict, random_forest
from cartcast.operators.skew import SkewConfig, hot_keys, key_weights, salted_join
from cartcast.operators.training import assemble, column_kinds, numeric_columns
from cartcast.sinks.writers import observed, write_log, write_log_counted, write_training
from cartcast.sources.log import log_rejects, parse_log, read_log_text, split_log
from cartcast.sources.tables import read_training
from conftest import LOG_DDL


def rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def jobs_of(spark, action):
    """Spark jobs that ``action`` runs, and its result."""
    sc = spark.sparkContext
    group = f"count-{uuid.uuid4()}"
    sc.setJobGroup(group, "jobs of one action")
    try:
        out = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(group)), out


def read_rows(spark, path, action):
    """Rows of the Parquet table at ``path`` that ``action`` reads, counted by the rows themselves."""
    seen = spark.sparkContext.accumulator(0)
    source = spark.read.parquet(path)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return action(source.mapInArrow(count, source.schema)), seen


def big_log(spark, n=3000):
    ts = dt.datetime(2014, 12, 1)
    data = [(f"u{k % 97}", "hot" if k % 3 == 0 else f"i{k % 40}", k % 4 + 1, ts + dt.timedelta(hours=k % 300)) for k in range(n)]
    return spark.createDataFrame(data + [("u1", None, 1, ts)], LOG_DDL)


def test_count_is_told_by_the_write(spark, tmp_path):
    """One job writes and counts, the log is read once, and the number is that of the rows on disk."""
    src = str(tmp_path / "log")
    big_log(spark).write.parquet(src)
    items = spark.createDataFrame([("hot",), ("i1",), ("i1",), (None,)], "item_id string")
    plain, _ = jobs_of(spark, lambda: write_log(filter_log(spark.read.parquet(src), items), str(tmp_path / "a")))
    with_count, n = jobs_of(spark, lambda: write_log_counted(filter_log(spark.read.parquet(src), items), str(tmp_path / "b")))
    assert with_count == plain
    assert n == spark.read.parquet(str(tmp_path / "b")).count() == spark.read.parquet(str(tmp_path / "a")).count() > 0
    n, seen = read_rows(spark, src, lambda log: write_log_counted(filter_log(log, items), str(tmp_path / "c")))
    assert seen.value == 3001 and n > 0


def test_count_of_nothing_and_of_text(spark, tmp_path):
    log = big_log(spark, 30)
    assert write_log_counted(log.limit(0), str(tmp_path / "none")) == 0
    assert write_log_counted(log, str(tmp_path / "csv"), "csv") == 31


def test_observed_metrics_count_written_rows_only(spark, tmp_path):
    """Rows cut off above the write are not counted."""
    seen = observed(
        spark.range(1000).where("id % 2 = 0").repartition(7),
        lambda df: df.write.parquet(str(tmp_path / "x")),
        n=F.count(F.lit(1)),
        most=F.max("id"),
    )
    assert seen == {"n": 500, "most": 998}


def test_a_forest_still_predicts_after_an_observed_write(spark, tmp_path):
    """An observed session cannot be serialised, and a fitted forest's closures carry theirs along."""
    data = spark.createDataFrame([(float(k % 2), Vectors.dense([k % 2, 1.0])) for k in range(40)], ["label", "features"])
    write_log_counted(big_log(spark, 30), str(tmp_path / "x"))
    model = random_forest(num_trees=2, max_depth=2).fit(data)
    assert predict(model, data).where("prediction = label").count() == 40


def test_observed_write_keeps_the_settings(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows_ = spark.range(100).repartition("id").select("id", F.spark_partition_id().alias("p"))
        assert observed(rows_, lambda df: df.write.parquet(str(tmp_path / "x")), top=F.max("p")) == {"top": 2}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert not spark.sql("SHOW VIEWS IN global_temp LIKE 'observed_*'").count()


TRAINING = "user_id string, item_id string, a double, b long, label int"


def test_training_table_written_and_read(spark, tmp_path):
    data = [("u1", "i1", 0.1, 2**53 + 1, 1), ("u1", "i2", None, None, 0), ("u,2", 'i"3', 1e-300, -1, None), ("ü", "漢", 1 / 3, 0, 1)]
    df = spark.createDataFrame(data, TRAINING)
    for fmt in ("csv", "parquet"):
        assert write_training(df, str(tmp_path / fmt), fmt) == {"rows": 4, "positives": 2}
        assert rows(read_training(spark, str(tmp_path / fmt), df.schema, fmt)) == rows(df)
    assert write_training(df.drop("label"), str(tmp_path / "no_label")) == {"rows": 4, "positives": 0}
    assert write_training(df, str(tmp_path / "csv")) == {"rows": 4, "positives": 2}  # overwritten, not appended
    assert read_training(spark, str(tmp_path / "csv"), df.schema).count() == 4


def test_training_table_of_another_shape_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("u", "i", 1.0, 2, 1)], TRAINING)
    write_training(df.select("user_id", "item_id", "b", "a", "label"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)header|schema"):
        read_training(spark, str(tmp_path / "t"), df.schema).collect()


LINES = [
    "user_id,item_id,behavior_type,user_geohash,item_category,time",
    "u1,i1,1,,c,2014-12-01 05",
    "u1,i1,9,,c,2014-12-01 05",
    "",
    ",i1,1,,,2014-12-01 05",
    "u1,,1,,,2014-12-01 05",
    "u1,i1,1",
    "u2,i2,4,g,c,2014-12-31 23,more",
]


def test_rejects_in_one_pass(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("\n".join(LINES) + "\n")
    raw = read_log_text(spark, str(tmp_path / "raw"))
    calendar = ("2014-11-18", "2014-12-18")
    for cal in (None, calendar):
        valid, rejects = split_log(raw, str(tmp_path / "split"), cal)
        assert rows(valid) == rows(parse_log(raw, cal))
        assert rows(rejects) == rows(log_rejects(raw, cal))
        assert valid.columns == parse_log(raw, cal).columns
    assert valid.count() == 1 and rejects.where("reject_reason = 'outside calendar'").count() == 1


def test_text_is_parsed_once_and_sides_are_read_alone(spark, tmp_path):
    raw_schema = read_log_text(spark, __file__).schema
    lines = [("u%d" % (k % 9), "i1", "1" if k % 2 else "x", None, None, "2014-12-01 05") for k in range(500)]
    spark.createDataFrame(lines, raw_schema).write.parquet(str(tmp_path / "raw"))
    (valid, rejects), seen = read_rows(spark, str(tmp_path / "raw"), lambda raw: split_log(raw, str(tmp_path / "out")))
    assert (valid.count(), rejects.count()) == (250, 250)
    assert seen.value == 500
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "kind=reject" not in plan


def test_no_rejects_and_no_rows(spark, tmp_path):
    raw_schema = read_log_text(spark, __file__).schema
    good = spark.createDataFrame([("u", "i", "1", None, None, "2014-12-01 05")], raw_schema)
    valid, rejects = split_log(good, str(tmp_path / "a"))
    assert (valid.count(), rejects.count()) == (1, 0)
    valid, rejects = split_log(good.limit(0), str(tmp_path / "b"))
    assert (valid.count(), rejects.count()) == (0, 0)


# -- hot items in the catalogue join -----------------------------------------


@pytest.fixture
def no_aqe(spark):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


CFG = SkewConfig(rows_per_split=100)


def catalogue(spark):
    return spark.createDataFrame([("hot",), ("hot",), ("i1",), ("i7",), ("unseen",), (None,)], "item_id string")


def test_split_filter_equals_plain_without_aqe(spark, no_aqe):
    log, items = big_log(spark), catalogue(spark)
    want = rows(filter_log(log, items))
    assert rows(filter_log_split(log, items, CFG)) == want
    kept = key_weights(log, ["item_id"], "n_rows").withColumn("other", F.lit(1))
    assert rows(filter_log_split(log, items, CFG, kept)) == want
    assert rows(filter_log_split(log.limit(0), items, CFG)) == Counter()
    assert rows(filter_log_split(log, items.limit(0), CFG)) == Counter()


def test_hot_item_is_spread_over_tasks(spark, no_aqe):
    """A third of the rows on one item: no task of the split join holds that many."""
    log, items = big_log(spark), catalogue(spark)

    def largest(df):
        per_task = df.where("item_id = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count()
        return per_task.agg(F.max("count")).first()[0]

    n = log.where("item_id = 'hot'").count()
    assert largest(filter_log(log, items).hint("merge")) == n
    assert largest(filter_log_split(log, items, CFG)) < 0.5 * n


def test_semi_join_keeps_repeated_rows_and_ignores_repeated_keys(spark):
    fine = spark.createDataFrame([("a", 1)] * 5 + [("b", 2), (None, 3)], "k string, v int")
    coarse = spark.createDataFrame([("a", 1.0)] * 3 + [(None, 2.0)], "k string, w double")
    hot = hot_keys(key_weights(fine, ["k"]), ["k"], "_weight", SkewConfig(rows_per_split=2))
    out = salted_join(fine, coarse, ["k"], hot, "left_semi")
    assert out.columns == ["k", "v"] and rows(out) == Counter({("a", 1): 5})
    with pytest.raises(ValueError):
        salted_join(fine, coarse, ["k"], hot, "left_anti")


# -- kinds of opaque columns ---------------------------------------------------


def test_column_kinds_and_assembly(spark):
    data = [("u", "i", "1.5", "x", None, "1e3", " 7 ", 3), ("u", "j", "-2", "4", None, None, "NaN", None)]
    df = spark.createDataFrame(data, "user_id string, item_id string, a string, b string, c string, d string, e string, n int")
    kinds = {r["column"]: (r["kind"], r.n_values, r.n_text) for r in column_kinds(df).collect()}
    assert kinds == {
        "a": ("number", 2, 0), "b": ("text", 2, 1), "c": ("empty", 0, 0), "d": ("number", 1, 0), "e": ("number", 2, 0), "n": ("number", 1, 0),
    }
    keep, left_out = numeric_columns(df)
    assert (keep, left_out) == (["a", "c", "d", "e", "n"], ["b"])
    vectors = {r.item_id: list(r.features) for r in assemble(df, keep).collect()}
    assert vectors["i"][0] == 1.5 and vectors["i"][2] == 1000.0 and vectors["i"][3] == 7.0
    assert column_kinds(df, []).collect() == []
    plan = column_kinds(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
