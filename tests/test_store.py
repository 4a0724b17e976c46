"""Pair-days kept by day: equal to one run over the log, however they were added; no shuffle to read them."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartcast.functions.time import split_hour
from cartcast.operators.features import ui_features, ui_features_from_pair_days
from cartcast.operators.store import PairDayStore
from cartcast.sinks.writers import write_log_by_day
from conftest import LOG_DDL

FIRST = dt.date(2014, 11, 18)
SPLIT = dt.date(2014, 11, 28)


def rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


def make_log(spark, n=900, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        user = "hot" if rng.random() < 0.4 else f"u{rng.randint(0, 25)}"
        day = FIRST + dt.timedelta(days=rng.choice([0, 1, 2, 3, 5, 8, 9, 10, 11]))  # days 4, 6 and 7 have no rows
        ts = dt.datetime.combine(day, dt.time(rng.randint(0, 23)))
        out.append((user, f"i{rng.randint(0, 60)}", rng.choice([1, 1, 1, 2, 3, 4]), ts))
    return spark.createDataFrame(out, LOG_DDL)


def days(a, b):
    return [FIRST + dt.timedelta(days=k) for k in range(a, b)]


@pytest.mark.parametrize("hot_least", [100_000, 3])
def test_days_added_in_parts_equal_one_run(spark, hot_least):
    log = make_log(spark)
    store = PairDayStore(spark, origin=FIRST, buckets=3, hot_least=hot_least)
    for part in (days(11, 12), days(10, 11), days(0, 9), days(9, 10), days(3, 6)):  # in any order, some twice
        store.add_days(log, part)
    assert (store.table("hot_days").count() > 0) == (hot_least == 3)
    assert rows(store.features(SPLIT)) == rows(ui_features(log, SPLIT, FIRST))
    assert rows(store.features(FIRST + dt.timedelta(days=4))) == rows(ui_features(log, FIRST + dt.timedelta(days=4), FIRST))
    assert rows(store.features(SPLIT, "truncated")) == rows(ui_features(log, SPLIT, FIRST, "truncated"))


def test_a_day_is_replaced_and_no_other(spark):
    log = make_log(spark)
    store = PairDayStore(spark, origin=FIRST, buckets=2, hot_least=3)
    assert store.add_days(log, days(0, 12))[FIRST + dt.timedelta(days=4)] == 0
    held = store.days()
    assert held == [FIRST + dt.timedelta(days=k) for k in (0, 1, 2, 3, 5, 8, 9, 10, 11)]
    # The log of day 2 is corrected: its rows of the hot user are gone; day 3 turns out empty.
    day = F.to_date("ts")
    corrected = log.where((day != F.lit(held[2])) | (F.col("user_id") != "hot")).where(day != F.lit(held[3]))
    counts = store.add_days(corrected, [held[2], held[3]])
    assert counts[held[3]] == 0
    want = corrected.where(day == F.lit(held[2])).select("user_id", "item_id").distinct().count()
    assert counts[held[2]] == want
    assert store.days() == [d for d in held if d != held[3]]
    assert rows(store.features(SPLIT)) == rows(ui_features(corrected, SPLIT, FIRST))


def test_opened_again_at_the_same_path(spark):
    log = make_log(spark, 200)
    store = PairDayStore(spark, origin=FIRST, buckets=2, hot_least=3)
    store.add_days(log, days(0, 9))
    store.drop()  # as for another session: nothing is registered
    again = PairDayStore(spark, store.path, origin=FIRST, buckets=2, hot_least=3)
    again.add_days(log, days(9, 12))
    assert rows(again.features(SPLIT)) == rows(ui_features(log, SPLIT, FIRST))


def test_log_stored_by_day_is_read_by_folder(spark, tmp_path):
    log = make_log(spark, 300)
    write_log_by_day(log, str(tmp_path / "log"))
    by_day = spark.read.parquet(str(tmp_path / "log"))
    store = PairDayStore(spark, origin=FIRST, buckets=2)
    store.add_days(by_day, days(0, 12))
    assert rows(store.features(SPLIT)) == rows(ui_features(log, SPLIT, FIRST))


def test_empty_log_and_no_days(spark):
    store = PairDayStore(spark, origin=FIRST, buckets=2)
    assert store.add_days(make_log(spark, 5), []) == {}
    assert store.add_days(make_log(spark, 5).limit(0), days(0, 2)) == {d: 0 for d in days(0, 2)}
    assert store.features(SPLIT).count() == 0
    with pytest.raises(ValueError):
        PairDayStore(spark)


def test_pair_days_are_not_shuffled(spark):
    """Totals, join and aggregate of the bucketed rows: the only exchanges are of the stored-apart ids."""
    store = PairDayStore(spark, origin=FIRST, buckets=4, hot_least=3)
    store.add_days(make_log(spark), days(0, 12))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        cold, _ = store.pair_days(SPLIT)
        out = ui_features_from_pair_days(cold, split_hour(SPLIT, FIRST), materialize=False, co_located=True)
        plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum("SortMergeJoin" in x for x in plan) == 1
    shuffles = [k for k, x in enumerate(plan) if "Exchange" in x and "Broadcast" not in x and "Reused" not in x]
    for k in shuffles:  # each lies under the broadcast of the distinct ids and reads nothing but the user
        assert "HashAggregate(keys=[user_id" in plan[k - 1] and "functions=[]" in plan[k - 1]
    assert any("Bucketed: true" in x or "SelectedBucketsCount: 4 out of 4" in x for x in plan)


@pytest.mark.parametrize("n_days", [31, 1000])
def test_day_totals_over_long_logs(spark, n_days):
    """A user active on a few days of a long log: the day array has zeros between, the sums are right."""
    start = dt.datetime(2020, 1, 1)
    data = [("u", f"i{k % 3}", 1, start + dt.timedelta(days=k, hours=1)) for k in range(0, n_days, 7) for _ in range(k % 4 + 1)]
    log = spark.createDataFrame(data, LOG_DDL)
    got = {r.item_id: r for r in ui_features(log, dt.date(2023, 1, 1), dt.date(2020, 1, 1)).collect()}
    for item in ("i0", "i1", "i2"):
        mine = [(t, i) for _, i, _, t in data]
        on = {t.date() for t, i in mine if i == item}
        same_day = sum(t.date() in on for t, _ in mine)
        assert got[item].same_day_share == sum(i == item for _, i in mine) / same_day
