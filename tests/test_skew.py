"""Salted joins equal plain joins; the hot-key table stays within its bound."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import pytest

from cartcast.operators import skew
from cartcast.operators.skew import SkewConfig, hot_keys, key_weights, salted_join, skew_join


def rows(df):
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    # one user holds most rows; coarse side has a duplicate key (bag semantics)
    fine = [("hot", f"i{n}", n) for n in range(200)] + [(f"u{n}", "i0", n) for n in range(20)] + [(None, "i9", 1)]
    coarse = [("hot", 1.0), ("hot", 2.0)] + [(f"u{n}", float(n)) for n in range(0, 20, 2)]
    return (
        spark.createDataFrame(fine, "user_id string, item_id string, v int"),
        spark.createDataFrame(coarse, "user_id string, w double"),
    )


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_equals_plain(spark, skewed, how):
    fine, coarse = skewed
    plain = fine.join(coarse, "user_id", how)
    cfg = SkewConfig(rows_per_split=10)
    salted = skew_join(fine, coarse, ["user_id"], how, cfg, spread=["item_id"])
    assert rows(salted) == rows(plain)


def test_every_key_above_the_threshold_is_split(spark):
    weights = spark.createDataFrame([(f"u{n}", 10 * n) for n in range(1, 11)] + [("hot", 5000)], "user_id string, w long")
    hot = hot_keys(weights, ["user_id"], "w", SkewConfig(rows_per_split=15))
    got = {r["user_id"]: r["_n_split"] for r in hot.collect()}
    assert got == {"hot": 334} | {f"u{n}": -(-10 * n // 15) for n in range(2, 11)}


def test_hot_keys_are_bounded_by_their_share(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 4)
    weights = spark.createDataFrame([(f"u{n}", 100) for n in range(10)] + [("a", 900), ("b", 501)], "user_id string, w long")
    hot = hot_keys(weights, ["user_id"], "w", SkewConfig(rows_per_split=1))
    # total 2401: only keys above a quarter of it can be hot, so fewer than four
    assert {r["user_id"]: r["_n_split"] for r in hot.collect()} == {"a": 2}


def test_hot_key_rows_spread_over_salts(spark, skewed):
    fine, coarse = skewed
    hot = hot_keys(key_weights(fine, ["user_id"]), ["user_id"], "_weight", SkewConfig(rows_per_split=25))
    assert {r["user_id"]: r["_n_split"] for r in hot.collect()} == {"hot": 8}
    joined = salted_join(fine, coarse, ["user_id"], hot, "inner", spread=["item_id"])
    assert joined.where("user_id = 'hot'").count() == 400


def test_plan_broadcasts_only_hot_table(spark, skewed):
    fine, coarse = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(fine, coarse, ["user_id"], "inner", SkewConfig(rows_per_split=10))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan  # the big join stays a shuffle join
    assert "BroadcastHashJoin" in plan  # the hot keys, fewer than MAX_HOT_KEYS


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

keys = st.sampled_from(["a", "b", "c", "d", None])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    fine=st.lists(st.tuples(keys, st.integers(0, 30)), min_size=0, max_size=60),
    coarse=st.lists(st.tuples(keys, st.integers(0, 5)), min_size=0, max_size=8),
    rows_per_split=st.integers(1, 10),
    how=st.sampled_from(["inner", "left"]),
)
def test_salted_join_property(spark, fine, coarse, rows_per_split, how):
    f = spark.createDataFrame(fine, "k string, v int")
    c = spark.createDataFrame(coarse, "k string, w int")
    cfg = SkewConfig(rows_per_split=rows_per_split)
    assert rows(skew_join(f, c, ["k"], how, cfg, spread=["v"])) == rows(f.join(c, "k", how))


def test_salting_balances_a_key_with_a_third_of_the_rows(spark):
    """One user holds a third of the fine rows. A plain shuffle join puts them
    all in one partition; the salted join spreads them."""
    conf = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ids = F.col("id")
        fine = spark.range(30000).select(
            F.when(ids < 10000, F.lit("hot")).otherwise(F.concat(F.lit("u"), (ids % 2000).cast("string"))).alias("user_id"),
            ids.alias("item_id"),
        )
        coarse = fine.select("user_id").distinct().withColumn("w", F.lit(1.0))

        def biggest(df):
            sizes = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            return max(r["count"] for r in sizes)

        plain = fine.join(coarse, "user_id")
        salted = skew_join(fine, coarse, ["user_id"], "inner", SkewConfig(rows_per_split=1000), spread=["item_id"])
        assert plain.count() == salted.count() == 30000
        assert biggest(plain) >= 10000
        assert biggest(salted) * 2 < biggest(plain)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
