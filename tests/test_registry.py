"""Driver contract, oracle agreement on sf0.001, and plan properties."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from cartcast.plans.oracle import ORACLE_SQL
from cartcast.plans.registry import ORIGIN, QUERIES, SPLIT
from cartcast.operators import features
from cartcast.schema import UI_COLUMNS
from cartcast.session import intermediates
from cartcast.sources.events import events_log

SF = "/root/testdata/sf0.001"
TABLES = "events part".split()
FAST = [
    "filter_log", "filter_count", "log_projection", "log_rejects", "before_split", "ui_counts",
    "ui_recency", "user_day_activity", "ui_day_activity", "user_totals", "ui_features",
    "ui_features_truncated", "ui_features_720_cutoff", "labels", "positive_count",
    "user_features", "item_features", "feature_join_labelled", "eval_metrics", "training_multi_split",
    "ui_counts_windows", "ui_features_salted", "feature_join_salted", "training_multi_split_partial_labels",
    "log_csv_roundtrip", "log_csv_rejects", "catalogue_csv", "filter_log_csv", "ui_features_csv", "feature_join_csv",
    "feature_join_text_columns", "libsvm_roundtrip_array", "libsvm_unlabelled", "rf_rule_holdout", "submission_rule",
    "filter_log_split", "filter_count_observed", "training_table_csv", "training_counts_observed", "log_split_one_pass",
    "feature_column_kinds", "pair_day_store", "pair_day_store_hot", "multi_split_features", "rf_rare_rule_holdout",
]


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == UI_COLUMNS
    assert df.count() > 0


def test_every_sql_query_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) - set(ORACLE_SQL) == {"gbt_holdout", "rf_holdout", "submission", "submission_rare"}


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def n(v):
        return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    return Counter(tuple(n(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees_sf0001(spark, duck, name):
    with intermediates(spark):
        df = E.queries()[name](spark, SF)
        rel = duck.sql(E.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert _norm([tuple(r) for r in df.collect()], df.columns) == _norm(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name, most", [("ui_features", 2), ("feature_join_labelled", 6)])
def test_exchanges(spark, name, most):
    """Shuffles as planned for large inputs (nothing broadcast by size)."""
    import re

    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in off:
            spark.conf.unset(k)
    main = plan.split("Subqueries")[0]
    assert len(re.findall(r"Exchange hashpartitioning", main)) <= most, main


def test_scan_pushdown_and_pruning(spark):
    h = features.horizon(events_log(spark, SF), SPLIT, ORIGIN)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts," in plan  # the split cut reaches the Parquet reader
    assert "In(event_type," in plan
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]  # unused column not read


def test_features_scan_the_log_once(spark):
    df = QUERIES["ui_features"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan  # everything reads the written pair-day table


@pytest.mark.parametrize("name", ["ui_features", "feature_join_labelled", "multi_split_features"])
def test_only_bounded_tables_are_broadcast(spark, name):
    """Planned as for large inputs, every broadcast is a table of hot keys
    and no Python runs in the plan."""
    import re

    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in off:
            spark.conf.unset(k)
    broadcasts = len(re.findall("BroadcastExchange", plan))
    assert broadcasts > 0 and broadcasts <= len(re.findall("> greatest|greatest\\(", plan))  # hot keys only
    assert "SortMergeJoin" in plan
    assert not re.search("EvalPython|InPandas", plan)


def test_feature_plan_is_whole_stage_codegen(spark):
    """Apart from scans and exchanges, every operator runs in generated code."""
    import re

    df = QUERIES["ui_features"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    ops = re.findall(r"[:+]- (\*\(\d+\) )?([A-Za-z]+)", final)
    outside = {op for star, op in ops if not star}
    allowed = {"AQEShuffleRead", "Exchange", "FileScan", "ShuffleQueryStage", "BroadcastQueryStage",
               "BroadcastExchange", "ResultQueryStage", "TableCacheQueryStage", "ReusedExchange"}
    assert outside <= allowed, outside - allowed
