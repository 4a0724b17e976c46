"""Registered queries over the driver's tables: one per operator of the survey.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; nothing is
collected. The interaction log is the whole ``events`` table mapped by
``cartcast.sources.events``; the item catalogue is ``part`` of one type.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.functions.time import as_date, hour_index, split_hour
from cartcast.operators import extensions, features, labels, models, profiles, training
from cartcast.operators.filter import distinct_items, filter_log, filter_log_split, row_count
from cartcast.operators.skew import SkewConfig
from cartcast.operators.store import PairDayStore
from cartcast.schema import BEHAVIOURS, count_col
from cartcast.session import cut_lineage, shared_path
from cartcast.sinks.writers import write_log, write_log_counted, write_table, write_training
from cartcast.sources.events import event_rejects, events_log, item_key, part_catalogue, table
from cartcast.sources.log import log_rejects, parse_log, read_log, read_log_text, split_log
from cartcast.sources.tables import (
    read_catalogue,
    read_keyed_features,
    read_libsvm,
    read_training,
    read_ui_features,
)
from cartcast.streaming.filter import stream_filter_log

# Parameters of the registered queries (events run 2024-01-01 .. 01-30).
ORIGIN = "2024-01-01"
SPLIT = "2024-01-30"  # labelled: features before 01-30, buys on 01-30
CUTOFF_SPLIT = "2024-02-01"  # unlabelled; the first day falls outside 720 h
TRAIN_SPLIT = "2024-01-29"  # hold-out: train on 01-29, test on 01-30
MULTI_SPLITS = ("2024-01-28", "2024-01-29", "2024-01-30")
HOLDOUT_SPLITS = (TRAIN_SPLIT, SPLIT)
NEXT_SPLIT = "2024-01-31"  # the day after the log: what the submission scores
WINDOWS = (5, 24, 36, 100)  # hours; 36 and 100 end inside a day
SALTED = SkewConfig(rows_per_split=20)  # small enough that most keys are split
GBT_PARAMS = dict(max_iter=10, max_depth=4, step_size=0.1, subsampling_rate=1.0, seed=7)
RF_PARAMS = dict(num_trees=10, max_depth=5)
# For the rule queries: one tree of a forest sees every feature, so both
# learners can fit a rule on one feature exactly.
GBT_RULE = dict(max_iter=2, max_depth=2, step_size=0.1, subsampling_rate=1.0, seed=7)
RF_RULE = dict(num_trees=1, max_depth=3)

Query = Callable[[SparkSession, str], DataFrame]


def _log(spark, sf):
    return events_log(spark, sf)


def _filtered(spark, sf):
    return filter_log(_log(spark, sf), part_catalogue(spark, sf))


def _ui(spark, sf, split=SPLIT, mode="exact"):
    return features.ui_features(_log(spark, sf), split, ORIGIN, ratio_mode=mode)


def _training(spark, sf, split, labelled=True, skew=SkewConfig()):
    log = _log(spark, sf)
    # One pass over the log: the pair-day table feeds the user-item features
    # and both profiles.
    daily = cut_lineage(features.pair_days(log, split, ORIGIN), "pair_days")
    buys = labels.day_buys(log, split) if labelled else None
    return extensions.training_from_pair_days(daily, split_hour(split, ORIGIN), buys, skew)


def q_filter_log(spark, sf):
    return _filtered(spark, sf).select("user_id", "item_id", "behavior_type", "ts")


def q_filter_count(spark, sf):
    return row_count(_filtered(spark, sf))


def q_filter_log_split(spark, sf):
    """C1 with hot items split, whatever the size of the catalogue."""
    out = filter_log_split(_log(spark, sf), part_catalogue(spark, sf), SALTED)
    return out.select("user_id", "item_id", "behavior_type", "ts")


def q_filter_count_observed(spark, sf):
    """The number of rows that the job writing the filtered log reports."""
    n = write_log_counted(_filtered(spark, sf), shared_path(spark, "filtered_log"))
    return spark.createDataFrame([(n,)], "n_rows long")


def q_log_projection(spark, sf):
    return _log(spark, sf).select(
        "user_id",
        "item_id",
        "behavior_type",
        hour_index("ts", ORIGIN).alias("hour_idx"),
        F.to_date("ts").alias("day"),
    )


def q_log_rejects(spark, sf):
    return event_rejects(table(spark, sf, "events")).select("event_id", "reject_reason")


def q_before_split(spark, sf):
    return features.horizon(_log(spark, sf), SPLIT, ORIGIN)


def q_ui_counts(spark, sf):
    return features.window_counts(_log(spark, sf), SPLIT, ORIGIN)


def q_ui_counts_windows(spark, sf):
    """Count features over other windows, through the whole C2 plan."""
    ui = features.ui_features(_log(spark, sf), SPLIT, ORIGIN, windows=WINDOWS)
    return ui.select("user_id", "item_id", *[count_col(b, w) for w in WINDOWS for b in BEHAVIOURS])


def q_ui_recency(spark, sf):
    return features.recency(_log(spark, sf), SPLIT, ORIGIN)


def q_user_day_activity(spark, sf):
    return features.user_day_activity(_log(spark, sf), SPLIT, ORIGIN)


def q_ui_day_activity(spark, sf):
    return features.item_day_activity(_log(spark, sf), SPLIT, ORIGIN)


def q_user_totals(spark, sf):
    return features.user_totals(_log(spark, sf), SPLIT, ORIGIN)


def q_ui_features(spark, sf):
    return _ui(spark, sf)


def q_ui_features_truncated(spark, sf):
    return _ui(spark, sf, mode="truncated")


def q_ui_features_salted(spark, sf):
    return features.ui_features(_log(spark, sf), SPLIT, ORIGIN, skew=SALTED)


def q_ui_features_720_cutoff(spark, sf):
    return _ui(spark, sf, split=CUTOFF_SPLIT)


def q_ui_features_catalogue(spark, sf):
    return features.ui_features(_filtered(spark, sf), SPLIT, ORIGIN)


def q_labels(spark, sf):
    return labels.day_buys(_log(spark, sf), SPLIT)


def q_positive_count(spark, sf):
    return labels.positive_count(labels.labelled_pairs(_log(spark, sf), SPLIT))


def q_user_features(spark, sf):
    return profiles.user_profile(_log(spark, sf), SPLIT, ORIGIN)


def q_item_features(spark, sf):
    return profiles.item_profile(_log(spark, sf), SPLIT, ORIGIN)


def q_feature_join_labelled(spark, sf):
    return _training(spark, sf, SPLIT, labelled=True)


def q_feature_join_unlabelled(spark, sf):
    return _training(spark, sf, CUTOFF_SPLIT, labelled=False)


def q_feature_join_salted(spark, sf):
    return _training(spark, sf, SPLIT, skew=SALTED)


def _stored(spark, sf, hot_least):
    """A store filled to the day before the split, the last days one by one and one of them twice."""
    log, store = _log(spark, sf), PairDayStore(spark, origin=ORIGIN, hot_least=hot_least)
    first, last = as_date(ORIGIN), as_date(TRAIN_SPLIT)
    days = [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]
    store.add_days(log, days[:-2])
    for day in (days[-2], days[-1], days[-2]):
        store.add_days(log, [day])
    return store


def q_pair_day_store(spark, sf):
    """C2 from pair-days kept by day and bucketed by user."""
    return _stored(spark, sf, 100_000).features(SPLIT)


def q_pair_day_store_hot(spark, sf):
    """The same where users with more than two items on a day are stored apart."""
    return _stored(spark, sf, 2).features(SPLIT)


def q_multi_split_features(spark, sf):
    return extensions.multi_split_features(_log(spark, sf), MULTI_SPLITS, ORIGIN)


def q_training_multi_split(spark, sf):
    """The hold-out's input: training rows of both days from one pass."""
    return extensions.multi_split_training(_log(spark, sf), HOLDOUT_SPLITS, ORIGIN, HOLDOUT_SPLITS)


def q_training_multi_split_partial_labels(spark, sf):
    """Only the first day is labelled; rows of the other have a NULL label."""
    return extensions.multi_split_training(_log(spark, sf), (SPLIT, CUTOFF_SPLIT), ORIGIN, (SPLIT,))


def q_log_by_day(spark, sf):
    path = shared_path(spark, "log_by_day")
    return extensions.log_by_day(spark, _log(spark, sf), path).select(
        "user_id", "item_id", "behavior_type", "ts", "day"
    )


def q_eval_metrics(spark, sf):
    log = _log(spark, sf)
    ui = features.ui_features(log, SPLIT, ORIGIN)
    scored = labels.attach_label(ui, labels.day_buys(log, SPLIT)).select(
        (F.col("buy_720h") > 0).cast("double").alias("prediction"), F.col("label").cast("double")
    )
    return models.confusion(scored)


def q_libsvm_roundtrip(spark, sf):
    table_ = _training(spark, sf, SPLIT)
    cols = training.feature_columns(table_)
    path = shared_path(spark, "libsvm")
    width = training.write_libsvm(table_, cols, path)
    back = read_libsvm(spark, path, width)
    arr = vector_to_array(F.col("features"))
    return back.select(
        "label",
        F.size(arr).alias("width"),
        F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x).alias("feature_sum"),
    )


def _positions(path, width, spark):
    """A libsvm file read back, with a column for each position of the vector."""
    back = read_libsvm(spark, path, width)
    arr = vector_to_array(F.col("features"))
    return back.select("label", *[F.get(arr, F.lit(k)).alias(f"f{k:02d}") for k in range(width)])


def q_libsvm_roundtrip_array(spark, sf):
    table_, path = _training(spark, sf, SPLIT), shared_path(spark, "libsvm")
    return _positions(path, training.write_libsvm(table_, training.feature_columns(table_), path), spark)


def q_libsvm_unlabelled(spark, sf):
    """The day to predict: no label column, written with label 0."""
    table_, path = _training(spark, sf, CUTOFF_SPLIT, labelled=False), shared_path(spark, "libsvm")
    return _positions(path, training.write_libsvm(table_, training.feature_columns(table_), path), spark)


# The text path: the log, the catalogue and feature tables as CSV files, read back.


def _raw_lines(spark, sf):
    """``events`` as lines of the raw log, header included. Valid events become
    valid lines; error events become bad ones, of a kind the event id picks."""
    e = table(spark, sf, "events").where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    e = e.select("event_id", "user_id", "event_type", "ts", item_key().alias("item_id")).where("item_id IS NOT NULL")
    code = F.when(F.col("event_type") == "error", F.lit("x"))
    for name, value in (("view", "1"), ("click", "2"), ("signup", "3"), ("purchase", "4")):
        code = code.when(F.col("event_type") == name, F.lit(value))
    user, item = F.col("user_id").cast("string"), F.col("item_id").cast("string")
    time = F.date_format("ts", "yyyy-MM-dd HH")

    def line(*fields):
        return F.concat_ws(",", *fields)

    none, geo = F.lit(""), F.lit("9q8")
    kind = F.col("event_id") % 5
    bad = (
        F.when(kind == 0, line(user, item, F.lit("x"), geo, none, time))
        .when(kind == 1, none)
        .when(kind == 2, line(none, item, F.lit("1"), geo, none, time))
        .when(kind == 3, line(user, none, F.lit("1"), none, none, time))
        .otherwise(line(user, item, F.lit("1")))
    )
    body = e.where(code.isNotNull()).select(
        F.when(F.col("event_type") == "error", bad).otherwise(line(user, item, code, none, geo, time)).alias("value")
    )
    header = spark.createDataFrame([("user_id,item_id,behavior_type,user_geohash,item_category,time",)], "value string")
    return header.union(body)


def _raw_log(spark, sf):
    path = shared_path(spark, "raw_log")
    _raw_lines(spark, sf).write.text(path)
    return path


LOG_OUT = ("user_id", "item_id", "behavior_type", "ts")


def q_log_csv_roundtrip(spark, sf):
    """Raw log with header read, written without (K1) and read again."""
    path = shared_path(spark, "log_csv")
    write_log(read_log(spark, _raw_log(spark, sf)), path, "csv")
    return read_log(spark, path).select(*LOG_OUT)


def q_log_csv_rejects(spark, sf):
    return log_rejects(read_log_text(spark, _raw_log(spark, sf))).select("user_id", "item_id", "reject_reason")


def _catalogue_csv(spark, sf):
    path = shared_path(spark, "catalogue_csv")
    items = part_catalogue(spark, sf).select(
        F.col("item_id").cast("string").alias("item_id"), F.lit("9q8").alias("item_geohash"), "item_category"
    )
    items.write.option("header", True).csv(path)
    return path


def q_catalogue_csv(spark, sf):
    return distinct_items(read_catalogue(spark, _catalogue_csv(spark, sf)))


def q_filter_log_csv(spark, sf):
    """C1 from text to text: raw log and catalogue CSV, filtered log CSV read back."""
    path = shared_path(spark, "filtered_csv")
    log = parse_log(read_log_text(spark, _raw_log(spark, sf)))
    write_log(filter_log(log, read_catalogue(spark, _catalogue_csv(spark, sf))), path, "csv")
    return read_log(spark, path).select(*LOG_OUT)


def _csv(spark, df, name):
    path = shared_path(spark, name)
    write_table(df, path, "csv", header=True)
    return path


def _ids(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("user_id", "item_id")})


def q_ui_features_csv(spark, sf):
    return _ids(read_ui_features(spark, _csv(spark, _ui(spark, sf), "ui_csv")))


def q_feature_join_csv(spark, sf):
    """C4 from the three feature files; their opaque text is cast here, for the comparison."""
    log = _log(spark, sf)
    daily = cut_lineage(features.pair_days(log, SPLIT, ORIGIN), "pair_days")
    sh = split_hour(SPLIT, ORIGIN)
    ui = read_ui_features(spark, _csv(spark, features.ui_features_from_pair_days(daily, sh), "ui_csv"))
    sides = {}
    for key, other in (("user_id", "item_id"), ("item_id", "user_id")):
        profile = profiles.profile_from_pair_days(daily, key, other, sh)
        sides[key] = (read_keyed_features(spark, _csv(spark, profile, f"{key}_csv"), key), dict(profile.dtypes))
    buys = labels.day_buys(log, SPLIT).select(*[F.col(c).cast("string").alias(c) for c in ("user_id", "item_id")])
    out = training.training_table(ui, sides["user_id"][0], sides["item_id"][0], buys)
    typed = {f"{p}{c}": t for p, key in (("u_", "user_id"), ("i_", "item_id")) for c, t in sides[key][1].items()}
    return _ids(out).withColumns({c: F.col(c).cast(t) for c, t in typed.items() if c in out.columns})


def q_training_table_csv(spark, sf):
    """C4 written as a training table (K3) and read back."""
    table_, path = _training(spark, sf, SPLIT), shared_path(spark, "training_csv")
    write_training(table_, path)
    return read_training(spark, path, table_.schema)


def q_training_counts_observed(spark, sf):
    """Rows and positives of the training table, as the job that writes it reports them."""
    seen = write_training(_training(spark, sf, SPLIT), shared_path(spark, "training"), "parquet")
    return spark.createDataFrame([(seen["positives"], seen["rows"])], "positives long, rows long")


def q_log_split_one_pass(spark, sf):
    """Valid rows and rejects of the raw log, parsed once."""
    valid, rejects = split_log(read_log_text(spark, _raw_log(spark, sf)), shared_path(spark, "split_log"))
    none = F.lit(None).cast("string").alias("reject_reason")
    left_out = rejects.select("user_id", "item_id", F.lit(None).cast("int"), F.lit(None).cast("timestamp_ntz"), "reject_reason")
    return valid.select(*LOG_OUT, none).union(left_out)


def q_feature_column_kinds(spark, sf):
    """Which columns of a joined table of opaque text can be assembled."""
    items = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("string").alias("price"),
        F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.col("p_size").cast("string")).alias("mixed"),
        F.lit(None).cast("string").alias("nothing"),
    )
    h = features.horizon(_log(spark, sf), SPLIT, ORIGIN).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = h.withColumns({c: F.col(c).cast("string") for c in ("user_id", "item_id")})
    text = read_keyed_features(spark, _csv(spark, items, "kinds_csv"), "item_id")
    return training.column_kinds(training.training_table(pairs, None, text))


def q_feature_join_text_columns(spark, sf):
    """Item features that are text, and numbers beyond a double's precision, come through unchanged."""
    h = features.horizon(_log(spark, sf), SPLIT, ORIGIN).groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = h.withColumns({c: F.col(c).cast("string") for c in ("user_id", "item_id")})
    items = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_brand").alias("brand"),
        (F.col("p_partkey") + F.lit(9007199254740992)).alias("code"),
    )
    text = read_keyed_features(spark, _csv(spark, items, "items_csv"), "item_id")
    return training.training_table(pairs, None, text).select("user_id", "item_id", "i_brand", "i_code", "n")


def _split_vectors(spark, sf, splits, label_days, rule=False):
    """Assembled training rows for several splits from one pass (E1 + C4).

    ``rule`` replaces the label by one that the features decide: 1 where the
    pair was viewed in the last 720 h."""
    table_ = extensions.multi_split_training(_log(spark, sf), splits, ORIGIN, label_days)
    cols = training.feature_columns(table_)
    if rule:
        table_ = table_.withColumn("label", (F.col("view_720h") > 0).cast("int"))
    vectors = training.assemble(table_, cols, keep=("split_date", "user_id", "item_id"))
    # Tree learners pass over their input several times: write the vectors
    # once rather than re-running the joins on every pass, each day in a folder
    # of its own, so that reading one day leaves the others alone.
    path = shared_path(spark, "vectors")
    vectors.write.partitionBy("split_date").parquet(path)
    return spark.read.parquet(path)


def _on(vectors, day):
    return vectors.where(F.col("split_date") == F.lit(as_date(day)))


def _holdout(spark, sf, estimator, rule=False):
    vectors = _split_vectors(spark, sf, HOLDOUT_SPLITS, HOLDOUT_SPLITS, rule)
    return models.holdout(estimator, _on(vectors, TRAIN_SPLIT), _on(vectors, SPLIT))


def q_gbt_holdout(spark, sf):
    return _holdout(spark, sf, models.gbt(**GBT_PARAMS))


def q_rf_holdout(spark, sf):
    return _holdout(spark, sf, models.random_forest(**RF_PARAMS))


def q_gbt_rule_holdout(spark, sf):
    return _holdout(spark, sf, models.gbt(**GBT_RULE), rule=True)


def q_rf_rule_holdout(spark, sf):
    return _holdout(spark, sf, models.random_forest(**RF_RULE), rule=True)


def _submission(spark, sf, estimator, rule=False):
    vectors = _split_vectors(spark, sf, [SPLIT, NEXT_SPLIT], [SPLIT], rule)
    model = estimator.fit(_on(vectors, SPLIT))
    return extensions.submission(model, _on(vectors, NEXT_SPLIT).drop("label"))


def q_submission(spark, sf):
    return _submission(spark, sf, models.random_forest(**RF_PARAMS))


def q_submission_rule(spark, sf):
    return _submission(spark, sf, models.random_forest(**RF_RULE), rule=True)


def q_rf_rare_rule_holdout(spark, sf):
    """Class weights and a learned cut-off on a label that one feature decides."""
    vectors = _split_vectors(spark, sf, HOLDOUT_SPLITS, HOLDOUT_SPLITS, rule=True)
    forest = models.random_forest(**RF_RULE, weight_col="weight")
    return models.holdout_rare(forest, _on(vectors, TRAIN_SPLIT), _on(vectors, SPLIT)).drop("base_f1")


def q_submission_rare(spark, sf):
    """The submission on the real labels, of which one pair in 300 is positive."""
    vectors = _split_vectors(spark, sf, [SPLIT, NEXT_SPLIT], [SPLIT])
    forest = models.random_forest(**RF_PARAMS, weight_col="weight")
    return extensions.submission_rare(forest, _on(vectors, SPLIT), _on(vectors, NEXT_SPLIT).drop("label"))


def q_stream_filter_log(spark, sf):
    return stream_filter_log(
        spark, sf.rstrip("/"), part_catalogue(spark, sf), file_glob="events.parquet"
    ).select("user_id", "item_id", "behavior_type", "ts")


QUERIES: dict[str, Query] = {
    "filter_log": q_filter_log,  # J1 C1
    "filter_count": q_filter_count,  # A12
    "filter_count_observed": q_filter_count_observed,  # A12 C1 K1 in one job
    "filter_log_split": q_filter_log_split,  # J1 C1, hot items split
    "log_projection": q_log_projection,  # P2 P3
    "log_rejects": q_log_rejects,  # D5 D14
    "before_split": q_before_split,  # P4 F2
    "ui_counts": q_ui_counts,  # A3 F3
    "ui_counts_windows": q_ui_counts_windows,  # A3 F3 with the caller's windows
    "ui_recency": q_ui_recency,  # A4 P9 P10
    "user_day_activity": q_user_day_activity,  # A5 A7 A8
    "ui_day_activity": q_ui_day_activity,  # A5 A9 A10
    "user_totals": q_user_totals,  # A6
    "ui_features": q_ui_features,  # C2 P8 (exact)
    "ui_features_truncated": q_ui_features_truncated,  # C2 P8 D1 (truncated)
    "ui_features_salted": q_ui_features_salted,  # C2, hot users split
    "ui_features_720_cutoff": q_ui_features_720_cutoff,  # C2, first day outside 720 h
    "ui_features_catalogue": q_ui_features_catalogue,  # C1 then C2
    "labels": q_labels,  # C3 F4 A11
    "positive_count": q_positive_count,  # A13 J4
    "user_features": q_user_features,  # E4
    "item_features": q_item_features,  # E4
    "feature_join_labelled": q_feature_join_labelled,  # C4 J2 J3 J4 P5-P7
    "feature_join_salted": q_feature_join_salted,  # C4, hot users and items split
    "feature_join_unlabelled": q_feature_join_unlabelled,  # C4 D8
    "pair_day_store": q_pair_day_store,  # K1 A5 C2 J2 from stored days
    "pair_day_store_hot": q_pair_day_store_hot,  # the same, users stored apart
    "multi_split_features": q_multi_split_features,  # E1
    "training_multi_split": q_training_multi_split,  # E1 C4
    "training_multi_split_partial_labels": q_training_multi_split_partial_labels,  # E1 C4 D8
    "log_by_day": q_log_by_day,  # E2
    "eval_metrics": q_eval_metrics,  # A14 A15 F5-F7 D7
    "stream_filter_log": q_stream_filter_log,  # C1 as a stream
    "libsvm_roundtrip": q_libsvm_roundtrip,  # C5 K4 S7 P11
    "libsvm_roundtrip_array": q_libsvm_roundtrip_array,  # C5 K4 S7 P11, every position
    "libsvm_unlabelled": q_libsvm_unlabelled,  # C5 K4 D9
    "log_csv_roundtrip": q_log_csv_roundtrip,  # S1 S2 K1 F1 P1 X1-X4
    "log_csv_rejects": q_log_csv_rejects,  # S1 D5 D14 X2 X3
    "catalogue_csv": q_catalogue_csv,  # S3 A1
    "filter_log_csv": q_filter_log_csv,  # C1 from S1 and S3 to K1
    "ui_features_csv": q_ui_features_csv,  # K2 S4
    "feature_join_csv": q_feature_join_csv,  # K2 K3 S4 S5 S6 C4
    "training_table_csv": q_training_table_csv,  # K3 C4
    "training_counts_observed": q_training_counts_observed,  # A12 A13 K3 in one job
    "log_split_one_pass": q_log_split_one_pass,  # P1 D5 in one pass
    "feature_column_kinds": q_feature_column_kinds,  # S5 S6 X3
    "feature_join_text_columns": q_feature_join_text_columns,  # S6 with opaque text
    "gbt_rule_holdout": q_gbt_rule_holdout,  # M1 M3 M4 on a known rule
    "rf_rule_holdout": q_rf_rule_holdout,  # M2 M3 M4 on a known rule
    "rf_rare_rule_holdout": q_rf_rare_rule_holdout,  # M2 M3 M4, weights and cut-off
    "submission_rule": q_submission_rule,  # E3 on a known rule
    "submission_rare": q_submission_rare,  # E3, weights and cut-off
    "gbt_holdout": q_gbt_holdout,  # M1 M3 M4
    "rf_holdout": q_rf_holdout,  # M2 M3 M4
    "submission": q_submission,  # E3
}
