"""Extensions the original code describes in comments but does not build.

E1  several split dates in one pass
E2  the log split into one folder per day
E3  the submission: pairs predicted to be bought on the day after the log
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.functions.time import DateLike, as_date, split_hour
from cartcast.operators import models
from cartcast.operators.features import DAY, I, U, pair_days, ui_features_from_pair_days
from cartcast.operators.labels import attach_label, buys_on_days
from cartcast.operators.profiles import profile_from_pair_days
from cartcast.operators.skew import DEFAULT_SKEW, SkewConfig
from cartcast.operators.training import prefixed, training_table
from cartcast.session import cut_lineage
from cartcast.sinks.writers import write_log_by_day


SPLIT = "split_date"


def multi_split_pair_days(log: DataFrame, splits: Sequence[DateLike], origin: DateLike):
    """``pair_days`` for several split dates, keyed by ``split_date``.

    Pair-day rows do not depend on the split, so the log is aggregated once
    (up to the last split) and written; when that table is read, each row is
    repeated once per split its day precedes (a generator over a short literal
    array, not a join), so what is stored does not grow with the splits.
    Returns the table and the split hour as a SQL expression over ``split_date``.
    """
    dates = sorted({as_date(s) for s in splits})
    if not dates:
        raise ValueError("give at least one split date")
    arr = F.array(*[F.lit(d) for d in dates])
    daily = cut_lineage(pair_days(log, dates[-1], origin), "pair_days")
    fanned = daily.withColumn(SPLIT, F.explode(F.filter(arr, lambda s: F.col(DAY) < s)))
    return fanned.select(SPLIT, *daily.columns), _split_hours(origin)


def _split_hours(origin: DateLike) -> str:
    """The split hour as SQL text over ``split_date``."""
    return f"datediff({SPLIT}, DATE'{as_date(origin).isoformat()}') * 24"


def multi_split_features(
    log: DataFrame,
    splits: Sequence[DateLike],
    origin: DateLike,
    ratio_mode: str = "exact",
    skew: SkewConfig = DEFAULT_SKEW,
) -> DataFrame:
    """``ui_features`` for each date in ``splits``, with a ``split_date`` column.

    One scan of the log serves all splits, and one join on the user: pair-day
    rows are repeated per split after it (``ui_features_from_pair_days``).
    """
    dates = sorted({as_date(s) for s in splits})
    if not dates:
        raise ValueError("give at least one split date")
    daily = cut_lineage(pair_days(log, dates[-1], origin), "pair_days")
    of = [(d.isoformat(), split_hour(d, origin)) for d in dates]
    return ui_features_from_pair_days(daily, _split_hours(origin), ratio_mode, skew, group=(SPLIT,), splits=of)


def multi_split_training(
    log: DataFrame,
    splits: Sequence[DateLike],
    origin: DateLike,
    label_days: Sequence[DateLike] | None = None,
    skew: SkewConfig = DEFAULT_SKEW,
) -> DataFrame:
    """E1 + C4: training tables for several splits from one pass over the log.

    Rows carry ``split_date``; for the days in ``label_days`` (a hold-out labels
    both its training and its test day) ``label`` is 1 when the pair was bought
    on its split day, else 0. On the other splits it is NULL: nothing is known
    of them. Without ``label_days`` there is no label.
    """
    daily, sh = multi_split_pair_days(log, splits, origin)
    days = sorted({as_date(d) for d in label_days or ()})
    buys = buys_on_days(log, days, SPLIT) if days else None
    known = F.col(SPLIT).isin(*days) if days else None
    return training_from_pair_days(daily, sh, buys, skew, (SPLIT,), known)


def training_from_pair_days(
    daily: DataFrame,
    sh,
    buys: DataFrame | None = None,
    skew: SkewConfig = DEFAULT_SKEW,
    group: tuple[str, ...] = (),
    label_known: Column | None = None,
) -> DataFrame:
    """C4 with both profiles, from the written ``pair_days`` table.

    The user's profile rides along in the join that C2 makes on the user
    anyway, and the label is joined next, where rows are already dealt by
    pair; only the item's profile needs a join of its own. Profiles are small
    and read more than once: they are written.
    """
    users = prefixed(profile_from_pair_days(daily, U, I, sh, group), [*group, U], "u_")
    items = cut_lineage(profile_from_pair_days(daily, I, U, sh, group), "item_profiles")
    ui = ui_features_from_pair_days(daily, sh, skew=skew, group=group, user_columns=users)
    if buys is not None:
        ui = attach_label(ui, buys, group=group, known=label_known)
    out = training_table(ui, None, items, skew=skew, group=group, item_weight="user_count")
    return out.select(*[c for c in out.columns if c != "label"], *(["label"] if buys is not None else []))


def log_by_day(spark: SparkSession, log: DataFrame, path: str) -> DataFrame:
    """Write the log partitioned by day, then read it back.

    The read-back frame has a ``day`` partition column; filters on it prune
    whole folders.
    """
    write_log_by_day(log, path)
    return spark.read.parquet(path)


def submission(model, features: DataFrame, keys: Sequence[str] = (U, I)) -> DataFrame:
    """(user, item) pairs the model predicts will be bought."""
    scored = model.transform(features)
    return scored.where(F.col("prediction") == 1.0).select(*keys)


def submission_rare(estimator, train: DataFrame, features: DataFrame, keys: Sequence[str] = (U, I)) -> DataFrame:
    """E3 where positives are rare: fitted with class weights, predicted from the cut-off
    that ``train``'s day taught (``models.holdout_rare`` measures the same on a labelled day)."""
    known = train.where(F.col("label").isNotNull())
    model = estimator.fit(models.with_class_weights(known))
    cutoff = cut_lineage(models.learn_cutoff(models.scored(model, known)), "cutoff")
    return models.predict_from(model, cutoff, features, tuple(keys)).where(F.col("prediction") == 1.0).select(*keys)
