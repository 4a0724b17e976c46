"""User and item feature producers.

The training-table join consumes user and item feature tables but the original
code has no producer for them. These are our own definitions, built from the
same log cut at the split: per user, and per item, the rows of each behaviour
in the 24 h, 168 h and 720 h windows, the number of days with any row and with
a buy, the distinct counterparts (items of a user, users of an item) and those
bought, and the buy-per-view conversion.

Both derive from the ``pair_days`` table in one linear chain: grouping sets
emit each (key, day) and each (key, counterpart) group in a single aggregate,
and a last aggregate per key counts them. Every step combines map-side, so a
hot user or item reaches its final task as a few partial rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartcast.functions.ratio import guarded_ratio
from cartcast.functions.time import DateLike, split_hour
from cartcast.operators.features import DAY, I, U, SplitHour, pair_days, window_of_row
from cartcast.schema import BEHAVIOURS, BUY, VIEW, count_col

PROFILE_WINDOWS = (24, 168, 720)
PROFILE_PAIRS = [(b, w) for w in PROFILE_WINDOWS for b in BEHAVIOURS]
PROFILE_COUNTS = [count_col(b, w) for b, w in PROFILE_PAIRS]


def profile_columns(other: str) -> list[str]:
    """Value columns of a profile, in order; ``other`` is ``item_id`` for a
    user profile and ``user_id`` for an item profile."""
    name = other.split("_")[0]
    return PROFILE_COUNTS + [f"{name}_count", f"{name}_buy_count", "active_days", "buy_days", "conv_view_buy"]


def profile_from_pair_days(
    daily: DataFrame, key: str, other: str, sh: SplitHour, group: tuple[str, ...] = ()
) -> DataFrame:
    """One row per ``key`` (``user_id`` or ``item_id``) of ``pair_days``;
    ``group`` adds leading key columns (the split date of a multi-split table)."""
    g = list(group)
    name = other.split("_")[0]
    sets = daily.groupingSets([[*g, key, DAY], [*g, key, other]], *g, key, DAY, other).agg(
        F.grouping_id().alias("_gid"),
        F.sum("_nb").alias("_nb"),
        *[F.expr(f"sum({window_of_row(b, w, sh)})").alias(count_col(b, w)) for b, w in PROFILE_PAIRS],
    )
    # grouping_id bits follow (*group, key, day, other); 1 = rolled up.
    by_day = F.col("_gid") == 1
    by_other = F.col("_gid") == 2
    bought = F.col("_nb") > 0
    out = sets.groupBy(*g, key).agg(
        # Each pair-day row is in exactly one (key, day) group: sum those only.
        *[F.coalesce(F.sum(F.when(by_day, F.col(c))), F.lit(0)).cast("long").alias(c) for c in PROFILE_COUNTS],
        F.count_if(by_other).alias(f"{name}_count"),
        F.count_if(by_other & bought).alias(f"{name}_buy_count"),
        F.count_if(by_day).alias("active_days"),
        F.count_if(by_day & bought).alias("buy_days"),
    )
    conv = guarded_ratio(F.col(count_col(BUY, 720)), F.col(count_col(VIEW, 720)))
    return out.withColumn("conv_view_buy", conv)


def _slim_pair_days(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    # Only the counts a profile reads; no first/last hours.
    return pair_days(log, split, origin, counts=PROFILE_PAIRS, first_last=False)


def user_profile(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    """One row per user active before the split."""
    return profile_from_pair_days(_slim_pair_days(log, split, origin), U, I, split_hour(split, origin))


def item_profile(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    """One row per item touched before the split."""
    return profile_from_pair_days(_slim_pair_days(log, split, origin), I, U, split_hour(split, origin))
