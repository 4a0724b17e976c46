"""Labels for a day (C3): which (user, item) pairs were bought on that day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.functions.time import DateLike, as_date, midnight, time_range
from cartcast.schema import BUY


def day_buys(log: DataFrame, day: DateLike) -> DataFrame:
    """F4 + A11: distinct (user, item) with a buy on ``day``.

    The day is a half-open ``ts`` range, so the Parquet reader prunes on it;
    ``distinct`` combines map-side, so a user buying one item many times ships
    one row per task.
    """
    d = as_date(day)
    on_day = time_range(log.columns, d, d + dt.timedelta(days=1))
    return log.where((F.col("behavior_type") == BUY) & on_day).select("user_id", "item_id").distinct()


def buys_on_days(log: DataFrame, days, name: str = "split_date") -> DataFrame:
    """``day_buys`` for several days in one scan, keyed by ``name`` = the day."""
    ds = sorted({as_date(d) for d in days})
    in_range = time_range(log.columns, ds[0], ds[-1] + dt.timedelta(days=1))
    day = F.to_date("ts")
    rows = log.where((F.col("behavior_type") == BUY) & in_range & day.isin(*ds))
    return rows.select(day.alias(name), "user_id", "item_id").distinct()


def attach_label(
    pairs: DataFrame,
    buys: DataFrame,
    name: str = "label",
    group: tuple[str, ...] = (),
    known: Column | None = None,
) -> DataFrame:
    """``label`` 1 when the pair is in ``buys``, else 0; NULL where ``known`` is false.

    Both sides are unique on (user, item) (plus ``group``), so this join
    cannot be skewed: each key has one row per side.
    """
    keys = [*group, "user_id", "item_id"]
    hits = buys.select(*keys).distinct().withColumn("_hit", F.lit(1))
    joined = pairs.join(hits, keys, "left")
    label = F.coalesce(F.col("_hit"), F.lit(0)).cast("int")
    return joined.withColumn(name, label if known is None else F.when(known, label)).drop("_hit")


def labelled_pairs(log: DataFrame, day: DateLike, name: str = "label") -> DataFrame:
    """Pairs seen before ``day`` with ``label`` = bought on ``day``, in one pass.

    The same rows as ``attach_label(pairs before day, day_buys(day))`` without
    a second scan or a join: one aggregation over the rows before the next
    midnight flags, per pair, whether it was seen before ``day`` and bought on it.
    """
    d = as_date(day)
    start = midnight(d)
    per_pair = log.where(time_range(log.columns, end=d + dt.timedelta(days=1))).groupBy("user_id", "item_id").agg(
        F.count_if(F.col("ts") < start).alias("_before"),
        F.count_if((F.col("behavior_type") == BUY) & (F.col("ts") >= start)).alias("_bought"),
    )
    return per_pair.where(F.col("_before") > 0).select(
        "user_id", "item_id", (F.col("_bought") > 0).cast("int").alias(name)
    )


def positive_count(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Rows with label 1, and all rows, as one row."""
    return labelled.agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count(F.lit(1)).alias("rows")
    )
