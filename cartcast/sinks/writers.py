"""Sinks (K1-K3, E2). All writes are distributed and overwrite their target,
so a re-run replaces its output instead of appending a second copy."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cartcast.schema import LOG_TIME_FORMAT


def log_as_text(log: DataFrame) -> DataFrame:
    """The log in the raw CSV layout: ids, behaviour, geohash, category, time."""
    def opt(name: str):
        return F.col(name).cast("string") if name in log.columns else F.lit(None).cast("string")

    return log.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("item_id").cast("string").alias("item_id"),
        F.col("behavior_type").cast("string").alias("behavior_type"),
        opt("user_geohash").alias("user_geohash"),
        opt("item_category").alias("item_category"),
        F.date_format("ts", LOG_TIME_FORMAT).alias("time"),
    )


def observed(df: DataFrame, write: Callable[[DataFrame], object], **metrics: Column) -> dict:
    """``write(df)``, and aggregates of the rows it wrote, in one job.

    The metrics sit right under the write, in its last stage: each of its tasks
    is committed once, so a task that ran twice (retry, speculation, a lost
    executor) counts once, as its rows are written once. They come to the
    driver as one row; ``write`` must run exactly one action on its argument.

    The write runs in a session of its own beside the caller's (same
    application, settings and tables): a session that has observed anything
    can no longer be serialised, and a random forest just fitted in it, whose
    closures carry it along, would fail to predict.
    """
    spark, name = df.sparkSession, f"observed_{uuid.uuid4().hex}"
    beside = spark.newSession()
    for key, value in ((r["key"], r["value"]) for r in spark.sql("SET").collect()):
        if key.startswith("spark.sql.") and beside.conf.isModifiable(key):
            beside.conf.set(key, value)
    df.createGlobalTempView(name)
    try:
        seen = Observation()
        rows = beside.table(f"{beside.conf.get('spark.sql.globalTempDatabase', 'global_temp')}.{name}")
        write(rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
        return seen.get
    finally:
        spark.catalog.dropGlobalTempView(name)


def write_log(log: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: the filtered log. ``csv`` writes the raw text layout without header."""
    if fmt == "csv":
        log_as_text(log).write.mode("overwrite").option("header", False).csv(path)
    else:
        log.write.mode("overwrite").parquet(path)


def write_log_counted(log: DataFrame, path: str, fmt: str = "parquet") -> int:
    """K1 + A12: write the log and return how many rows were written, in one job."""
    n_rows = F.count(F.lit(1))
    return observed(log, lambda df: write_log(df, path, fmt), n_rows=n_rows)["n_rows"]


def write_training(
    df: DataFrame, path: str, fmt: str = "csv", label: str = "label", partition_by: str | None = None
) -> dict:
    """K3 + A13: write the training table and return its ``rows`` and ``positives``, in one job.

    CSV is written with a header, one record per row; a label that is NULL or a
    table without one counts no positive.
    """
    positives = F.count_if(F.col(label) == 1) if label in df.columns else F.count_if(F.lit(False))
    return observed(
        df,
        lambda t: write_table(t, path, fmt, header=True, partition_by=partition_by),
        rows=F.count(F.lit(1)),
        positives=positives,
    )


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", header: bool = False, partition_by: str | None = None
) -> None:
    """K2/K3: a feature or training table, one record per row. ``partition_by``
    writes one folder per value (e.g. ``split_date``: one table per split day)."""
    writer = df.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer.option("header", header).csv(path)
    else:
        writer.parquet(path)


def write_log_by_day(log: DataFrame, path: str) -> None:
    """One folder per calendar day of ``ts``.

    ``rebalance`` deals the rows by day and lets AQE split large days and merge
    small ones, so the number of files follows the size of the log, not tasks
    times days as without a shuffle, and no task gets a large day whole.
    """
    with_day = log.withColumn("day", F.to_date("ts"))
    with_day.hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(path)
