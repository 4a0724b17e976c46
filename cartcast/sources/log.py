"""Interaction-log sources: CSV text logs and the valid/reject split.

A normalised log has at least ``user_id, item_id, behavior_type INT,
ts TIMESTAMP_NTZ``. Ids keep the type they were read with (strings from CSV,
longs from Parquet); nothing downstream depends on the id type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.functions.time import DateLike, as_date, parse_log_time
from cartcast.schema import BEHAVIOURS, HEADER_MARK, RAW_LOG

VALID_CODES = sorted(BEHAVIOURS)


def read_log_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read a raw or filtered log CSV as strings.

    Header rows are dropped by their first field (F1), so a raw file with a
    header, a filtered file without one, and concatenations of both read alike.
    Lines are split at every comma (X1: the format has no quoting) and trimmed
    (X4); empty and missing fields become NULL, and fields beyond the sixth are
    ignored. A blank line is a row of NULLs, which ``parse_log`` rejects; Spark's
    CSV reader would skip it unseen.
    """
    fields = F.split(F.col("value"), ",", -1)
    raw = spark.read.text(path).select(
        *[F.nullif(F.trim(F.get(fields, F.lit(k))), F.lit("")).alias(f.name) for k, f in enumerate(RAW_LOG)]
    )
    return raw.where(F.col("user_id").isNull() | (F.col("user_id") != F.lit(HEADER_MARK)))


Calendar = tuple[DateLike, DateLike]


def _parsed(raw: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    behaviour = F.col("behavior_type").try_cast("int")
    ts = parse_log_time("time")
    blank = F.coalesce(*[F.col(f.name) for f in RAW_LOG]).isNull()
    reason = (
        F.when(blank, F.lit("blank line"))
        .when(F.col("user_id").isNull(), F.lit("missing user_id"))
        .when(F.col("item_id").isNull(), F.lit("missing item_id"))
        .when(behaviour.isNull() | ~behaviour.isin(*VALID_CODES), F.lit("bad behavior_type"))
        .when(ts.isNull(), F.lit("bad time"))
    )
    if calendar is not None:
        first, last = (as_date(d) for d in calendar)
        day = F.to_date(ts)
        reason = reason.when((day < F.lit(first)) | (day > F.lit(last)), F.lit("outside calendar"))
    return raw.select(
        "user_id",
        "item_id",
        behaviour.alias("behavior_type"),
        ts.alias("ts"),
        "user_geohash",
        "item_category",
        F.col("time").alias("raw_time"),
        reason.alias("reject_reason"),
    )


def parse_log(raw: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """Typed, valid log rows (P1-P3). Malformed rows are left out; see ``log_rejects``.

    Any well-formed date is valid by default. ``calendar=(first, last)``
    keeps only days in that range, as the original did implicitly (it knew
    only 11-18 to 12-18 and failed on other days); the rest are rejected.
    """
    return _parsed(raw, calendar).where(F.col("reject_reason").isNull()).drop("reject_reason", "raw_time")


def log_rejects(raw: DataFrame, calendar: Calendar | None = None) -> DataFrame:
    """Rows ``parse_log`` leaves out, with the reason."""
    return _parsed(raw, calendar).where(F.col("reject_reason").isNotNull()).select(
        "user_id", "item_id", "behavior_type", "raw_time", "reject_reason"
    )


def split_log(raw: DataFrame, path: str, calendar: Calendar | None = None) -> tuple[DataFrame, DataFrame]:
    """``parse_log`` and ``log_rejects`` in one pass: (valid rows, rejects), read back from ``path``.

    The text is split and parsed once and written with the verdict as the
    partition column (``kind=valid`` and ``kind=reject``, so reading one leaves
    the other alone). A re-run replaces both.
    """
    parsed = _parsed(raw, calendar)
    kind = F.when(F.col("reject_reason").isNull(), F.lit("valid")).otherwise(F.lit("reject"))
    parsed.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(path)
    both = raw.sparkSession.read.schema(parsed.schema.add("kind", "string")).parquet(path)
    valid = both.where(F.col("kind") == "valid").drop("kind", "reject_reason", "raw_time")
    rejects = both.where(F.col("kind") == "reject")
    return valid, rejects.select("user_id", "item_id", "behavior_type", "raw_time", "reject_reason")


def read_log(spark: SparkSession, path: str | list[str], calendar: Calendar | None = None) -> DataFrame:
    return parse_log(read_log_text(spark, path), calendar)


def read_log_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A log already written by ``write_log`` (typed Parquet)."""
    return spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
