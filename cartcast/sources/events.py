"""Adapter from the generic ``events`` table to an interaction log, and the
``part`` table to an item catalogue.

``events`` has a user, a timestamp, an event type and a JSON ``props`` with key
``k``. It maps onto the log as: item = ``props.k``; view -> 1, click -> 2
(stands in for favourite), signup -> 3 (stands in for cart), purchase -> 4;
``error`` has no behaviour and goes to the rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.schema import BUY, CART, FAV, VIEW

EVENT_BEHAVIOUR = {"view": VIEW, "click": FAV, "signup": CART, "purchase": BUY}
CATALOGUE_TYPE = "ECONOMY"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _behaviour():
    expr = F.lit(None).cast("int")
    for name, code in reversed(list(EVENT_BEHAVIOUR.items())):
        expr = F.when(F.col("event_type") == F.lit(name), F.lit(code)).otherwise(expr)
    return expr


# Fixed value: the only JSON shape the fast path accepts is one integer key k.
FLAT_K = r'^\{\s*"k"\s*:\s*(-?(?:0|[1-9][0-9]*))\s*\}$'


def item_key(props: str = "props"):
    """``props.k`` as BIGINT.

    A JSON parse per row is the costliest step of the scan, so props that are
    exactly ``{"k": <integer>}`` are read with an anchored pattern, and only
    other shapes go through the JSON parser (``coalesce`` evaluates it only
    when the pattern did not match). Both give the same value.
    """
    fast = F.regexp_extract(F.col(props), FLAT_K, 1).try_cast("bigint")
    return F.coalesce(fast, F.get_json_object(F.col(props), "$.k").try_cast("bigint"))


def _mapped(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id"),
        item_key().alias("item_id"),
        _behaviour().alias("behavior_type"),
        F.col("ts"),
    )


def log_from_events(events: DataFrame) -> DataFrame:
    """Valid log rows: known event type, user, item and time present.

    The event-type test is a plain ``IN`` on a column of the scan, so it is
    pushed into the Parquet reader.
    """
    known = events.where(F.col("event_type").isin(*EVENT_BEHAVIOUR))
    return _mapped(known).where(
        F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("ts").isNotNull()
    )


def event_rejects(events: DataFrame) -> DataFrame:
    """Events that ``log_from_events`` leaves out, with a reason."""
    m = events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        item_key().alias("item_id"),
    )
    reason = (
        F.when(~F.col("event_type").isin(*EVENT_BEHAVIOUR) | F.col("event_type").isNull(),
               F.lit("bad behavior_type"))
        .when(F.col("user_id").isNull(), F.lit("missing user_id"))
        .when(F.col("item_id").isNull(), F.lit("missing item_id"))
        .when(F.col("ts").isNull(), F.lit("bad time"))
    )
    return m.withColumn("reject_reason", reason).where(F.col("reject_reason").isNotNull())


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(table(spark, sf_dir, "events"))


def catalogue_from_part(part: DataFrame, p_type: str = CATALOGUE_TYPE) -> DataFrame:
    """Item catalogue: parts of one type, ``p_partkey`` as ``item_id``."""
    return part.where(F.col("p_type") == F.lit(p_type)).select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("item_category")
    )


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_from_part(table(spark, sf_dir, "part"))
