"""Catalogue filter (C1): keep log rows whose item is in the item catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartcast.operators.skew import DEFAULT_SKEW, SkewConfig, hot_keys, key_weights, salted_join


def catalogue_keys(items: DataFrame) -> DataFrame:
    """A1: item ids of the catalogue. Duplicates may stay: a semi-join ignores them."""
    return items.select("item_id").where(F.col("item_id").isNotNull())


def distinct_items(items: DataFrame) -> DataFrame:
    """A1: the distinct item ids of the catalogue."""
    return catalogue_keys(items).distinct()


def filter_log(log: DataFrame, items: DataFrame) -> DataFrame:
    """Log rows whose ``item_id`` is in ``items``.

    No hint and no action: Spark broadcasts the catalogue when its size in
    bytes is below ``spark.sql.autoBroadcastJoinThreshold``, as estimated from
    its files or, under AQE, as measured. Otherwise both sides are shuffled on
    ``item_id``; the catalogue is not de-duplicated, so its shuffle sits right
    under the join and AQE's skew-join rule can split a hot item's partition on
    the log side.
    """
    return log.join(catalogue_keys(items), "item_id", "left_semi")


def filter_log_split(
    log: DataFrame,
    items: DataFrame,
    cfg: SkewConfig = DEFAULT_SKEW,
    weights: DataFrame | None = None,
    weight_col: str = "n_rows",
) -> DataFrame:
    """J1 for a catalogue too large to broadcast: hot items are split, whatever AQE does.

    The log rows of an item above ``cfg``'s threshold are dealt over salts by a
    hash of their other columns, and the catalogue, reduced to distinct ids, is
    repeated for those items only. Rows of other items, and the catalogue's,
    are shuffled once on the item as in a plain join. The same rows as
    ``filter_log``; rows without an item stay out.

    ``weights`` is a table of rows per item (``weight_col``), such as one kept
    from a former run; only which items are split depends on it, not the result.
    Without it the log's item column is scanned once more to count. Items off
    the catalogue are not counted as hot where the catalogue tells (their rows
    meet nothing): the weights are reduced to it first, a join of two tables of
    one row per item.
    """
    keys = distinct_items(items)
    if weights is None:
        weights, weight_col = key_weights(log.where(F.col("item_id").isNotNull()), ["item_id"]), "_weight"
    known = weights.select("item_id", weight_col).join(keys, "item_id", "left_semi")
    hot = hot_keys(known, ["item_id"], weight_col, cfg)
    return salted_join(log, keys, ["item_id"], hot, "left_semi")


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    """One-row count, kept as a DataFrame so it runs where the data is."""
    return df.agg(F.count(F.lit(1)).alias(name))
