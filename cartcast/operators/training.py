"""Training table (C4) and feature-vector assembly.

The user-item features meet the user features on ``user_id`` and the item
features on ``item_id``; the label, when asked for, says whether the pair was
bought on the split day. Both keyed joins are skew-safe: a user with very many
pairs, or an item touched by very many users, is split over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartcast.operators.labels import attach_label
from cartcast.operators.skew import DEFAULT_SKEW, SkewConfig, hot_keys, key_weights, salted_join

U, I = "user_id", "item_id"


def prefixed(df: DataFrame, keys: str | Sequence[str], prefix: str) -> DataFrame:
    """Keep the keys, prefix every other column (no name clashes)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).alias(c if c.startswith(prefix) else prefix + c) for c in rest])


def training_table(
    ui: DataFrame,
    user_features: DataFrame | None = None,
    item_features: DataFrame | None = None,
    buys: DataFrame | None = None,
    how: str = "inner",
    skew: SkewConfig = DEFAULT_SKEW,
    group: tuple[str, ...] = (),
    user_weight: str | None = None,
    item_weight: str | None = None,
) -> DataFrame:
    """C4: user-item rows with user (``u_*``) and item (``i_*``) columns and a label.

    ``how="inner"`` drops pairs whose user or item has no feature row, as the
    original join did; ``"left"`` keeps them with NULLs. ``buys`` (from
    ``day_buys``) adds ``label``; leave it out for the day to predict.
    Duplicate keys in a feature table repeat rows (bag semantics).

    Hot users and items are found from pairs per key. ``user_weight`` and
    ``item_weight`` name a column of the user or item table that already holds
    that count (the profiles' ``item_count`` and ``user_count``); then the
    small feature tables are read for it. Otherwise ``ui`` is scanned once more
    per join to count, so pass a written table rather than a long lineage.
    ``group`` names leading key columns every table shares (the split date of
    a multi-split table); all joins then key on them too. The label is joined
    first, while rows are narrow.
    """
    g = list(group)
    out = attach_label(ui, buys, group=tuple(g)) if buys is not None else ui

    def hot_for(key: str, table: DataFrame, weight: str | None):
        weights = table.select(*g, key, F.col(weight).alias("_weight")) if weight else key_weights(ui, [*g, key])
        return hot_keys(weights, [*g, key], "_weight", skew)

    if user_features is not None:
        users = prefixed(user_features, [*g, U], "u_")
        hot = hot_for(U, user_features, user_weight)
        out = salted_join(out, users, [*g, U], hot, how, spread=[I])
    if item_features is not None:
        items = prefixed(item_features, [*g, I], "i_")
        hot = hot_for(I, item_features, item_weight)
        out = salted_join(out, items, [*g, I], hot, how, spread=[U])
    if buys is not None:
        out = out.select(*[c for c in out.columns if c != "label"], "label")
    return out


def feature_columns(df: DataFrame, exclude: Sequence[str] = (U, I, "label", "split_date")) -> list[str]:
    """Columns to assemble, in table order (keys and label left out): numeric
    ones, and text, which ``assemble`` reads as numbers."""
    kinds = {"int", "bigint", "smallint", "tinyint", "double", "float", "string"}
    return [c for c, t in df.dtypes if c not in exclude and (t in kinds or t.startswith("decimal"))]


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """What each column holds, by one aggregate over the table: a row per column with
    ``column``, ``kind`` (``number``, ``text``, or ``empty`` for no value at all),
    ``n_values`` (not NULL) and ``n_text`` (values that are no number).

    Typed columns are numbers without a look at their values.
    """
    columns = list(columns) if columns is not None else feature_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, kind string, n_values long, n_text long")
    types = dict(df.dtypes)
    aggs = []
    for k, c in enumerate(columns):
        text = F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() if types[c] == "string" else F.lit(False)
        aggs += [F.count(F.col(c)).alias(f"v{k}"), F.count_if(text).alias(f"t{k}")]
    kind = "CASE WHEN n_values = 0 THEN 'empty' WHEN n_text = 0 THEN 'number' ELSE 'text' END"
    one = lambda k, c: F.struct(F.lit(c).alias("column"), F.col(f"v{k}").alias("n_values"), F.col(f"t{k}").alias("n_text"))
    listed = F.array(*[one(k, c) for k, c in enumerate(columns)])
    rows = df.agg(*aggs).select(F.explode(listed).alias("c")).select("c.*")
    return rows.select("column", F.expr(kind).alias("kind"), "n_values", "n_text")


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(columns to assemble, text columns left out), in table order, by ``column_kinds``.

    The report has one row per column of the table. A column without any value
    is kept: it assembles to NaN at its place, so the vector's width does not
    depend on the day's rows.
    """
    wanted = list(columns) if columns is not None else feature_columns(df)
    text = {r["column"] for r in column_kinds(df, wanted).where("kind = 'text'").collect()}
    return [c for c in wanted if c not in text], [c for c in wanted if c in text]


def _as_number(df: DataFrame, name: str):
    """The column as DOUBLE; a value that is not a number is an error, not a NULL."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "string":
        return c.cast("double").alias(name)
    bad = F.raise_error(F.concat(F.lit(f"feature column {name} holds a value that is not a number: "), c))
    number = c.try_cast("double")
    return F.when(c.isNotNull() & number.isNull(), bad.cast("double")).otherwise(number).alias(name)


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (U, I)) -> DataFrame:
    """Keys, optional ``label`` (as DOUBLE) and a ``features`` vector.

    The column list is fixed by the caller, so train and test vectors have the
    same width and order whatever rows each holds. NULLs become NaN.
    """
    vec = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")
    cols = [*keep, "features"]
    if "label" in df.columns:
        df = df.withColumn("label", F.col("label").cast("double"))
        cols.append("label")
    casted = df.select(*[c for c in df.columns if c not in columns], *[_as_number(df, c) for c in columns])
    return vec.transform(casted).select(*cols)


def write_libsvm(df: DataFrame, columns: Sequence[str], path: str) -> int:
    """Write ``label i:v ...`` rows; returns the vector width for the reader.

    Indices count from 1. Zeros are written too (the vectors are dense), so a
    line has one field per feature. A table without a label column, as for the
    day to predict, is written with label 0: the format has no place for a
    missing one. Rows whose label is NULL are left out: they are not negatives.
    """
    rows = assemble(df, columns, keep=())
    if "label" in rows.columns:
        rows, label = rows.where(F.col("label").isNotNull()), F.col("label")
    else:
        label = F.lit(0.0)
    dense = array_to_vector(vector_to_array("features"))
    rows.select(label.alias("label"), dense.alias("features")).write.mode("overwrite").format("libsvm").save(path)
    return len(columns)
