"""Catalogue, feature-table and libsvm sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartcast.schema import HEADER_MARK, RAW_ITEMS, UI_COUNT_TYPES


def read_catalogue(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Item catalogue CSV (S3): ``item_id`` plus the two descriptive columns.

    Duplicate ids are kept; the semi-join that consumes the catalogue ignores them.
    """
    raw = spark.read.schema(RAW_ITEMS).option("header", False).csv(path)
    return raw.where(F.col("item_id").isNotNull() & (F.col("item_id") != F.lit("item_id")))


def ui_feature_schema() -> T.StructType:
    fields = [T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType())]
    fields += [T.StructField(name, dtype) for name, dtype in UI_COUNT_TYPES]
    return T.StructType(fields)


def read_ui_features(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """User-item feature table (S4). CSV rows whose first field is ``user_id``
    (a header) are dropped, and so are rows without a user, which no join could
    use; Parquet is read as written."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.schema(ui_feature_schema()).option("header", False).csv(path)
    return df.where(F.col("user_id") != F.lit(HEADER_MARK))


def read_keyed_features(
    spark: SparkSession,
    path: str,
    key: str,
    fmt: str = "csv",
    schema: T.StructType | None = None,
    header: bool = True,
) -> DataFrame:
    """User (S5) or item (S6) feature table keyed by ``key``.

    CSV: with ``header`` the first line names the columns and must name the
    key; without it the key is the first column. The other columns are carried
    as they are: text, unless a ``schema`` is given (``assemble`` turns numbers
    into DOUBLE and fails on what is not one). Parquet is read as written.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif schema is not None:
        df = spark.read.schema(schema).option("header", False).csv(path)
        df = df.where(F.col(key) != F.lit(key))
    else:
        df = spark.read.option("header", header).option("inferSchema", False).csv(path)
        if not header:
            df = df.withColumnRenamed("_c0", key)
    if key not in df.columns:
        raise ValueError(f"feature table at {path} has no key column {key!r}")
    return df


def read_training(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Training table (K3) as ``write_training`` wrote it; CSV needs the ``schema`` of the table written.

    The header must name the schema's columns in order: a table of another
    width or order is an error, not a shift of columns. The column a table was
    partitioned by may stand in ``schema`` too: it comes from the folders.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """libsvm rows (S7) as ``label DOUBLE, features VECTOR``.

    ``numFeatures`` is given, so every file shares one vector width and the
    reader does not scan the data to infer it.
    """
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)
