"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import cartcast
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.session import cut_lineage, shared_path

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# A key holding more than 1/HOT_PARTS of the rows counts as hot, so fewer than
# HOT_PARTS keys can be hot: that is the proven bound of what is broadcast.
HOT_PARTS = 1000
HOT_LEAST = 100

# Rows of a few fixed-width columns that are broadcast at most: tens of MB.
SMALL_ROWS = 1_000_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, once per application.

    The same as submitting with ``--py-files``; harmless where they can import
    it anyway. The archive is only the source the driver serves it from.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(cartcast.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="cartcast-py-")) / "cartcast.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"cartcast/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: str | Column) -> Column:
    """Lower-case A-Z only; null counts as empty. ``lower`` has a fast path for
    plain ASCII and agrees with A-Z folding there, so only texts with other
    characters go through ``translate``."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER)
    )


def crc32_bucket(key: str | Column, buckets: int) -> Column:
    """crc32 of the key's text modulo ``buckets`` (null key: null)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(c.cast("string").cast("binary")) % F.lit(buckets)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text that is not null, in order."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: one evaluation,
    however many branches follow, and no recomputing after a lost executor."""
    return cut_lineage(df, f"llm-{name}")


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Scope whose writes drop their shuffle files when they end, not when the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


class Scratch:
    """Written tables of one operator, each removed as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = path = shared_path(self.spark, f"llm-{name}")
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def attach(
    rows: DataFrame, groups: DataFrame, key: Sequence[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` to ``groups`` (one row per key) though a key may hold a third of the rows.

    ``weight`` is a column of ``groups`` with the key's number of rows. Keys
    holding more than a ``1/HOT_PARTS`` share meet a broadcast of at most
    ``HOT_PARTS`` rows, where the rows lie; the others meet in a shuffle join
    in which no key can be large. Both inputs should be written tables: each is
    read twice. Null keys join nothing.
    """
    key = list(key)
    total = groups.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // HOT_PARTS, HOT_LEAST)
    hot = F.broadcast(groups.where(F.col(weight) > F.lit(limit)))
    cold = groups.where(F.col(weight) <= F.lit(limit))
    return rows.join(hot, key, "inner").unionByName(
        rows.join(hot.select(*key), key, "left_anti").join(cold, key, how), allowMissingColumns=False
    )


def with_small_side(rows: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join to a side of fixed-width columns that is often, not always, small.

    The side is counted; up to ``SMALL_ROWS`` rows it is broadcast, so the wide
    rows stay where they are, and beyond that both sides are shuffled.
    """
    if side.count() <= SMALL_ROWS:
        return rows.join(F.broadcast(side), list(on))
    return rows.hint("merge").join(side, list(on))


LINKS = "node long, n long, other long"


def link_rows(nodes: np.ndarray, counts: np.ndarray, edges: Sequence[tuple[int, int]]) -> pd.DataFrame:
    """Rows of ``LINKS``: link counts of the nodes that have any (other null), then forest edges (n 0)."""
    some = np.flatnonzero(counts)
    ends = np.array(edges, np.int64).reshape(-1, 2)
    other = np.concatenate([np.zeros(len(some), np.int64), ends[:, 1]])
    return pd.DataFrame(
        {
            "node": np.concatenate([nodes[some].astype(np.int64), ends[:, 0]]),
            "n": np.concatenate([counts[some], np.zeros(len(ends))]).astype(np.int64),
            "other": pd.arrays.IntegerArray(other, np.arange(len(other)) < len(some)),
        }
    )
