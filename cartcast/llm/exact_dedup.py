"""Exact deduplication against a persistent digest index [native].

The index is a table of one row per distinct text, bucketed and sorted by the
text's SHA-256. A new batch is reduced to its distinct digests (partial
aggregation, so copies never meet in one task), anti-joined to the index by a
sort-merge join in which the index needs no shuffle, and what is left is
appended. Only built-in DataFrame operations are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.llm.common import HOT_LEAST, HOT_PARTS, ascii_lower, attach, staged
from cartcast.session import shared_path

_DIGEST, _ID, _KEEP, _SIZE = "__xd_digest", "__xd_id", "__xd_keep", "__xd_size"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and SHA-256 of the text, A-Z lower-cased; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias(_ID), F.unhex(F.sha2(ascii_lower(text_col), 256)).alias(_DIGEST)
    )


class DigestIndex:
    """Distinct digests seen so far, with the id that stays for each.

    ``path`` is a folder all executors share; opening the same path later, in
    any session, goes on with the index as it was left. ``buckets`` is fixed
    when the index is made. An append is one Spark write job, so a failed one
    leaves nothing; repeating a batch appends nothing new.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "llm-digest-index")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"cartcast_digests_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_DIGEST} BINARY, {_KEEP} BIGINT) USING PARQUET "
            f"CLUSTERED BY ({_DIGEST}) SORTED BY ({_DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        """Deduplicate a batch; returns its digests and its groups, both written tables.

        Groups: digest, the id that stays (of the index where the text was
        known before, else the batch's largest; null ids lose to any other) and
        the group's size in this batch.
        """
        rows = staged(digests(docs, id_col, text_col), "digests")
        batch = staged(
            rows.groupBy(_DIGEST).agg(F.max(_ID).alias(_KEEP), F.count(F.lit(1)).alias(_SIZE)), "digest-groups"
        )
        fresh = batch.hint("merge").join(self.table(), _DIGEST, "left_anti").select(_DIGEST, _KEEP)
        fresh.repartition(self.buckets, _DIGEST).write.insertInto(self.name)
        groups = batch.drop(_KEEP).hint("merge").join(self.table(), _DIGEST)
        return rows, staged(groups, "digest-known")


def exact_duplicates(
    docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays, or the one the index
    already holds. Rows that repeat an id with an equal text are all marked as
    the kept one. An empty table gives no rows; other columns are ignored.
    """
    index = index or DigestIndex(docs.sparkSession)
    rows, groups = index.add(docs, id_col, text_col)
    return attach(rows, groups, [_DIGEST], _SIZE).select(
        F.col(_ID).alias(id_col),
        F.col(_KEEP).alias("keep_id"),
        F.col(_SIZE).alias("group_size"),
        F.col(_ID).eqNullSafe(F.col(_KEEP)).alias("kept"),
        F.lower(F.hex(_DIGEST)).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that stay, all columns kept, one row for each distinct text.

    Copies are dropped before the shuffle wherever their group is large (a
    broadcast of the at most ``HOT_PARTS`` large groups tells them), so no task
    gathers a group. Rows that repeat id and text leave one row.
    """
    index = index or DigestIndex(docs.sparkSession)
    _, groups = index.add(docs, id_col, text_col)
    keyed = docs.withColumns(
        {_DIGEST: F.unhex(F.sha2(ascii_lower(text_col), 256)), _ID: F.col(id_col).cast("long")}
    )
    total = groups.agg(F.sum(_SIZE)).first()[0] or 0
    hot = groups.where(F.col(_SIZE) > max(total // HOT_PARTS, HOT_LEAST))
    hot = hot.select(F.col(_DIGEST), F.col(_KEEP).alias("__xd_hot"), F.lit(True).alias("__xd_is_hot"))
    early = keyed.join(F.broadcast(hot), _DIGEST, "left").where(
        F.col("__xd_is_hot").isNull() | F.col(_ID).eqNullSafe(F.col("__xd_hot"))
    )
    stays = groups.select(_DIGEST, F.col(_KEEP).alias("__xd_stays"))
    late = early.hint("merge").join(stays, _DIGEST).where(F.col(_ID).eqNullSafe(F.col("__xd_stays")))
    return late.dropDuplicates([_DIGEST]).select(*docs.columns)
