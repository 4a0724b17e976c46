"""Stored pair-days: the aggregate all features derive from, kept day by day.

A row of ``pair_days`` belongs to one day and depends on no split, so the table
can be kept: one more day of log aggregates that day alone and replaces that
day's partition (a re-run adds nothing twice), and features for any later split
read the stored rows instead of the log.

The table is partitioned by day and bucketed and sorted by user, so what meets a
user's rows (its totals, then the pairs' aggregate) finds them where they lie:
the pair-day side of the user join is not shuffled, nor are its aggregates.

A user holding more than a ``1/HOT_PARTS`` share of a day's rows would make one
bucket large. Its rows of that day go to a second table, partitioned by day but
not bucketed, whose files tasks share. Fewer than ``HOT_PARTS`` users qualify a
day, so the ids in that table are few; reading takes every row of such a user
out of the buckets (a broadcast of ids) and gives it the salted plan.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.functions.time import DateLike, as_date, midnight, split_hour
from cartcast.operators.features import DAY, I, U, needed_counts, pair_days, ui_features_from_pair_days
from cartcast.operators.skew import DEFAULT_SKEW, SkewConfig
from cartcast.schema import COUNT_WINDOWS
from cartcast.session import cut_lineage, shared_path
from cartcast.sinks.writers import observed

# A user is stored apart on a day with more than this share's reciprocal of the
# day's rows, and more than HOT_LEAST: fewer than HOT_PARTS users a day.
HOT_PARTS = 1000
HOT_LEAST = 100_000


class PairDayStore:
    """Pair-days of a log under ``path`` (a folder all executors share).

    ``origin`` and ``windows`` are those of the features to be read from it and
    must stay the same for the life of the store, as must ``buckets`` (its
    number follows the size of a whole horizon: about 200 MB of pair-days each).
    Opening the same path later, in any session, goes on with it. One writer at
    a time: two that replace the same day at once leave either's rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        origin: DateLike = None,
        buckets: int | None = None,
        windows: Sequence[int] = COUNT_WINDOWS,
        hot_least: int = HOT_LEAST,
    ):
        if origin is None:
            raise ValueError("give the day that hour 0 counts from")
        self.spark, self.origin, self.windows, self.hot_least = spark, as_date(origin), tuple(windows), hot_least
        self.path = path or shared_path(spark, "pair-day-store")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.names = {k: f"cartcast_{k}_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}" for k in ("pair_days", "hot_days")}

    def _open(self, columns: list[tuple[str, str]]) -> None:
        """Register the two tables, with the partitions that lie under ``path``."""
        listed = ", ".join(f"`{c}` {t}" for c, t in columns)
        for kind, name in self.names.items():
            clustered = f"CLUSTERED BY (`{U}`) SORTED BY (`{U}`) INTO {self.buckets} BUCKETS" if kind == "pair_days" else ""
            if self.spark.catalog.tableExists(name):
                continue
            self.spark.sql(
                f"CREATE TABLE {name} ({listed}) USING PARQUET OPTIONS (partitionOverwriteMode 'dynamic') "
                f"PARTITIONED BY (`{DAY}`) {clustered} LOCATION '{self.path}/{kind}'"
            )
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def _columns(self, log: DataFrame) -> list[tuple[str, str]]:
        """Names and types of the table, the partition column last."""
        daily = pair_days(log, self.origin, self.origin, needed_counts(self.windows))
        return [(c, t) for c, t in daily.dtypes if c != DAY] + [(DAY, "date")]

    def add_days(self, log: DataFrame, days: Sequence[DateLike]) -> dict[dt.date, int]:
        """Aggregate ``log``'s rows of ``days`` and replace those days; returns each day's pair-day rows.

        Other days of the log are not read (the cut is on ``ts`` and ``day``)
        and other partitions are left alone. A day of which the log has no rows
        is emptied: the store then says what the log says.
        """
        wanted = sorted({as_date(d) for d in days})
        if not wanted:
            return {}
        columns = self._columns(log)
        self._open(columns)
        names = [c for c, _ in columns]
        rows = self._rows_of(log, wanted).select(*names)
        # Rows per (user, day) against the day's: which users are stored apart.
        per_user = rows.groupBy(DAY, U).agg(F.count(F.lit(1)).alias("n"))
        per_day = rows.groupBy(DAY).agg(F.count(F.lit(1)).alias("all"))
        limit = F.greatest(F.lit(self.hot_least), F.col("all") / HOT_PARTS)
        hot = per_user.join(F.broadcast(per_day), DAY).where(F.col("n") > limit).select(DAY, U)  # a row per day asked for
        marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), [DAY, U], "left")  # < HOT_PARTS ids a day
        cold = marked.where("hot IS NULL").select(*names).repartition(self.buckets, U)
        apart = marked.where("hot").select(*names)
        counts = {d: 0 for d in wanted}
        for kind, part in (("pair_days", cold), ("hot_days", apart)):
            per = {d.isoformat(): F.count_if(F.col(DAY) == F.lit(d)) for d in wanted}
            name = self.names[kind]
            seen = observed(part, lambda df, name=name: df.write.insertInto(name, overwrite=True), **per)
            for d in wanted:
                n = seen[d.isoformat()]
                counts[d] += n
                if not n:
                    self._empty(kind, d, columns)
        return counts

    def _rows_of(self, log: DataFrame, days: list[dt.date]) -> DataFrame:
        """Pair-days of ``days``, written once: the hot users and both tables read them."""
        last = days[-1] + dt.timedelta(days=1)
        ts = F.col("ts")
        between = (ts >= midnight(days[0])) & (ts < midnight(last))
        if DAY in log.columns:  # a log stored by day: only those folders are read
            between = between & F.col(DAY).isin(*days)
        if len(days) != (last - days[0]).days:
            between = between & F.to_date(ts).isin(*days)
        daily = pair_days(log.where(between), last, self.origin, needed_counts(self.windows))
        return cut_lineage(daily, "pair-days-added")

    def _empty(self, kind: str, day: dt.date, columns: list[tuple[str, str]]) -> None:
        """Drop a day's former rows: an overwrite of that partition with none."""
        name = self.names[kind]
        known = f"SHOW PARTITIONS {name} PARTITION (`{DAY}` = DATE'{day}')"
        if self.spark.sql(known).count():
            none = ", ".join(f"CAST(NULL AS {t}) AS `{c}`" for c, t in columns if c != DAY)
            self.spark.sql(f"INSERT OVERWRITE {name} PARTITION (`{DAY}` = DATE'{day}') SELECT {none} WHERE false")

    def days(self) -> list[dt.date]:
        """Days the store holds rows of, by its partitions."""
        held = self.table("pair_days").select(DAY).union(self.table("hot_days").select(DAY)).distinct()
        return sorted(r[DAY] for r in held.collect())

    def table(self, kind: str = "pair_days") -> DataFrame:
        return self.spark.table(self.names[kind])

    def pair_days(self, split: DateLike | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows before ``split``: those of ordinary users, as bucketed, and those of users ever stored apart."""
        cold, hot = self.table("pair_days"), self.table("hot_days")
        if split is not None:
            before = F.col(DAY) < F.lit(as_date(split))
            cold, hot = cold.where(before), hot.where(before)
        ids = F.broadcast(hot.select(U).distinct())  # fewer than HOT_PARTS a day
        order = [U, I, DAY, *[c for c in cold.columns if c not in (U, I, DAY)]]
        apart = hot.unionByName(cold.join(ids, U, "left_semi"))
        return cold.join(ids, U, "left_anti").select(*order), apart.select(*order)

    def features(self, split: DateLike, ratio_mode: str = "exact", skew: SkewConfig = DEFAULT_SKEW) -> DataFrame:
        """C2 as of ``split`` from the stored days: equal to ``ui_features`` of the log they were made from.

        Ordinary users: totals, join and aggregate where the buckets lie, no
        shuffle of pair-days. Users stored apart: the salted plan.
        """
        sh = split_hour(split, self.origin)
        cold, apart = self.pair_days(split)
        own = ui_features_from_pair_days(cold, sh, ratio_mode, materialize=False, windows=self.windows, co_located=True)
        return own.unionByName(ui_features_from_pair_days(apart, sh, ratio_mode, skew, windows=self.windows))

    def drop(self) -> None:
        """Forget the tables in this session's catalogue; the files stay under ``path``."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
