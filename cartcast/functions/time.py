"""Time model: hour index since an origin day, day key, split hour.

Hours are whole hours counted from midnight of ``origin``. Windows are measured
back from midnight of the split day, so they are hour offsets, not calendar days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = dt.date | str


def as_date(value: DateLike) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value.strip())


def hour_index(ts: Column | str, origin: DateLike) -> Column:
    """Whole hours from ``origin`` 00:00 to the hour of ``ts``.

    ``datediff * 24 + hour`` floors toward minus infinity for times before the
    origin, where a timestamp difference in hours would truncate toward zero.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.datediff(F.to_date(ts), F.lit(as_date(origin))) * 24 + F.hour(ts)


def day_of(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts)


# Fixed value: the raw log time text is "yyyy-MM-dd HH".
LOG_TIME_PATTERN = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2}) ([0-9]{1,2})$"


def parse_log_time(text: Column | str) -> Column:
    """``yyyy-MM-dd HH`` text to TIMESTAMP_NTZ, NULL when malformed or impossible.

    Built from the parsed fields, so no session time zone is involved: parsing
    as a zoned timestamp and casting would move hours that a daylight-saving
    change skips.
    """
    text = F.col(text) if isinstance(text, str) else text
    field = lambda i: F.regexp_extract(text, LOG_TIME_PATTERN, i).try_cast("int")
    return F.try_make_timestamp_ntz(field(1), field(2), field(3), field(4), F.lit(0), F.lit(0))


def midnight(day: DateLike) -> Column:
    """00:00 of ``day`` as a TIMESTAMP_NTZ literal (folds to a constant)."""
    return F.lit(f"{as_date(day).isoformat()} 00:00:00").cast("timestamp_ntz")


def time_range(
    columns: list[str], start: DateLike | None = None, end: DateLike | None = None
) -> Column:
    """``midnight(start) <= ts < midnight(end)`` for a log with ``columns``.

    Written on ``ts`` itself so Parquet skips row groups by their statistics.
    A log stored by day (``write_log_by_day``) also has a ``day`` partition
    column equal to the date of ``ts``; the same bounds on it prune whole
    folders.
    """
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("ts") >= midnight(start))
    if end is not None:
        cond = cond & (F.col("ts") < midnight(end))
    if "day" in columns:
        if start is not None:
            cond = cond & (F.col("day") >= F.lit(as_date(start)))
        if end is not None:
            cond = cond & (F.col("day") < F.lit(as_date(end)))
    return cond


def split_hour(split: DateLike, origin: DateLike) -> int:
    """Hour index of midnight of the split day (computed on the driver)."""
    return (as_date(split) - as_date(origin)).days * 24
