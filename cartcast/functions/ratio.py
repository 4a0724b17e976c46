"""Guarded ratios: 0 when the denominator is not positive.

``mode="exact"`` divides as doubles. ``mode="truncated"`` divides integers first
and widens afterwards, which is what the original features did (mostly 0 or 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_MODES = ("exact", "truncated")


def guarded_ratio(num: Column, den: Column, mode: str = "exact") -> Column:
    if mode not in RATIO_MODES:
        raise ValueError(f"ratio mode must be one of {RATIO_MODES}, got {mode!r}")
    if mode == "exact":
        value = num.cast("double") / den.cast("double")
    else:
        value = F.call_function("div", num.cast("long"), den.cast("long")).cast("double")
    # ``when`` keeps the division from running on a zero denominator, so ANSI
    # mode never sees 0/0.
    return F.when(den > 0, value).otherwise(F.lit(0.0))


def guarded_ratio_sql(num: str, den: str, mode: str = "exact") -> str:
    """``guarded_ratio`` as SQL expression text over column names or expressions."""
    if mode not in RATIO_MODES:
        raise ValueError(f"ratio mode must be one of {RATIO_MODES}, got {mode!r}")
    if mode == "exact":
        value = f"CAST(({num}) AS DOUBLE) / CAST(({den}) AS DOUBLE)"
    else:
        value = f"CAST(CAST(({num}) AS BIGINT) div CAST(({den}) AS BIGINT) AS DOUBLE)"
    return f"CASE WHEN ({den}) > 0 THEN {value} ELSE CAST(0 AS DOUBLE) END"


def try_ratio(num: Column, den: Column) -> Column:
    """Double ratio that is NULL when undefined (metrics with no cases)."""
    return F.try_divide(num.cast("double"), den.cast("double"))
