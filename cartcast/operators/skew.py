"""Skew-safe equi-join of a fine table (many rows per key) to a coarse one.

Per-key totals have to meet every fine row of their key: per-user totals meet
each (user, item) row, per-(user, day) totals each (user, item, day) row. A
plain shuffle join sends all rows of one key to one task, so a single user
holding a third of the log would make one task do a third of the work.

Here the heaviest keys are split. ``hot_keys`` picks, from per-key weights,
the keys heavier than ``rows_per_split`` and than a ``1/MAX_HOT_KEYS`` share of
the total weight, so fewer than ``MAX_HOT_KEYS`` keys can qualify: that is the
proven bound of what is broadcast. Each gets a split count.
``salted_join`` then spreads a hot key's fine rows over that many salts by a
hash of the other columns, and repeats its coarse rows once per salt, so each
salt is a separate join key and a separate task. Cold keys keep salt 0 and
join as usual. The result equals the unsalted join: every fine row meets every
coarse row of its key exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLITS = "_n_split"
SALT = "_salt"


# A key is hot only with more than this share's reciprocal of all rows.
MAX_HOT_KEYS = 100_000


@dataclass(frozen=True)
class SkewConfig:
    # Rows of one key that a task takes unsplit. In a table so large that
    # 1/MAX_HOT_KEYS of it is more, that share takes its place.
    rows_per_split: int = 1_000_000

    def __post_init__(self):
        if self.rows_per_split < 1:
            raise ValueError("skew settings must be positive")


DEFAULT_SKEW = SkewConfig()


def key_weights(fine: DataFrame, keys: Sequence[str], name: str = "_weight") -> DataFrame:
    """Rows per key of ``fine`` (partially aggregated before the shuffle)."""
    return fine.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def hot_keys(
    weights: DataFrame, keys: Sequence[str], weight_col: str, cfg: SkewConfig = DEFAULT_SKEW
) -> DataFrame:
    """``keys..., _n_split`` for every key above the threshold.

    The threshold is the larger of ``rows_per_split`` and a ``1/MAX_HOT_KEYS``
    share of the total weight, so the table has fewer than ``MAX_HOT_KEYS``
    rows by arithmetic, and a key is split into at most ``MAX_HOT_KEYS`` parts.
    The total is a scalar subquery, evaluated where the table is used.
    """
    total = weights.agg((F.coalesce(F.sum(weight_col), F.lit(0)) / F.lit(float(MAX_HOT_KEYS))).alias("share")).scalar()
    limit = F.greatest(F.lit(float(cfg.rows_per_split)), total)
    return weights.where(F.col(weight_col) > limit).select(
        *keys, F.ceil(F.col(weight_col) / limit).cast("int").alias(SPLITS)
    )


def salted_join(
    fine: DataFrame,
    coarse: DataFrame,
    on: Sequence[str],
    hot: DataFrame,
    how: str = "inner",
    spread: Sequence[str] | None = None,
    keep_salt: bool = False,
) -> DataFrame:
    """Join ``fine`` to ``coarse`` on ``on``, splitting the keys listed in ``hot``.

    ``spread`` names the fine columns hashed to pick a salt (default: all
    non-key columns); rows that agree on them land on the same salt, so they
    should tell the rows of one key apart. ``how`` is ``inner``, ``left`` or
    ``left_semi`` (``coarse`` is then reduced to its distinct keys, which is all
    a semi-join asks of it).
    ``keep_salt`` keeps the salt column: grouping by the key, the spread columns
    and the salt then needs no further shuffle.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError("salted_join supports inner, left and left_semi joins")
    on = list(on)
    if how == "left_semi":
        coarse = coarse.select(*on).distinct()
    spread = list(spread) if spread else [c for c in fine.columns if c not in on]
    bounded = F.broadcast(hot)  # fewer than MAX_HOT_KEYS rows
    salt = F.when(F.col(SPLITS).isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*spread), F.col(SPLITS).cast("long")).cast("int")
    )
    fine_s = fine.join(bounded, on, "left").select("*", salt.alias(SALT)).drop(SPLITS)
    copies = F.expr(f"explode(sequence(0, coalesce({SPLITS}, 1) - 1))")
    coarse_s = coarse.join(bounded, on, "left").select("*", copies.alias(SALT)).drop(SPLITS)
    joined = fine_s.join(coarse_s, [*on, SALT], how)
    return joined if keep_salt else joined.drop(SALT)


def skew_join(
    fine: DataFrame,
    coarse: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    cfg: SkewConfig = DEFAULT_SKEW,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """``salted_join`` with hot keys found by counting ``fine`` rows per key."""
    hot = hot_keys(key_weights(fine, on), on, "_weight", cfg)
    return salted_join(fine, coarse, on, hot, how, spread)
