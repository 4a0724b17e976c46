"""User-item feature extraction as of a split day (C2) and its parts (A3-A10).

Every feature describes what a user did with an item before midnight of the
split day D. Counts look back over nested hour windows from that midnight;
ratios relate a pair to the user's totals. The plan:

    H  = log rows with ts < D                       (pushed into the scan)
    D1 = H  group by (user, item, day)              day counts per behaviour, counts in
                                                    the day's last 1/3/6/12 h, first/last
                                                    (no column depends on the split)
    U  = D1 group by (user, day), then user         totals, active/buy days,
                                                    rows of each day, an array by day
    J  = D1 join U on user                          salted for hot users; each row
                                                    takes its day's entry of U's array
    F  = J  group by (user, item)                   rolled-up counts, day stats,
                                                    user values carried as max()

No (user, day) join and no second user join are needed. The join's salt is a
function of the item, so grouping by (user, item, salt) gives the pairs where
the join left them, without another shuffle. Every other aggregation combines
map-side before its shuffle, and the one join splits heavy users
(``cartcast.operators.skew``), so one user holding a large share of the log is
spread over many tasks. No step gathers a user's history in one place, unlike
a group-by-user with per-user loops. D1 is read by two branches and U by two,
so both are written once (``cut_lineage``) and the raw log is scanned once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartcast.functions.ratio import guarded_ratio_sql
from cartcast.functions.time import DateLike, day_of, hour_index, split_hour, time_range
from cartcast.operators.skew import DEFAULT_SKEW, SALT, SkewConfig, hot_keys, salted_join
from cartcast.session import cut_lineage
from cartcast.schema import (
    BEHAVIOURS,
    BUY,
    CART,
    COUNT_WINDOWS,
    FAV,
    LONG_WINDOW,
    VIEW,
    count_col,
    since_last_col,
    span_col,
)

U, I = "user_id", "item_id"
B, HOUR, DAY = "behavior_type", "hour_idx", "day"

# (behaviour, window) counts the features need: every behaviour in the written
# windows, plus views in the 3 h and 12 h windows for two ratios.
RATIO_COUNTS = [(b, LONG_WINDOW) for b in BEHAVIOURS] + [(VIEW, w) for w in (1, 3, 12, 24)]
NEEDED_COUNTS = [(b, w) for w in COUNT_WINDOWS for b in BEHAVIOURS] + [(VIEW, 3), (VIEW, 12)]


def needed_counts(windows: Sequence[int]) -> list[tuple[int, int]]:
    """Counts to gather when the count features use ``windows`` (hours)."""
    if any(w < 1 for w in windows):
        raise ValueError("windows are positive numbers of hours")
    return list(dict.fromkeys([(b, w) for w in windows for b in BEHAVIOURS] + RATIO_COUNTS))


def _first(b: int) -> str:
    return f"_first_{b}"


def _last(b: int) -> str:
    return f"_last_{b}"


def _tot(b: int) -> str:
    return f"_total_{b}"


def horizon(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    """Log rows before midnight of ``split`` with hour index and day.

    The cut is written on ``ts`` itself (and on ``day`` for a log stored by
    day) so the Parquet reader skips row groups and folders; ``ts < midnight``
    is the same set as ``hour_idx < split_hour``.
    """
    return log.where(time_range(log.columns, end=split)).select(
        U, I, F.col(B).cast("int").alias(B), hour_index("ts", origin).alias(HOUR), day_of("ts").alias(DAY)
    )


# The split hour: an int, or (several splits in one pass) a SQL expression
# over the grouping columns. The wide expression families below are written
# as SQL expression text: one JVM call each instead of dozens for a composed
# Column, which keeps planning of the 47-column select cheap.
SplitHour = int | str


def _sh(sh: SplitHour) -> str:
    return str(sh) if isinstance(sh, int) else f"({sh})"


def _window_count(b: int, w: int, sh: SplitHour) -> Column:
    return F.expr(f"count_if({B} = {b} AND {_sh(sh)} - {HOUR} <= {w})").alias(count_col(b, w))


def _first_last(b: int) -> list[Column]:
    hour_b = f"CASE WHEN {B} = {b} THEN {HOUR} END"
    return [F.expr(f"min({hour_b})").alias(_first(b)), F.expr(f"max({hour_b})").alias(_last(b))]


def _recency_span(sh: SplitHour) -> list[Column]:
    """``since_last_*`` for the four behaviours, then ``span_*`` (feature order).

    A behaviour that never happened counts as last seen at hour 0, with no span.
    """
    since = [
        F.expr(f"CAST({_sh(sh)} - coalesce({_last(b)}, 0) AS BIGINT)").alias(since_last_col(b))
        for b in BEHAVIOURS
    ]
    span = [
        F.expr(f"CAST(coalesce({_last(b)} - {_first(b)}, 0) AS BIGINT)").alias(span_col(b))
        for b in BEHAVIOURS
    ]
    return since + span


# ---------------------------------------------------------------------------
# Parts, usable on their own
# ---------------------------------------------------------------------------


def window_counts(
    log: DataFrame, split: DateLike, origin: DateLike, windows: Sequence[int] = COUNT_WINDOWS
) -> DataFrame:
    """Rows per (user, item, behaviour) in each nested window of ``windows`` hours."""
    sh = split_hour(split, origin)
    h = horizon(log, split, origin)
    aggs = [_window_count(b, w, sh) for w in windows for b in BEHAVIOURS]
    return h.groupBy(U, I).agg(*aggs)


def recency(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    """Hours since the last, and from first to last, of each behaviour."""
    sh = split_hour(split, origin)
    h = horizon(log, split, origin)
    first_last = h.groupBy(U, I).agg(*[c for b in BEHAVIOURS for c in _first_last(b)])
    return first_last.select(U, I, *_recency_span(sh))


def user_totals(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    """The user's rows of each behaviour in the longest window, over all items."""
    sh = split_hour(split, origin)
    h = horizon(log, split, origin)
    return h.groupBy(U).agg(
        *[_window_count(b, LONG_WINDOW, sh).alias(f"total_{BEHAVIOURS[b]}") for b in BEHAVIOURS]
    )


def user_day_activity(log: DataFrame, split: DateLike, origin: DateLike) -> DataFrame:
    """Days the user was active, and days with each behaviour."""
    h = horizon(log, split, origin)
    per_day = h.groupBy(U, DAY).agg(
        *[F.count_if(F.col(B) == b).alias(f"_n{b}") for b in BEHAVIOURS]
    )
    return per_day.groupBy(U).agg(
        F.count(F.lit(1)).alias("active_days"),
        *[F.count_if(F.col(f"_n{b}") > 0).alias(f"{BEHAVIOURS[b]}_days") for b in BEHAVIOURS],
    )


def item_day_activity(
    log: DataFrame,
    split: DateLike,
    origin: DateLike,
    skew: SkewConfig = DEFAULT_SKEW,
    materialize: bool = True,
) -> DataFrame:
    """Per pair, days the item was touched and bought, its rows, and
    the user's rows on those days (an entry of the user's array of day totals)."""
    daily = pair_days(log, split, origin, counts=[], first_last=False)
    if materialize:
        daily = cut_lineage(daily, "pair_days")
    user = user_days(daily)
    if materialize:
        user = cut_lineage(user, "users")
    hot = hot_keys(user, [U], "_item_days", skew)
    joined = salted_join(daily, user.drop("_item_days"), [U], hot, spread=[I], keep_salt=True)
    return joined.groupBy(U, I, SALT).agg(
        F.count(F.lit(1)).alias("item_days"),
        F.count_if(F.col("_nb") > 0).alias("item_buy_days"),
        F.sum("_n").alias("item_rows"),
        F.sum(_day_rows_of_row()).alias("same_day_rows"),
    ).drop(SALT)


# ---------------------------------------------------------------------------
# The whole feature set
# ---------------------------------------------------------------------------


def _ratios(mode: str) -> list[Column]:
    c, t, L = count_col, _tot, LONG_WINDOW
    specs = [
        ("view_share", c(VIEW, L), t(VIEW)),
        ("act_per_user_view", f"{c(FAV, L)} + {c(CART, L)} + {c(BUY, L)}", t(VIEW)),
        ("buy_share", c(BUY, L), t(BUY)),
        ("same_day_share", "item_rows", "same_day_rows"),
        ("view_share_24h", c(VIEW, 24), t(VIEW)),
        ("view_share_12h", c(VIEW, 12), t(VIEW)),
        ("view_share_3h", c(VIEW, 3), t(VIEW)),
        ("view_share_1h", c(VIEW, 1), t(VIEW)),
        ("item_day_share", "item_days", "active_days"),
        ("buy_day_share", "item_buy_days", "buy_days"),
        ("conv_view_buy", c(BUY, L), c(VIEW, L)),
        ("conv_fav_buy", c(BUY, L), c(FAV, L)),
        ("conv_cart_buy", c(BUY, L), c(CART, L)),
        ("conv_view_fav", c(FAV, L), c(VIEW, L)),
        ("conv_view_cart", c(CART, L), c(VIEW, L)),
    ]
    return [F.expr(guarded_ratio_sql(num, den, mode)).alias(name) for name, num, den in specs]


def pair_days(
    log: DataFrame,
    split: DateLike,
    origin: DateLike,
    counts: list[tuple[int, int]] = NEEDED_COUNTS,
    first_last: bool = True,
) -> DataFrame:
    """Per (user, item, day) before the split: window counts, first and last
    hour of each behaviour, rows and buys. The one pass over the raw log that
    every feature derives from; partially aggregated before its shuffle.
    ``counts`` and ``first_last`` trim it for consumers that need less. Its
    rows do not depend on the split; only which days it holds does."""
    return horizon(log, split, origin).groupBy(U, I, DAY).agg(*daily_aggs(counts, first_last))


def _day_count(b: int) -> str:
    """Column of ``pair_days`` with the day's rows of behaviour ``b``."""
    return "_nb" if b == BUY else f"_n{b}"


def _late_count(b: int, hours: int) -> str:
    """Column of ``pair_days`` with the rows of behaviour ``b`` in the day's last ``hours``."""
    return f"_n{b}_last{hours}"


def window_of_row(b: int, w: int, sh: SplitHour) -> str:
    """SQL text: a ``pair_days`` row's count of behaviour ``b`` in window ``w``
    for the split at hour ``sh``.

    Windows end at the split midnight. A window of ``24 k + r`` hours holds the
    last ``k`` days entirely (the day's midnight is at most ``24 k`` hours
    before the split) and, of the day before those, its last ``r`` hours.
    """
    day_age = f"({_sh(sh)} - _day_idx)"
    whole, rest = w - w % 24, w % 24
    arms = [f"WHEN {day_age} <= {whole} THEN {_day_count(b)}"] if whole else []
    arms += [f"WHEN {day_age} = {whole + 24} THEN {_late_count(b, rest)}"] if rest else []
    return f"CASE {' '.join(arms)} ELSE 0 END"


def daily_aggs(counts: list[tuple[int, int]] = NEEDED_COUNTS, first_last: bool = True) -> list[Column]:
    """Aggregates of a ``pair_days`` row. None depends on the split: per
    behaviour the day's count and its count in the day's last hours (for the
    windows shorter than a day), the hour index of the day's midnight, and
    (``first_last``) first and last hour per behaviour."""
    hour_of_day = f"pmod({HOUR}, 24)"
    late = dict.fromkeys((b, w % 24) for b, w in counts if w % 24)
    aggs = [F.expr(f"count_if({B} = {b} AND {hour_of_day} >= {24 - r})").alias(_late_count(b, r)) for b, r in late]
    aggs += [F.count_if(F.col(B) == b).alias(_day_count(b)) for b in BEHAVIOURS if b != BUY]
    aggs += [F.expr(f"max({HOUR} - {hour_of_day})").alias("_day_idx")]
    if first_last:
        aggs += [c for b in BEHAVIOURS for c in _first_last(b)]
    aggs += [F.count(F.lit(1)).alias("_n"), F.count_if(F.col(B) == BUY).alias("_nb")]
    return aggs


# The user's rows on each day from its first active one (``_first_day``) to its
# last, 0 between: a row finds its day's entry by its offset, in the same time
# whether the log covers a month or years. Made from the day totals in order,
# each preceded by the zeros of the gap before it.
_DAY_ROWS = f"""flatten(transform(_days, (x, k) -> concat(
    array_repeat(0L, CASE WHEN k = 0 THEN 0 ELSE datediff(x.{DAY}, get(_days, k - 1).{DAY}) - 1 END), array(x._ud))))"""
_DAYS = f"sort_array(collect_list(struct({DAY}, _ud))) AS _days"


def _with_day_rows(users: DataFrame) -> DataFrame:
    """Replace ``_days`` (day totals in order) by ``_first_day`` and the array ``_day_rows``."""
    kept = [c for c in users.columns if c != "_days"]
    return users.select(*kept, F.expr(f"get(_days, 0).{DAY}").alias("_first_day"), F.expr(_DAY_ROWS).alias("_day_rows"))


def user_day_totals(daily: DataFrame, sh: SplitHour, group: tuple[str, ...] = ()) -> DataFrame:
    """Per user (A6-A8): active days, buy days, 720 h totals per behaviour,
    the pair-day rows (the split weight of the user), and ``_day_rows``, the
    user's rows on each day from ``_first_day`` on.

    The array is as long as the days from the user's first to its last before
    the split, whatever its rows; it is built by a partial aggregate per
    (user, day), then per user.
    """
    g = list(group)
    per_day = daily.groupBy(*g, U, DAY).agg(
        F.count(F.lit(1)).alias("_items_day"),
        F.sum("_n").alias("_ud"),
        F.sum("_nb").alias("_udb"),
        *[F.expr(f"sum({window_of_row(b, LONG_WINDOW, sh)})").alias(_tot(b)) for b in BEHAVIOURS],
    )
    return per_day.groupBy(*g, U).agg(
        F.count(F.lit(1)).alias("active_days"),
        F.count_if(F.col("_udb") > 0).alias("buy_days"),
        F.sum("_items_day").alias("_item_days"),
        *[F.sum(_tot(b)).alias(_tot(b)) for b in BEHAVIOURS],
        F.expr(_DAYS),
    ).transform(_with_day_rows)


def user_days(daily: DataFrame) -> DataFrame:
    """The part of ``user_day_totals`` that A9/A10 need: ``_day_rows`` and the split weight."""
    per_day = daily.groupBy(U, DAY).agg(F.count(F.lit(1)).alias("_items_day"), F.sum("_n").alias("_ud"))
    return per_day.groupBy(U).agg(F.sum("_items_day").alias("_item_days"), F.expr(_DAYS)).transform(_with_day_rows)


def user_split_totals(daily: DataFrame, splits: Sequence[tuple[str, int]], name: str) -> DataFrame:
    """``user_day_totals`` for several splits, one row per user.

    ``splits``: (date, split hour) of each. ``_splits`` holds a struct per
    split with ``name`` (the date) and the totals as of it; the day totals
    are aggregated once, per (user, day), and each split sums those before it.
    """
    per_day = daily.groupBy(U, DAY).agg(
        F.count(F.lit(1)).alias("_items_day"),
        F.sum("_n").alias("_ud"),
        F.max("_day_idx").alias("_day_idx"),
        *[F.sum(_day_count(b)).alias(_day_count(b)) for b in BEHAVIOURS],
    )
    totals = []
    for date, sh in splits:
        before = f"{DAY} < DATE'{date}'"
        sums = [f"DATE'{date}' AS {name}", f"count_if({before}) AS active_days", f"count_if({before} AND _nb > 0) AS buy_days"]
        sums += [f"sum(CASE WHEN {before} THEN {window_of_row(b, LONG_WINDOW, sh)} ELSE 0 END) AS {_tot(b)}" for b in BEHAVIOURS]
        totals.append(F.expr(f"struct({', '.join(sums)})"))
    users = per_day.groupBy(U).agg(F.sum("_items_day").alias("_item_days"), F.expr(_DAYS), F.array(*totals).alias("_splits"))
    return _with_day_rows(users)


def _day_rows_of_row() -> Column:
    """The user's rows on this row's day: an entry of the user's array of days."""
    return F.expr(f"coalesce(get(_day_rows, datediff({DAY}, _first_day)), 0L)")


def ui_features_from_pair_days(
    daily: DataFrame,
    sh: SplitHour,
    ratio_mode: str = "exact",
    skew: SkewConfig = DEFAULT_SKEW,
    group: tuple[str, ...] = (),
    materialize: bool = True,
    windows: Sequence[int] = COUNT_WINDOWS,
    user_columns: DataFrame | None = None,
    co_located: bool = False,
    splits: Sequence[tuple[str, int]] | None = None,
) -> DataFrame:
    """C2 from the ``pair_days`` table.

    ``group`` adds leading key columns (the split date when several splits
    run in one pass); every aggregation and join then also keys on them, and
    ``sh`` may then be a SQL expression over them. ``daily`` is read twice,
    so pass a written table (``cut_lineage``); ``materialize`` writes the
    per-user table, which the hot-key top-k and the join both read.

    Each pair-day row meets its user's row in one join (salted for hot users,
    weighted by their pair-day rows), takes that day's user total from the
    user's array of days, and a single (user, item) aggregate rolls everything up;
    user-level values ride along as ``max`` of a constant. The salt is a
    function of the item, so grouping by it too needs no second shuffle.

    ``user_columns`` (one row per user, numeric columns) rides along the same
    way, which spares a second join on the user; pairs are then dealt by
    (user, item) for the label join that follows, and users without a row in it
    are left out.

    ``splits`` ((date, split hour) of each, with ``group`` naming the date's
    column and ``sh`` an expression over it) takes ``daily`` as it is, once for
    all: it meets its user's totals of every split in one join, and rows are
    repeated per split only there, so what is shuffled does not grow with them.

    ``co_located`` says that ``daily`` is bucketed by user and that no user is
    hot: a plain join and aggregates, all where the buckets lie.
    """
    g = list(group)
    if splits:
        user = user_split_totals(daily, splits, g[0])
    else:
        user = user_day_totals(daily, sh, group)
    carried = []
    if user_columns is not None:
        carried = [c for c in user_columns.columns if c not in (*g, U)]
        user = user.join(user_columns, [*g, U])
    if materialize:
        user = cut_lineage(user, "users")
    salt = [] if carried or co_located else [SALT]
    if co_located:
        joined = daily.join(user.drop("_item_days"), [*g, U])
    else:
        on = [U] if splits else [*g, U]
        hot_users = hot_keys(user, on, "_item_days", skew)
        joined = salted_join(daily, user.drop("_item_days"), on, hot_users, spread=[I], keep_salt=bool(salt))
    if splits:
        later = F.explode(F.expr(f"filter(_splits, s -> {DAY} < s.{g[0]})")).alias("_split")
        joined = joined.select(*[c for c in joined.columns if c != "_splits"], later).select("*", "_split.*").drop("_split")
    per_user = ["active_days", "buy_days", *[_tot(b) for b in BEHAVIOURS], *carried]
    pair = joined.groupBy(*g, U, I, *salt).agg(
        *[F.expr(f"sum({window_of_row(b, w, sh)})").alias(count_col(b, w)) for b, w in needed_counts(windows)],
        *[F.min(_first(b)).alias(_first(b)) for b in BEHAVIOURS],
        *[F.max(_last(b)).alias(_last(b)) for b in BEHAVIOURS],
        F.count(F.lit(1)).alias("item_days"),
        F.count_if(F.col("_nb") > 0).alias("item_buy_days"),
        F.sum("_n").alias("item_rows"),
        F.sum(_day_rows_of_row()).alias("same_day_rows"),
        *[F.max(c).alias(c) for c in per_user],
    )
    out = [count_col(b, w) for w in windows for b in BEHAVIOURS]  # sums of counts: already BIGINT
    out += _recency_span(sh)
    out += _ratios(ratio_mode)
    return pair.select(*g, U, I, *out, *carried)


def ui_features(
    log: DataFrame,
    split: DateLike,
    origin: DateLike,
    ratio_mode: str = "exact",
    skew: SkewConfig = DEFAULT_SKEW,
    materialize: bool = True,
    windows: Sequence[int] = COUNT_WINDOWS,
) -> DataFrame:
    """The 47 user-item features as of midnight of ``split``.

    ``origin`` is the day hour 0 counts from; ``ratio_mode`` is ``exact`` or
    ``truncated`` (integer division, as the original features). One row per
    (user, item) seen before the split. ``windows`` replaces the hours of the
    count features; the ratios keep theirs. With ``materialize`` (the default)
    the intermediate tables are written before this returns: they feed two
    branches each, and without the cut the log would be read once per branch.
    ``materialize=False`` runs nothing.
    """
    sh = split_hour(split, origin)
    daily = pair_days(log, split, origin, needed_counts(windows))
    if materialize:
        daily = cut_lineage(daily, "pair_days")
    return ui_features_from_pair_days(daily, sh, ratio_mode, skew, materialize=materialize, windows=windows)
