"""DuckDB SQL for every registered query that SQL can express.

Written independently of the Spark plans: the SQL joins separately grouped
pieces where the Spark side rolls up one daily aggregate and salts its joins,
so agreement checks the plan, not just the arithmetic. Column names and types
match the Spark output (counts BIGINT, hour index INT, ratios DOUBLE). Values
are written out here, not taken from the engine, so that a mistake there shows.
"""

from __future__ import annotations

import datetime as dt

# Fixed values, as the survey states them.
VIEW, FAV, CART, BUY = 1, 2, 3, 4
BEHAVIOURS = {1: "view", 2: "fav", 3: "cart", 4: "buy"}
EVENT_BEHAVIOUR = {"view": 1, "click": 2, "signup": 3, "purchase": 4}
CATALOGUE_TYPE = "ECONOMY"
LONG_WINDOW = 720
FEATURE_WINDOWS = (1, 6, 24, 72, 168, 720)
PROFILE_WINDOWS = (24, 168, 720)
ORIGIN, SPLIT, CUTOFF_SPLIT, NEXT_SPLIT = "2024-01-01", "2024-01-30", "2024-02-01", "2024-01-31"
MULTI_SPLITS = ("2024-01-28", "2024-01-29", "2024-01-30")
HOLDOUT_SPLITS = ("2024-01-29", "2024-01-30")


def as_date(day) -> dt.date:
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def split_hour(split, origin) -> int:
    return (as_date(split) - as_date(origin)).days * 24


def count_col(behaviour: int, window: int) -> str:
    return f"{BEHAVIOURS[behaviour]}_{window}h"


COUNT_FEATURES = [count_col(b, w) for w in FEATURE_WINDOWS for b in BEHAVIOURS]
NEEDED_COUNTS = [(b, w) for w in FEATURE_WINDOWS for b in BEHAVIOURS] + [(VIEW, 3), (VIEW, 12)]
UI_FEATURES = [
    *COUNT_FEATURES,
    *[f"since_last_{n}" for n in BEHAVIOURS.values()],
    *[f"span_{n}" for n in BEHAVIOURS.values()],
    "view_share", "act_per_user_view", "buy_share", "same_day_share", "view_share_24h", "view_share_12h",
    "view_share_3h", "view_share_1h", "item_day_share", "buy_day_share",
    "conv_view_buy", "conv_fav_buy", "conv_cart_buy", "conv_view_fav", "conv_view_cart",
]


def profile_columns(other: str) -> list[str]:
    name = other.split("_")[0]
    counts = [count_col(b, w) for w in PROFILE_WINDOWS for b in BEHAVIOURS]
    return [*counts, f"{name}_count", f"{name}_buy_count", "active_days", "buy_days", "conv_view_buy"]


def _case_behaviour() -> str:
    arms = " ".join(f"WHEN '{name}' THEN {code}" for name, code in EVENT_BEHAVIOUR.items())
    return f"CAST(CASE event_type {arms} END AS INTEGER)"


def _types() -> str:
    return ", ".join(f"'{name}'" for name in EVENT_BEHAVIOUR)


ITEM_EXPR = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"

LOG_CTE = f"""log AS (
  SELECT user_id, {ITEM_EXPR} AS item_id, {_case_behaviour()} AS behavior_type, ts
  FROM events
  WHERE event_type IN ({_types()}) AND user_id IS NOT NULL AND ts IS NOT NULL
    AND {ITEM_EXPR} IS NOT NULL
)"""

FILTERED_CTE = f"""flog AS (
  SELECT * FROM log
  WHERE item_id IN (SELECT p_partkey FROM part WHERE p_type = '{CATALOGUE_TYPE}')
)"""


def _hour(origin: str = ORIGIN) -> str:
    return f"CAST(date_diff('day', DATE '{as_date(origin)}', CAST(ts AS DATE)) * 24 + hour(ts) AS INTEGER)"


def _midnight(day) -> str:
    return f"TIMESTAMP '{as_date(day).isoformat()} 00:00:00'"


def horizon_cte(split, name="h", source="log", origin=ORIGIN) -> str:
    return f"""{name} AS (
  SELECT user_id, item_id, behavior_type, {_hour(origin)} AS hour_idx, CAST(ts AS DATE) AS day
  FROM {source} WHERE ts < {_midnight(split)}
)"""


def _ratio(num: str, den: str, mode: str = "exact") -> str:
    if mode == "exact":
        value = f"CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)"
    else:
        value = f"CAST(CAST({num} AS BIGINT) // CAST({den} AS BIGINT) AS DOUBLE)"
    return f"CASE WHEN {den} > 0 THEN {value} ELSE 0.0 END"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _counts_select(sh: str, pairs) -> str:
    return ",\n    ".join(
        f"count(*) FILTER (WHERE behavior_type = {b} AND {sh} - hour_idx <= {w}) AS {count_col(b, w)}"
        for b, w in pairs
    )


def ui_features_sql(split, mode="exact", source="log", multi=None, origin=ORIGIN) -> str:
    """C2 in SQL. ``multi`` (a list of dates) adds a ``split_date`` key."""
    if multi:
        values = ", ".join(f"(DATE '{as_date(d)}')" for d in multi)
        last = max(as_date(d) for d in multi)
        h = f"""h AS (
  SELECT s.split_date, user_id, item_id, behavior_type, {_hour(origin)} AS hour_idx, CAST(ts AS DATE) AS day
  FROM {source}, (VALUES {values}) AS s(split_date)
  WHERE ts < {_midnight(last)} AND CAST(ts AS DATE) < s.split_date
)"""
        g = ["split_date"]
        sh = f"(date_diff('day', DATE '{as_date(origin)}', split_date) * 24)"
    else:
        h = horizon_cte(split, source=source, origin=origin)
        g = []
        sh = str(split_hour(split, origin))
    users = ", ".join([*g, "user_id"])
    pairs = ", ".join([*g, "user_id", "item_id"])
    first_last = ",\n    ".join(
        f"min(CASE WHEN behavior_type = {b} THEN hour_idx END) AS first_{b}, "
        f"max(CASE WHEN behavior_type = {b} THEN hour_idx END) AS last_{b}"
        for b in BEHAVIOURS
    )
    pair = f"""pair AS (
  SELECT {pairs},
    {_counts_select(sh, NEEDED_COUNTS)},
    {first_last},
    count(*) AS item_rows
  FROM h GROUP BY {pairs}
)"""
    pd = f"""pd AS (
  SELECT {pairs}, day, count(*) FILTER (WHERE behavior_type = {BUY}) AS nb
  FROM h GROUP BY {pairs}, day
)"""
    ud = f"""ud AS (
  SELECT {users}, day, count(*) AS ud, count(*) FILTER (WHERE behavior_type = {BUY}) AS udb
  FROM h GROUP BY {users}, day
)"""
    on_ud = " AND ".join(f"pd.{c} = ud.{c}" for c in [*g, "user_id", "day"])
    pday = f"""pday AS (
  SELECT {", ".join(f"pd.{c}" for c in [*g, "user_id", "item_id"])},
    count(*) AS item_days, count(*) FILTER (WHERE pd.nb > 0) AS item_buy_days,
    CAST(sum(ud.ud) AS BIGINT) AS same_day_rows
  FROM pd JOIN ud ON {on_ud}
  GROUP BY {", ".join(f"pd.{c}" for c in [*g, "user_id", "item_id"])}
)"""
    usr = f"""usr AS (
  SELECT {users}, count(*) AS active_days, count(*) FILTER (WHERE udb > 0) AS buy_days
  FROM ud GROUP BY {users}
)"""
    tot = f"""tot AS (
  SELECT {users}, {", ".join(f"CAST(sum({count_col(b, LONG_WINDOW)}) AS BIGINT) AS t{b}" for b in BEHAVIOURS)}
  FROM pair GROUP BY {users}
)"""
    L = LONG_WINDOW
    c = lambda b, w: f"p.{count_col(b, w)}"
    r = lambda n, d: _ratio(n, d, mode)
    ratios = [
        (r(c(VIEW, L), "t1"), "view_share"),
        (r(f"({c(FAV, L)} + {c(CART, L)} + {c(BUY, L)})", "t1"), "act_per_user_view"),
        (r(c(BUY, L), "t4"), "buy_share"),
        (r("p.item_rows", "same_day_rows"), "same_day_share"),
        (r(c(VIEW, 24), "t1"), "view_share_24h"),
        (r(c(VIEW, 12), "t1"), "view_share_12h"),
        (r(c(VIEW, 3), "t1"), "view_share_3h"),
        (r(c(VIEW, 1), "t1"), "view_share_1h"),
        (r("item_days", "active_days"), "item_day_share"),
        (r("item_buy_days", "buy_days"), "buy_day_share"),
        (r(c(BUY, L), c(VIEW, L)), "conv_view_buy"),
        (r(c(BUY, L), c(FAV, L)), "conv_fav_buy"),
        (r(c(BUY, L), c(CART, L)), "conv_cart_buy"),
        (r(c(FAV, L), c(VIEW, L)), "conv_view_fav"),
        (r(c(CART, L), c(VIEW, L)), "conv_view_cart"),
    ]
    names = dict(BEHAVIOURS)
    cols = [f"p.{k}" for k in [*g, "user_id", "item_id"]]
    cols += [f"CAST(p.{n} AS BIGINT) AS {n}" for n in COUNT_FEATURES]
    sh_p = sh.replace("split_date", "p.split_date")
    cols += [f"CAST({sh_p} - coalesce(p.last_{b}, 0) AS BIGINT) AS since_last_{names[b]}" for b in BEHAVIOURS]
    cols += [f"CAST(coalesce(p.last_{b} - p.first_{b}, 0) AS BIGINT) AS span_{names[b]}" for b in BEHAVIOURS]
    cols += [f"{expr} AS {name}" for expr, name in ratios]
    jp = " AND ".join(f"p.{k} = pday.{k}" for k in [*g, "user_id", "item_id"])
    ju = " AND ".join(f"p.{k} = usr.{k}" for k in [*g, "user_id"])
    jt = " AND ".join(f"p.{k} = tot.{k}" for k in [*g, "user_id"])
    ctes = [LOG_CTE] + ([FILTERED_CTE] if source == "flog" else []) + [h, pair, pd, ud, pday, usr, tot]
    return _with(*ctes) + (
        f"SELECT {', '.join(cols)}\nFROM pair p JOIN pday ON {jp} JOIN usr ON {ju} JOIN tot ON {jt}"
    )


def profile_sql(
    split, key: str, other: str, prefix: str = "", origin=ORIGIN, h="h", multi: bool = False
) -> tuple[list[str], str]:
    """E4 (user or item profile) as CTEs plus the final SELECT. With ``multi``
    the rows of ``h`` carry ``split_date`` and every group keys on it."""
    sh = f"(date_diff('day', DATE '{as_date(origin)}', split_date) * 24)" if multi else split_hour(split, origin)
    k = f"split_date, {key}" if multi else key
    name = other.split("_")[0]
    t = f"{prefix or key[0]}"
    counts = ",\n    ".join(
        f"count(*) FILTER (WHERE behavior_type = {b} AND {sh} - hour_idx <= {w}) AS {prefix}{BEHAVIOURS[b]}_{w}h"
        for w in PROFILE_WINDOWS
        for b in BEHAVIOURS
    )
    ctes = [
        f"{t}c AS (SELECT {k}, {counts} FROM {h} GROUP BY {k})",
        f"""{t}o AS (
  SELECT {k}, count(*) AS {prefix}{name}_count, count(*) FILTER (WHERE nb > 0) AS {prefix}{name}_buy_count
  FROM (SELECT {k}, {other}, count(*) FILTER (WHERE behavior_type = {BUY}) AS nb FROM {h} GROUP BY {k}, {other})
  GROUP BY {k}
)""",
        f"""{t}d AS (
  SELECT {k}, count(*) AS {prefix}active_days, count(*) FILTER (WHERE nb > 0) AS {prefix}buy_days
  FROM (SELECT {k}, day, count(*) FILTER (WHERE behavior_type = {BUY}) AS nb FROM {h} GROUP BY {k}, day)
  GROUP BY {k}
)""",
    ]
    conv = _ratio(f"{t}c.{prefix}buy_720h", f"{t}c.{prefix}view_720h")
    select = (
        f"SELECT {t}c.*, {t}o.* EXCLUDE ({k}), {t}d.* EXCLUDE ({k}), {conv} AS {prefix}conv_view_buy "
        f"FROM {t}c JOIN {t}o USING ({k}) JOIN {t}d USING ({k})"
    )
    return ctes, select


def training_multi_split_sql(splits, label_days) -> str:
    """E1 + C4: training rows for several split days, keyed by ``split_date``."""
    ui = ui_features_sql(None, multi=splits)
    head, final = ui[len("WITH ") :].rsplit("\nSELECT ", 1)
    ctes = [head, f"ui AS (SELECT {final})"]
    uc, us = profile_sql(None, "user_id", "item_id", prefix="u_", multi=True)
    ic, is_ = profile_sql(None, "item_id", "user_id", prefix="i_", multi=True)
    ctes += uc + [f"uf AS ({us})"] + ic + [f"itf AS ({is_})"]
    days = ", ".join(f"DATE '{as_date(d)}'" for d in label_days)
    ctes.append(f"""lb AS (
  SELECT DISTINCT CAST(ts AS DATE) AS split_date, user_id, item_id FROM log
  WHERE behavior_type = {BUY} AND CAST(ts AS DATE) IN ({days})
)""")
    return _with(*ctes) + (
        "SELECT ui.*, uf.* EXCLUDE (split_date, user_id), itf.* EXCLUDE (split_date, item_id),\n"
        f"  CAST(CASE WHEN ui.split_date NOT IN ({days}) THEN NULL WHEN lb.user_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label\n"
        "FROM ui JOIN uf USING (split_date, user_id) JOIN itf USING (split_date, item_id)\n"
        "LEFT JOIN lb ON ui.split_date = lb.split_date AND ui.user_id = lb.user_id AND ui.item_id = lb.item_id"
    )


def labels_cte(day, name="lb", source="log") -> str:
    d = as_date(day)
    nxt = d.fromordinal(d.toordinal() + 1)
    return f"""{name} AS (
  SELECT DISTINCT user_id, item_id FROM {source}
  WHERE behavior_type = {BUY} AND ts >= {_midnight(d)} AND ts < {_midnight(nxt)}
)"""


def feature_join_sql(split, labelled=True) -> str:
    ctes, final = feature_join_parts(split, labelled)
    return _with(*ctes) + final


VECTOR_COLUMNS = (
    UI_FEATURES + [f"u_{c}" for c in profile_columns("item_id")] + [f"i_{c}" for c in profile_columns("user_id")]
)


def libsvm_array_sql(split, labelled: bool) -> str:
    """Label (0 where there is none) and the values at every position of each vector."""
    ctes, final = feature_join_parts(split, labelled)
    label = "CAST(label AS DOUBLE)" if labelled else "CAST(0 AS DOUBLE)"
    parts = ", ".join(f"CAST({c} AS DOUBLE) AS f{k:02d}" for k, c in enumerate(VECTOR_COLUMNS))
    return _with(*ctes, f"fj AS ({final})") + f"SELECT {label} AS label, {parts} FROM fj"


def libsvm_sql(split) -> str:
    """Label, vector width and the in-order sum of each training vector."""
    ctes, final = feature_join_parts(split, True)
    cols = VECTOR_COLUMNS
    total = " + ".join(["CAST(0 AS DOUBLE)"] + [f"CAST({c} AS DOUBLE)" for c in cols])
    return _with(*ctes, f"fj AS ({final})") + (
        f"SELECT CAST(label AS DOUBLE) AS label, CAST({len(cols)} AS INTEGER) AS width, {total} AS feature_sum FROM fj"
    )


def feature_join_parts(split, labelled=True) -> tuple[list[str], str]:
    ui = ui_features_sql(split)
    ui_body = ui[len("WITH ") :]
    # Reuse the C2 CTEs and wrap the final SELECT as another CTE.
    head, final = ui_body.rsplit("\nSELECT ", 1)
    ctes = [head, f"ui AS (SELECT {final})"]
    uc, us = profile_sql(split, "user_id", "item_id", prefix="u_")
    ic, is_ = profile_sql(split, "item_id", "user_id", prefix="i_")
    ctes += uc + [f"uf AS ({us})"] + ic + [f"itf AS ({is_})"]
    select = "SELECT ui.*, uf.* EXCLUDE (user_id), itf.* EXCLUDE (item_id)"
    joins = "FROM ui JOIN uf USING (user_id) JOIN itf USING (item_id)"
    if labelled:
        ctes.append(labels_cte(split))
        select += ", CAST(CASE WHEN lb.user_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS label"
        joins += " LEFT JOIN lb ON ui.user_id = lb.user_id AND ui.item_id = lb.item_id"
    return ctes, select + "\n" + joins


def _sql() -> dict[str, str]:
    S, C = SPLIT, CUTOFF_SPLIT
    sh = split_hour(S, ORIGIN)
    names = dict(BEHAVIOURS)
    q: dict[str, str] = {}
    q["filter_log"] = _with(LOG_CTE, FILTERED_CTE) + "SELECT user_id, item_id, behavior_type, ts FROM flog"
    q["stream_filter_log"] = q["filter_log"]
    q["filter_count"] = _with(LOG_CTE, FILTERED_CTE) + "SELECT count(*) AS n_rows FROM flog"
    q["log_projection"] = _with(LOG_CTE) + (
        f"SELECT user_id, item_id, behavior_type, {_hour()} AS hour_idx, CAST(ts AS DATE) AS day FROM log"
    )
    q["log_rejects"] = f"""SELECT event_id, CASE
  WHEN event_type IS NULL OR event_type NOT IN ({_types()}) THEN 'bad behavior_type'
  WHEN user_id IS NULL THEN 'missing user_id'
  WHEN {ITEM_EXPR} IS NULL THEN 'missing item_id'
  WHEN ts IS NULL THEN 'bad time' END AS reject_reason
FROM events
WHERE event_type IS NULL OR event_type NOT IN ({_types()}) OR user_id IS NULL
   OR {ITEM_EXPR} IS NULL OR ts IS NULL"""
    q["before_split"] = _with(LOG_CTE, horizon_cte(S)) + "SELECT * FROM h"
    q["ui_counts"] = _with(LOG_CTE, horizon_cte(S)) + (
        "SELECT user_id, item_id,\n    "
        + _counts_select(str(sh), [(b, w) for w in (1, 6, 24, 72, 168, 720) for b in BEHAVIOURS])
        + "\nFROM h GROUP BY user_id, item_id"
    )
    rec = ", ".join(
        [f"CAST({sh} - coalesce(max(CASE WHEN behavior_type = {b} THEN hour_idx END), 0) AS BIGINT) AS since_last_{names[b]}" for b in BEHAVIOURS]
        + [f"CAST(coalesce(max(CASE WHEN behavior_type = {b} THEN hour_idx END) - min(CASE WHEN behavior_type = {b} THEN hour_idx END), 0) AS BIGINT) AS span_{names[b]}" for b in BEHAVIOURS]
    )
    q["ui_recency"] = _with(LOG_CTE, horizon_cte(S)) + f"SELECT user_id, item_id, {rec} FROM h GROUP BY user_id, item_id"
    days = ", ".join(f"count(*) FILTER (WHERE n{b} > 0) AS {names[b]}_days" for b in BEHAVIOURS)
    per_day = ", ".join(f"count(*) FILTER (WHERE behavior_type = {b}) AS n{b}" for b in BEHAVIOURS)
    q["user_day_activity"] = _with(LOG_CTE, horizon_cte(S)) + (
        f"SELECT user_id, count(*) AS active_days, {days} FROM "
        f"(SELECT user_id, day, {per_day} FROM h GROUP BY user_id, day) GROUP BY user_id"
    )
    q["ui_day_activity"] = _with(
        LOG_CTE,
        horizon_cte(S),
        f"pd AS (SELECT user_id, item_id, day, count(*) AS n, count(*) FILTER (WHERE behavior_type = {BUY}) AS nb FROM h GROUP BY user_id, item_id, day)",
        "ud AS (SELECT user_id, day, count(*) AS ud FROM h GROUP BY user_id, day)",
    ) + (
        "SELECT pd.user_id, pd.item_id, count(*) AS item_days, count(*) FILTER (WHERE nb > 0) AS item_buy_days, "
        "CAST(sum(n) AS BIGINT) AS item_rows, CAST(sum(ud.ud) AS BIGINT) AS same_day_rows "
        "FROM pd JOIN ud ON pd.user_id = ud.user_id AND pd.day = ud.day GROUP BY pd.user_id, pd.item_id"
    )
    totals = ", ".join(
        f"count(*) FILTER (WHERE behavior_type = {b} AND {sh} - hour_idx <= {LONG_WINDOW}) AS total_{names[b]}"
        for b in BEHAVIOURS
    )
    q["user_totals"] = _with(LOG_CTE, horizon_cte(S)) + f"SELECT user_id, {totals} FROM h GROUP BY user_id"
    q["ui_features"] = ui_features_sql(S)
    q["ui_features_truncated"] = ui_features_sql(S, mode="truncated")
    q["ui_features_720_cutoff"] = ui_features_sql(C)
    q["ui_features_catalogue"] = ui_features_sql(S, source="flog")
    q["labels"] = _with(LOG_CTE, labels_cte(S)) + "SELECT * FROM lb"
    q["positive_count"] = _with(LOG_CTE, horizon_cte(S), labels_cte(S)) + (
        "SELECT count(*) FILTER (WHERE lb.user_id IS NOT NULL) AS positives, count(*) AS rows "
        "FROM (SELECT DISTINCT user_id, item_id FROM h) p "
        "LEFT JOIN lb ON p.user_id = lb.user_id AND p.item_id = lb.item_id"
    )
    uc, us = profile_sql(S, "user_id", "item_id")
    q["user_features"] = _with(LOG_CTE, horizon_cte(S), *uc) + us
    ic, is_ = profile_sql(S, "item_id", "user_id")
    q["item_features"] = _with(LOG_CTE, horizon_cte(S), *ic) + is_
    q["feature_join_labelled"] = feature_join_sql(S, labelled=True)
    q["feature_join_unlabelled"] = feature_join_sql(C, labelled=False)
    q["libsvm_roundtrip"] = libsvm_sql(S)
    q["training_multi_split"] = training_multi_split_sql(HOLDOUT_SPLITS, HOLDOUT_SPLITS)
    q["training_multi_split_partial_labels"] = training_multi_split_sql((S, C), (S,))
    q["multi_split_features"] = ui_features_sql(None, multi=MULTI_SPLITS)
    q["log_by_day"] = _with(LOG_CTE) + "SELECT user_id, item_id, behavior_type, ts, CAST(ts AS DATE) AS day FROM log"
    q["eval_metrics"] = _with(LOG_CTE, horizon_cte(S), labels_cte(S)) + f"""SELECT true_pos, pred_pos, actual_pos, rows,
  CASE WHEN pred_pos = 0 THEN NULL ELSE CAST(true_pos AS DOUBLE) / pred_pos END AS precision,
  CASE WHEN actual_pos = 0 THEN NULL ELSE CAST(true_pos AS DOUBLE) / actual_pos END AS recall,
  CASE WHEN pred_pos = 0 OR actual_pos = 0 OR true_pos = 0 THEN NULL
       ELSE (2.0 * (CAST(true_pos AS DOUBLE) / pred_pos) * (CAST(true_pos AS DOUBLE) / actual_pos))
            / ((CAST(true_pos AS DOUBLE) / pred_pos) + (CAST(true_pos AS DOUBLE) / actual_pos)) END AS f1
FROM (
  SELECT count(*) FILTER (WHERE pred = 1 AND lbl = 1) AS true_pos, count(*) FILTER (WHERE pred = 1) AS pred_pos,
         count(*) FILTER (WHERE lbl = 1) AS actual_pos, count(*) AS rows
  FROM (
    SELECT CASE WHEN p.buys > 0 THEN 1 ELSE 0 END AS pred, CASE WHEN lb.user_id IS NULL THEN 0 ELSE 1 END AS lbl
    FROM (SELECT user_id, item_id, count(*) FILTER (WHERE behavior_type = {BUY} AND {sh} - hour_idx <= {LONG_WINDOW}) AS buys
          FROM h GROUP BY user_id, item_id) p
    LEFT JOIN lb ON p.user_id = lb.user_id AND p.item_id = lb.item_id
  )
)"""
    q["ui_features_salted"] = q["ui_features"]
    q["ui_features_csv"] = q["ui_features"]
    q["feature_join_salted"] = q["feature_join_labelled"]
    q["feature_join_csv"] = q["feature_join_labelled"]
    q["libsvm_roundtrip_array"] = libsvm_array_sql(S, True)
    q["libsvm_unlabelled"] = libsvm_array_sql(C, False)

    # Windows given by the caller: 36 h ends inside a day.
    q["ui_counts_windows"] = _with(LOG_CTE, horizon_cte(S)) + (
        "SELECT user_id, item_id,\n    "
        + _counts_select(str(sh), [(b, w) for w in (5, 24, 36, 100) for b in BEHAVIOURS])
        + "\nFROM h GROUP BY user_id, item_id"
    )

    # The text path. Times in the raw log are whole hours.
    q["log_csv_roundtrip"] = _with(LOG_CTE) + (
        "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, behavior_type, "
        "date_trunc('hour', ts) AS ts FROM log"
    )
    # Error events are written as bad lines: which kind, the event id says.
    q["log_csv_rejects"] = f"""SELECT
  CASE WHEN kind IN (1, 2) THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN kind IN (1, 3) THEN NULL ELSE CAST(item_id AS VARCHAR) END AS item_id,
  CASE kind WHEN 0 THEN 'bad behavior_type' WHEN 1 THEN 'blank line' WHEN 2 THEN 'missing user_id'
            WHEN 3 THEN 'missing item_id' ELSE 'bad time' END AS reject_reason
FROM (
  SELECT event_id % 5 AS kind, user_id, {ITEM_EXPR} AS item_id FROM events
  WHERE event_type = 'error' AND user_id IS NOT NULL AND {ITEM_EXPR} IS NOT NULL
)"""
    q["catalogue_csv"] = f"SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS item_id FROM part WHERE p_type = '{CATALOGUE_TYPE}'"
    q["filter_log_csv"] = _with(LOG_CTE, FILTERED_CTE) + (
        "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, behavior_type, "
        "date_trunc('hour', ts) AS ts FROM flog"
    )
    q["feature_join_text_columns"] = _with(LOG_CTE, horizon_cte(S)) + (
        "SELECT CAST(h.user_id AS VARCHAR) AS user_id, CAST(h.item_id AS VARCHAR) AS item_id, p.p_brand AS i_brand, "
        "CAST(9007199254740992 + p.p_partkey AS VARCHAR) AS i_code, CAST(count(*) AS BIGINT) AS n "
        "FROM h JOIN part p ON p.p_partkey = h.item_id GROUP BY ALL"
    )

    q["filter_log_split"] = q["filter_log"]
    q["filter_count_observed"] = q["filter_count"]
    q["pair_day_store"] = q["pair_day_store_hot"] = q["ui_features"]
    q["training_table_csv"] = q["feature_join_labelled"]
    ctes, final = feature_join_parts(S, True)
    q["training_counts_observed"] = _with(*ctes, f"fj AS ({final})") + (
        "SELECT count(*) FILTER (WHERE label = 1) AS positives, count(*) AS rows FROM fj"
    )
    q["log_split_one_pass"] = f"""SELECT user_id, item_id, behavior_type, ts, CAST(NULL AS VARCHAR) AS reject_reason
FROM ({q["log_csv_roundtrip"]})
UNION ALL SELECT user_id, item_id, NULL, NULL, reject_reason FROM ({q["log_csv_rejects"]})"""
    q["feature_column_kinds"] = _with(LOG_CTE, horizon_cte(S), """j AS (
  SELECT h.user_id, h.item_id, count(*) AS n, any_value(p_size) AS size, any_value(p_type) AS type, any_value(p_brand) AS brand
  FROM h JOIN part p ON p.p_partkey = h.item_id GROUP BY ALL
)""") + """SELECT 'n' AS column, 'number' AS kind, count(*) AS n_values, CAST(0 AS BIGINT) AS n_text FROM j
UNION ALL SELECT 'i_brand', 'text', count(*), count(*) FILTER (WHERE TRY_CAST(brand AS DOUBLE) IS NULL) FROM j
UNION ALL SELECT 'i_price', 'number', count(*), CAST(0 AS BIGINT) FROM j
UNION ALL SELECT 'i_mixed', 'text', count(*), count(*) FILTER (WHERE size > 25) FROM j
UNION ALL SELECT 'i_nothing', 'empty', CAST(0 AS BIGINT), CAST(0 AS BIGINT)"""

    # Models against a rule that SQL knows: label 1 where the pair was viewed in 720 h.
    rule = f"count(*) FILTER (WHERE behavior_type = {VIEW} AND {{sh}} - hour_idx <= {LONG_WINDOW}) > 0"
    test = split_hour(S, ORIGIN)
    q["gbt_rule_holdout"] = q["rf_rule_holdout"] = q["rf_rare_rule_holdout"] = _with(LOG_CTE, horizon_cte(S)) + (
        "SELECT count(*) FILTER (WHERE y) AS true_pos, count(*) FILTER (WHERE y) AS pred_pos, "
        "count(*) FILTER (WHERE y) AS actual_pos, count(*) AS rows, "
        "CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1 "
        f"FROM (SELECT {rule.format(sh=test)} AS y FROM h GROUP BY user_id, item_id)"
    )
    q["submission_rule"] = _with(LOG_CTE, horizon_cte(NEXT_SPLIT)) + (
        f"SELECT user_id, item_id FROM h GROUP BY user_id, item_id HAVING {rule.format(sh=split_hour(NEXT_SPLIT, ORIGIN))}"
    )
    return q


ORACLE_SQL = _sql()
