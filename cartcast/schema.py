"""Schemas, behaviour codes, windows and feature names of the interaction log.

Everything here is data, not logic: the operators in ``cartcast.operators`` read
these names so that a change of window set or naming happens in one place.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original pipeline's for equal results.
#   behaviour codes: 1 view, 2 favourite, 3 cart, 4 buy
#   windows (hours before the split): 1, 3, 6, 12, 24, 72, 168, 720
#   windows written as count features: 1, 6, 24, 72, 168, 720
#   random forest: 32 bins, seed 12345, impurity gini, feature subset auto
#   raw log time format: yyyy-MM-dd HH
#   header marker of the raw log and of feature files: first field "user_id"
#   original log: hour 0 is 2014-11-18 00:00; known days 2014-11-18 .. 2014-12-18
# ---------------------------------------------------------------------------
VIEW, FAV, CART, BUY = 1, 2, 3, 4
BEHAVIOURS = {VIEW: "view", FAV: "fav", CART: "cart", BUY: "buy"}
WINDOWS = (1, 3, 6, 12, 24, 72, 168, 720)
COUNT_WINDOWS = (1, 6, 24, 72, 168, 720)
RF_MAX_BINS = 32
RF_SEED = 12345
RF_IMPURITY = "gini"
RF_SUBSET = "auto"
LOG_TIME_FORMAT = "yyyy-MM-dd HH"
HEADER_MARK = "user_id"
ORIGINAL_ORIGIN = "2014-11-18"
ORIGINAL_CALENDAR = ("2014-11-18", "2014-12-18")

# Longest window: the ratio denominators T(b) sum counts over it.
LONG_WINDOW = max(WINDOWS)

# Raw log as text: every field a string, positions as in the CSV file.
RAW_LOG = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("behavior_type", T.StringType()),
        T.StructField("user_geohash", T.StringType()),
        T.StructField("item_category", T.StringType()),
        T.StructField("time", T.StringType()),
    ]
)

# Item catalogue file: only item_id is read.
RAW_ITEMS = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_geohash", T.StringType()),
        T.StructField("item_category", T.StringType()),
    ]
)

def count_col(behaviour: int, window: int) -> str:
    return f"{BEHAVIOURS[behaviour]}_{window}h"


def since_last_col(behaviour: int) -> str:
    return f"since_last_{BEHAVIOURS[behaviour]}"


def span_col(behaviour: int) -> str:
    return f"span_{BEHAVIOURS[behaviour]}"


# Output order of the 47 user-item features (after user_id, item_id).
COUNT_FEATURES = [count_col(b, w) for w in COUNT_WINDOWS for b in BEHAVIOURS]
RECENCY_FEATURES = [since_last_col(b) for b in BEHAVIOURS]
SPAN_FEATURES = [span_col(b) for b in BEHAVIOURS]
RATIO_FEATURES = [
    "view_share",
    "act_per_user_view",
    "buy_share",
    "same_day_share",
    "view_share_24h",
    "view_share_12h",
    "view_share_3h",
    "view_share_1h",
    "item_day_share",
    "buy_day_share",
]
CONVERSION_FEATURES = [
    "conv_view_buy",
    "conv_fav_buy",
    "conv_cart_buy",
    "conv_view_fav",
    "conv_view_cart",
]
UI_FEATURES = (
    COUNT_FEATURES + RECENCY_FEATURES + SPAN_FEATURES + RATIO_FEATURES + CONVERSION_FEATURES
)
UI_KEYS = ["user_id", "item_id"]
UI_COLUMNS = UI_KEYS + UI_FEATURES
assert len(UI_FEATURES) == 47

# Spark types of the 47 features: counts, recency and span are whole hours or
# row counts (BIGINT); the 15 ratios are DOUBLE.
UI_COUNT_TYPES = [
    (name, T.LongType()) for name in COUNT_FEATURES + RECENCY_FEATURES + SPAN_FEATURES
] + [(name, T.DoubleType()) for name in RATIO_FEATURES + CONVERSION_FEATURES]
