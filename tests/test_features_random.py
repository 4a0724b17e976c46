"""C2 and its parts against a small pure-Python restatement, on random logs,
plus the invariants of SURVEY §5."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartcast.functions.time import split_hour
from cartcast.operators import features as Fe
from cartcast.operators.extensions import multi_split_features
from cartcast.operators.skew import SkewConfig
from cartcast.schema import BEHAVIOURS, COUNT_WINDOWS, UI_COLUMNS, UI_FEATURES, count_col
from conftest import LOG_DDL, by_pair

ORIGIN = dt.date(2024, 1, 1)


def random_log(seed, n=400, users=6, items=8, hours=(-30, 800)):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        # a few heavy users and items, like real logs
        u = f"u{min(int(rnd.expovariate(0.6)), users - 1)}"
        i = f"i{min(int(rnd.expovariate(0.4)), items - 1)}"
        h = rnd.randint(*hours)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=rnd.randint(0, 59))
        rows.append((u, i, rnd.randint(1, 4), ts))
    return rows


def brute_features(rows, split, mode="exact"):
    """Direct restatement of the feature definitions."""
    sh = split_hour(split, ORIGIN)

    def hour_of(ts):
        return (ts.date() - ORIGIN).days * 24 + ts.hour

    h = [(u, i, b, hour_of(ts), ts.date()) for u, i, b, ts in rows if hour_of(ts) < sh]
    pairs = defaultdict(list)
    user_rows = defaultdict(list)
    for r in h:
        pairs[(r[0], r[1])].append(r)
        user_rows[r[0]].append(r)

    def c(rs, b, w):
        return sum(1 for r in rs if r[2] == b and sh - r[3] <= w)

    def ratio(num, den):
        if den <= 0:
            return 0.0
        return float(num // den) if mode == "truncated" else num / den

    out = {}
    for (u, i), rs in pairs.items():
        mine = user_rows[u]
        T = {b: sum(c(pairs[(u, j)], b, 720) for j in {r[1] for r in mine}) for b in BEHAVIOURS}
        user_days = {r[4] for r in mine}
        buy_days = {r[4] for r in mine if r[2] == 4}
        item_days = {r[4] for r in rs}
        item_buy_days = {r[4] for r in rs if r[2] == 4}
        same_day = sum(1 for r in mine if r[4] in item_days)
        row = {}
        for w in COUNT_WINDOWS:
            for b in BEHAVIOURS:
                row[count_col(b, w)] = c(rs, b, w)
        for b, name in BEHAVIOURS.items():
            hrs = [r[3] for r in rs if r[2] == b]
            row[f"since_last_{name}"] = sh - (max(hrs) if hrs else 0)
        for b, name in BEHAVIOURS.items():
            hrs = [r[3] for r in rs if r[2] == b]
            row[f"span_{name}"] = (max(hrs) - min(hrs)) if hrs else 0
        c720 = {b: c(rs, b, 720) for b in BEHAVIOURS}
        row["view_share"] = ratio(c720[1], T[1])
        row["act_per_user_view"] = ratio(c720[2] + c720[3] + c720[4], T[1])
        row["buy_share"] = ratio(c720[4], T[4])
        row["same_day_share"] = ratio(len(rs), same_day)
        for w in (24, 12, 3, 1):
            row[f"view_share_{w}h"] = ratio(c(rs, 1, w), T[1])
        row["item_day_share"] = ratio(len(item_days), len(user_days))
        row["buy_day_share"] = ratio(len(item_buy_days), len(buy_days))
        row["conv_view_buy"] = ratio(c720[4], c720[1])
        row["conv_fav_buy"] = ratio(c720[4], c720[2])
        row["conv_cart_buy"] = ratio(c720[4], c720[3])
        row["conv_view_fav"] = ratio(c720[2], c720[1])
        row["conv_view_cart"] = ratio(c720[3], c720[1])
        out[(u, i)] = row
    return out


def assert_same(got, want):
    assert set(got) == set(want)
    for key, row in want.items():
        for col, value in row.items():
            if isinstance(value, str):
                assert got[key][col] == value
            else:
                assert got[key][col] == pytest.approx(value, rel=1e-12, abs=1e-12), (key, col)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("mode", ["exact", "truncated"])
def test_random_logs_match_restatement(spark, seed, mode):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG_DDL)
    for split in ("2024-01-20", "2024-02-01"):
        skew = SkewConfig(rows_per_split=3) if seed == 2 else SkewConfig()
        got = by_pair(Fe.ui_features(log, split, ORIGIN, ratio_mode=mode, skew=skew))
        assert_same(got, brute_features(rows, split, mode))


def test_parts_match_full_features(spark):
    rows = random_log(7)
    log = spark.createDataFrame(rows, LOG_DDL)
    split = "2024-01-25"
    full = by_pair(Fe.ui_features(log, split, ORIGIN))
    counts = by_pair(Fe.window_counts(log, split, ORIGIN))
    rec = by_pair(Fe.recency(log, split, ORIGIN))
    assert set(counts) == set(full) == set(rec)
    for k in full:
        for col, v in counts[k].items():
            assert full[k][col] == v
        for col, v in rec[k].items():
            assert full[k][col] == v
    days = by_pair(Fe.item_day_activity(log, split, ORIGIN, skew=SkewConfig(rows_per_split=1)))
    for (u, i), row in days.items():
        assert row["item_rows"] >= row["item_days"] >= row["item_buy_days"]
        assert row["same_day_rows"] >= row["item_rows"]


def test_multi_split_equals_single_splits(spark):
    rows = random_log(11)
    log = spark.createDataFrame(rows, LOG_DDL)
    splits = ["2024-01-10", "2024-01-25", "2024-02-03"]
    multi = multi_split_features(log, splits, ORIGIN)
    assert multi.columns == ["split_date", *UI_COLUMNS]
    for s in splits:
        one = by_pair(Fe.ui_features(log, s, ORIGIN))
        part = by_pair(multi.where(F.col("split_date") == F.lit(dt.date.fromisoformat(s))).drop("split_date"))
        assert_same(part, one)


def test_invariants(spark):
    rows = random_log(5, n=600)
    log = spark.createDataFrame(rows, LOG_DDL)
    split = "2024-01-28"
    got = by_pair(Fe.ui_features(log, split, ORIGIN))
    share = defaultdict(float)
    for (u, _), r in got.items():
        # windows nest
        for b in BEHAVIOURS:
            seq = [r[count_col(b, w)] for w in COUNT_WINDOWS]
            assert seq == sorted(seq)
        share[u] += r["view_share"]
    totals = by_pair(Fe.user_totals(log, split, ORIGIN), keys=("user_id",))
    for (u,), t in totals.items():
        if t["total_view"] > 0:
            assert share[u] == pytest.approx(1.0)
    # rows at or after the split never change the output
    cut = dt.datetime(2024, 1, 28)
    before = spark.createDataFrame([r for r in rows if r[3] < cut], LOG_DDL)
    assert by_pair(Fe.ui_features(before, split, ORIGIN)) == got


def test_empty_log_keeps_schema(spark):
    empty = spark.createDataFrame([], LOG_DDL)
    df = Fe.ui_features(empty, "2024-01-10", ORIGIN)
    assert df.columns == UI_COLUMNS and df.count() == 0
    assert len(UI_FEATURES) == 47
