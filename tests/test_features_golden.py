"""C2 against the hand-computed golden tables of FIXTURES.md §3."""

from __future__ import annotations

import pytest

from cartcast.operators.features import ui_features
from cartcast.operators.skew import SkewConfig
from cartcast.schema import COUNT_FEATURES, RATIO_FEATURES, CONVERSION_FEATURES, RECENCY_FEATURES, SPAN_FEATURES, UI_COLUMNS
from conftest import ORIGIN, by_pair

RATIOS = RATIO_FEATURES + CONVERSION_FEATURES

# split 12-16: counts (v,f,c,b per window 1,6,24,72,168,720), since-last, span,
# exact ratios, truncated ratios
SPLIT_1216 = {
    ("u1", "i1"): (
        "1,0,0,1 2,0,0,1 2,0,0,1 2,0,0,1 2,0,1,1 3,0,1,1",
        "1,672,136,1",
        "666,0,0,0",
        [0.75, 0.5, 1, 0.8333, 0.5, 0.5, 0.5, 0.25, 0.75, 1, 0.3333, 0, 1, 0, 0.3333],
        [0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0],
    ),
    ("u1", "i2"): (
        "0,0,0,0 0,0,0,0 1,0,0,0 1,1,0,0 1,1,0,0 1,1,0,0",
        "10,38,672,672",
        "0,0,0,0",
        [0.25, 0.25, 0, 0.4, 0.25, 0.25, 0, 0, 0.5, 0, 0, 0, 0, 1, 0],
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0],
    ),
    ("u2", "i1"): (
        "0,0,0,0 1,0,0,0 1,0,0,0 1,0,0,0 1,0,0,0 1,0,0,0",
        "2,672,672,672",
        "0,0,0,0",
        [1, 0, 0, 1, 1, 1, 1, 0, 0.5, 0, 0, 0, 0, 0, 0],
        [1, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0],
    ),
    ("u2", "i2"): (
        "0,0,0,0 0,0,0,0 0,0,0,0 0,0,0,0 0,0,0,0 0,0,0,1",
        "672,672,672,355",
        "0,0,0,0",
        [0, 1, 1, 1, 0, 0, 0, 0, 0.5, 1, 0, 0, 0, 0, 0],
        [0, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0],
    ),
}

# split 12-19: 168h counts, 720h counts, since-last, span, exact ratios
SPLIT_1219 = {
    ("u1", "i1"): ("2,0,0,1", "2,0,1,1", "73,744,208,73", "666,0,0,0",
                   [0.6667, 0.6667, 0.5, 0.8333, 0, 0, 0, 0, 0.6, 0.5, 0.5, 0, 1, 0, 0.5]),
    ("u1", "i2"): ("1,1,0,1", "1,1,0,1", "82,110,744,63", "0,0,0,0",
                   [0.3333, 0.6667, 0.5, 0.5, 0, 0, 0, 0, 0.6, 0.5, 1, 1, 0, 1, 0]),
    ("u2", "i1"): ("2,0,0,1", "2,0,0,1", "72,744,744,59", "2,0,0,0",
                   [1, 0.5, 0.5, 1, 0, 0, 0, 0, 0.6667, 0.5, 0.5, 0, 0, 0, 0]),
    ("u2", "i2"): ("0,0,0,0", "0,0,0,1", "744,744,744,427", "0,0,0,0",
                   [0, 0.5, 0.5, 1, 0, 0, 0, 0, 0.3333, 0.5, 0, 0, 0, 0, 0]),
    ("u3", "i3"): ("1,0,0,0", "1,0,0,0", "67,744,744,744", "0,0,0,0",
                   [1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0]),
}


def ints(text):
    return [int(x) for x in text.replace(" ", ",").split(",")]


SKEWS = [SkewConfig(), SkewConfig(rows_per_split=1)]


@pytest.mark.parametrize("skew", SKEWS, ids=["plain", "salted"])
def test_split_1216(spark, golden_log, skew):
    exact = by_pair(ui_features(golden_log, "2014-12-16", ORIGIN, skew=skew))
    trunc = by_pair(ui_features(golden_log, "2014-12-16", ORIGIN, "truncated", skew=skew))
    assert set(exact) == set(SPLIT_1216)  # u3 acts only after the split
    for pair, (counts, since, span, ex, tr) in SPLIT_1216.items():
        row = exact[pair]
        assert [row[c] for c in COUNT_FEATURES] == ints(counts)
        assert [row[c] for c in RECENCY_FEATURES] == ints(since)
        assert [row[c] for c in SPAN_FEATURES] == ints(span)
        assert [round(row[c], 4) for c in RATIOS] == pytest.approx(ex, abs=1e-4)
        assert [trunc[pair][c] for c in RATIOS] == tr


@pytest.mark.parametrize("skew", SKEWS, ids=["plain", "salted"])
def test_split_1219_outside_720h(spark, golden_log, skew):
    got = by_pair(ui_features(golden_log, "2014-12-19", ORIGIN, skew=skew))
    assert set(got) == set(SPLIT_1219)
    for pair, (c168, c720, since, span, ex) in SPLIT_1219.items():
        row = got[pair]
        assert [row[c] for c in COUNT_FEATURES[16:20]] == ints(c168)
        assert [row[c] for c in COUNT_FEATURES[20:24]] == ints(c720)
        assert [row[c] for c in RECENCY_FEATURES] == ints(since)
        assert [row[c] for c in SPAN_FEATURES] == ints(span)
        assert [round(row[c], 4) for c in RATIOS] == pytest.approx(ex, abs=1e-4)


def test_schema_and_order(spark, golden_log):
    df = ui_features(golden_log, "2014-12-16", ORIGIN)
    assert df.columns == UI_COLUMNS
    types = dict(df.dtypes)
    assert all(types[c] == "bigint" for c in COUNT_FEATURES + RECENCY_FEATURES + SPAN_FEATURES)
    assert all(types[c] == "double" for c in RATIOS)


@pytest.mark.parametrize(
    "conf",
    [{"spark.sql.session.timeZone": "America/New_York"}, {"spark.sql.ansi.enabled": "false"}],
    ids=["zone", "no-ansi"],
)
def test_session_settings_do_not_change_results(spark, golden_log, conf):
    want = sorted(ui_features(golden_log, "2014-12-16", ORIGIN).collect())
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted(ui_features(golden_log, "2014-12-16", ORIGIN).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want


def test_hour_zero_first_last_is_min_max(spark):
    """A behaviour at hour 0 (origin midnight) and later. The original's
    result depended on iteration order; here first/last are min/max."""
    import datetime as dt

    from conftest import LOG_DDL

    rows = [("u", "i", 1, dt.datetime(2014, 11, 18, 0, 30)), ("u", "i", 1, dt.datetime(2014, 11, 18, 5))]
    log = spark.createDataFrame(rows, LOG_DDL)
    got = ui_features(log, "2014-11-19", ORIGIN).first()
    assert got["span_view"] == 5 and got["since_last_view"] == 24 - 5
    only_zero = ui_features(spark.createDataFrame(rows[:1], LOG_DDL), "2014-11-19", ORIGIN).first()
    assert only_zero["span_view"] == 0 and only_zero["since_last_view"] == 24


def test_windows_that_end_inside_a_day(spark, golden_log):
    """36 h before 12-16 00:00 is 12-14 12:00: part of a day and a whole one."""
    from cartcast.operators.features import window_counts

    windows = (36, 25, 3)
    want = by_pair(window_counts(golden_log, "2014-12-16", ORIGIN, windows))
    got = by_pair(ui_features(golden_log, "2014-12-16", ORIGIN, windows=windows))
    names = [f"{b}_{w}h" for w in windows for b in ("view", "fav", "cart", "buy")]
    assert {k: [v[n] for n in names] for k, v in got.items()} == {k: [v[n] for n in names] for k, v in want.items()}
    with pytest.raises(ValueError):
        ui_features(golden_log, "2014-12-16", ORIGIN, windows=(0,))
