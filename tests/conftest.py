from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cartcast.session import get_session  # noqa: E402

ORIGIN = "2014-11-18"

# Golden log of FIXTURES.md §3: (user, item, behaviour, "MM-dd HH") in 2014.
GOLDEN = [
    ("u1", "i1", 1, "12-15 23"),
    ("u1", "i1", 4, "12-15 23"),
    ("u1", "i1", 1, "12-15 21"),
    ("u1", "i2", 1, "12-15 14"),
    ("u1", "i2", 2, "12-14 10"),
    ("u1", "i1", 3, "12-10 08"),
    ("u1", "i1", 1, "11-18 05"),
    ("u2", "i1", 1, "12-15 22"),
    ("u2", "i2", 4, "12-01 05"),
    ("u2", "i1", 1, "12-16 00"),
    ("u3", "i3", 1, "12-16 05"),
    ("u1", "i2", 4, "12-16 09"),
    ("u2", "i1", 4, "12-16 13"),
]

LOG_DDL = "user_id string, item_id string, behavior_type int, ts timestamp_ntz"


def golden_ts(text: str) -> dt.datetime:
    return dt.datetime(2014, int(text[:2]), int(text[3:5]), int(text[6:]))


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[*]", 8)
    yield session


@pytest.fixture(scope="session")
def golden_log(spark):
    rows = [(u, i, b, golden_ts(t)) for u, i, b, t in GOLDEN]
    return spark.createDataFrame(rows, LOG_DDL)


def by_pair(df, keys=("user_id", "item_id")):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
