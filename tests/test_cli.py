"""The command-line jobs, chained as the original pipeline ran them."""

from __future__ import annotations

import tempfile
from pathlib import Path

from cartcast.__main__ import main
from cartcast.operators.profiles import item_profile, user_profile
from cartcast.sinks.writers import log_as_text
from conftest import ORIGIN


def test_chained_jobs(spark, golden_log):
    base = Path(tempfile.mkdtemp(prefix="cartcast-cli-"))
    raw = base / "raw"
    log_as_text(golden_log).write.option("header", True).csv(str(raw))
    (base / "items.csv").write_text("i1,g,c\ni2,g,c\n")  # no header, like the original file
    m = ["--master", "local[2]"]

    out = main(m + ["filter", "--catalogue", str(base / "items.csv"), "--log", str(raw), "--out", str(base / "flt")])
    assert out["rows"] == 12  # everything but the i3 row

    main(m + ["extract", "--log", str(base / "flt"), "--split", "2014-12-16", "--origin", ORIGIN,
              "--out", str(base / "ui")])
    for name, df in [("users", user_profile(golden_log, "2014-12-16", ORIGIN)),
                     ("items", item_profile(golden_log, "2014-12-16", ORIGIN))]:
        df.write.option("header", False).csv(str(base / name))
    main(m + ["join", "--ui", str(base / "ui"), "--users", str(base / "users"), "--items", str(base / "items"),
              "--no-header", "--log", str(base / "flt"), "--split", "2014-12-16", "--out", str(base / "train")])
    table = spark.read.parquet(str(base / "train"))
    assert table.count() == 4 and sorted(r.label for r in table.collect()) == [0, 0, 1, 1]

    svm = main(m + ["libsvm", "--table", str(base / "train"), "--out", str(base / "svm")])
    assert svm["positives"] == 2 and svm["num_features"] == 47 + 17 + 17

    table.drop("label").write.parquet(str(base / "day"))  # the day to predict
    plain = main(m + ["libsvm", "--table", str(base / "day"), "--out", str(base / "svm_day")])
    assert plain["num_features"] == svm["num_features"] and "positives" not in plain
    sub = main(m + ["score", "--train", str(base / "train"), "--day", str(base / "day"), "--model", "rf",
                    "--iterations", "1", "--depth", "3", "--out", str(base / "pairs")])
    pairs = spark.read.csv(sub["out"], schema="user_id string, item_id string")
    assert {tuple(r) for r in pairs.collect()} <= {(r.user_id, r.item_id) for r in table.collect()}

    metrics = main(m + ["holdout", "--train", str(base / "svm"), "--test", str(base / "svm"), "--model", "rf",
                        "--iterations", "3", "--depth", "3", "--num-features", str(svm["num_features"])])
    assert metrics["rows"] == 4 and metrics["actual_pos"] == 2


def test_parquet_paths_and_calendar(spark, golden_log):
    base = Path(tempfile.mkdtemp(prefix="cartcast-cli-pq-"))
    raw = base / "raw"
    log_as_text(golden_log).write.option("header", True).csv(str(raw))
    (base / "items.csv").write_text("i1,g,c\ni2,g,c\ni3,g,c\n")
    m = ["--master", "local[2]"]
    out = main(m + ["filter", "--catalogue", str(base / "items.csv"), "--log", str(raw), "--out", str(base / "flt"),
                    "--format", "parquet", "--calendar", "2014-12-01", "2014-12-18"])
    assert out["rows"] == 12  # the 11-18 row is outside the calendar
    main(m + ["extract", "--log", str(base / "flt"), "--log-format", "parquet", "--split", "2014-12-16",
              "--origin", ORIGIN, "--out", str(base / "ui"), "--format", "parquet"])
    feats = spark.read.parquet(str(base / "ui"))
    assert feats.count() == 4 and feats.where("user_id = 'u1' AND item_id = 'i1'").first()["span_view"] == 2


def test_extract_several_splits_one_folder_each(spark, golden_log):
    from cartcast.operators.features import ui_features

    base = Path(tempfile.mkdtemp(prefix="cartcast-cli-multi-"))
    raw = base / "raw"
    log_as_text(golden_log).write.option("header", True).csv(str(raw))
    main(["--master", "local[2]", "extract", "--log", str(raw), "--split", "2014-12-16", "2014-12-19",
          "--origin", ORIGIN, "--out", str(base / "f"), "--format", "parquet"])
    folders = sorted(p.name for p in (base / "f").iterdir() if p.name.startswith("split_date="))
    assert folders == ["split_date=2014-12-16", "split_date=2014-12-19"]
    one = spark.read.parquet(str(base / "f" / "split_date=2014-12-19"))
    want = ui_features(golden_log, "2014-12-19", ORIGIN)
    cols = sorted(want.columns)
    assert sorted(one.select(cols).collect()) == sorted(want.select(cols).collect())
