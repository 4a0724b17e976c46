"""Class weights, the learned cut-off and the submission where positives are rare."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cartcast.operators import models
from cartcast.operators.extensions import submission, submission_rare


def planted(spark, n, seed):
    """A weak signal: 1 % positives, one in ten where the first feature is high."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.random() for _ in range(4)]
        p = 0.12 if x[0] > 0.95 else 0.006
        rows.append((f"u{k}", "i", float(rng.random() < p), Vectors.dense(x)))
    return spark.createDataFrame(rows, ["user_id", "item_id", "label", "features"])


def test_weights_balance_the_labels(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(0.0,)] * 97 + [(None,)] * 5, "label double")
    got = {r.label: (r.w, r.n) for r in models.with_class_weights(df).groupBy("label").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).collect()}
    assert got[1.0] == (pytest.approx(50), 3) and got[0.0] == (pytest.approx(50), 97) and got[None] == (0.0, 5)
    one = models.with_class_weights(spark.createDataFrame([(0.0,)] * 4, "label double"))
    assert {r.weight for r in one.collect()} == {1.0}
    assert models.with_class_weights(df.limit(0)).count() == 0


def brute_cutoff(rows):
    best = None
    ap = sum(y == 1 for _, y in rows)
    for cut in sorted({b for b, _ in rows}):
        pp = [y for b, y in rows if b >= cut]
        f1 = 2 * sum(y == 1 for y in pp) / (len(pp) + ap)
        if ap and (best is None or (f1, cut) > best):
            best = (f1, cut)
    return best


def test_cutoff_against_all_cutoffs(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-20, 20), int(rng.random() < 0.2 + 0.02 * k % 0.3)) for k in range(400)]
    rows = [(b + 6 * y, y) for b, y in rows]
    got = models.learn_cutoff(spark.createDataFrame(rows + [(None, 1), (4, None)], "bin int, label int")).first()
    f1, cut = brute_cutoff(rows)
    assert (got.bin, got.f1) == (cut, pytest.approx(f1))
    assert got.f1 == pytest.approx(2 * got.precision * got.recall / (got.precision + got.recall))


def test_no_positive_row_gives_no_cutoff(spark):
    none = models.learn_cutoff(spark.createDataFrame([(3, 0), (4, 0)], "bin int, label int")).collect()
    assert len(none) == 1 and none[0].bin is None


def test_score_bins_keep_the_order(spark):
    scores = [0.0, 1e-12, 1e-3, 0.2, 0.4999, 0.5, 0.7, 1 - 1e-9, 1.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double").select("s", models.score_bin(F.col("s")).alias("b"))
    bins = [r.b for r in df.orderBy("s").collect()]
    assert bins == sorted(bins) and bins[5] == 0 and bins[4] < 0
    assert min(bins) >= -models.MOST * models.BIN and max(bins) <= models.MOST * models.BIN


def test_weak_signal_is_found(spark, tmp_path):
    """Plain learners predict nothing; with weights and a cut-off F1 beats predicting everything."""
    planted(spark, 6000, 1).write.parquet(str(tmp_path / "train"))
    planted(spark, 6000, 2).write.parquet(str(tmp_path / "test"))
    train, test = (spark.read.parquet(str(tmp_path / p)) for p in ("train", "test"))
    plain = models.random_forest(num_trees=5, max_depth=3)
    assert submission(plain.fit(train), test).count() == 0
    forest = models.random_forest(num_trees=5, max_depth=3, weight_col="weight")
    row = models.holdout_rare(forest, train, test).first()
    assert row.pred_pos > 0 and row.f1 > 3 * row.base_f1
    picked = submission_rare(forest, train, test.drop("label"))
    assert picked.columns == ["user_id", "item_id"] and picked.count() == row.pred_pos
    trees = models.gbt(max_iter=3, max_depth=2, step_size=0.3, subsampling_rate=1.0, seed=1, weight_col="weight")
    row = models.holdout_rare(trees, train, test).first()
    assert row.pred_pos > 0 and row.f1 > 3 * row.base_f1
