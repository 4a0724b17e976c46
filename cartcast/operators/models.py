"""Models and their evaluation.

Boosted trees and random forests come from ``pyspark.ml``; training is
distributed there. Evaluation is one aggregation over the predictions.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartcast.functions.ratio import try_ratio
from cartcast.schema import RF_IMPURITY, RF_MAX_BINS, RF_SEED, RF_SUBSET


def gbt(
    max_iter: int,
    max_depth: int,
    step_size: float,
    subsampling_rate: float,
    seed: int | None = None,
    weight_col: str | None = None,
):
    """M1: two-class boosted trees with logistic loss, no categorical features."""
    est = GBTClassifier(
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=step_size,
        subsamplingRate=subsampling_rate,
        lossType="logistic",
        featuresCol="features",
        labelCol="label",
    )
    est = est.setWeightCol(weight_col) if weight_col else est
    return est.setSeed(seed) if seed is not None else est


def random_forest(num_trees: int, max_depth: int, seed: int = RF_SEED, weight_col: str | None = None):
    """M2: two-class forest; gini, 32 bins, automatic feature subset."""
    est = RandomForestClassifier(
        numTrees=num_trees,
        maxDepth=max_depth,
        maxBins=RF_MAX_BINS,
        impurity=RF_IMPURITY,
        featureSubsetStrategy=RF_SUBSET,
        seed=seed,
        featuresCol="features",
        labelCol="label",
    )
    return est.setWeightCol(weight_col) if weight_col else est


def predict(model, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """M3: ``prediction`` beside ``label`` (and any key columns kept)."""
    cols = [*keep, "prediction"] + (["label"] if "label" in df.columns else [])
    return model.transform(df).select(*cols)


def confusion(pred: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """A14 + A15: true positives, predicted and actual positives, and the
    precision, recall and F1 they give; NULL where a metric is undefined."""
    p, y = F.col(prediction), F.col(label)
    counts = pred.agg(
        F.count_if((p == 1) & (y == 1)).alias("true_pos"),
        F.count_if(p == 1).alias("pred_pos"),
        F.count_if(y == 1).alias("actual_pos"),
        F.count(F.lit(1)).alias("rows"),
    )
    precision = try_ratio(F.col("true_pos"), F.col("pred_pos"))
    recall = try_ratio(F.col("true_pos"), F.col("actual_pos"))
    with_pr = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return with_pr.withColumn("f1", f1)


# -- rare positives ---------------------------------------------------------
#
# Where one pair in hundreds is bought, a learner that counts every row alike
# and predicts at 0.5 predicts nothing. Off by default: the operators above are
# those of the original.

BIN = 64  # score bins per unit of log odds
MOST = 40  # log odds beyond which scores are not told apart


def with_class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Add ``name``: rows weigh so that both labels have half of the total weight.

    With one label only, all rows weigh the same. Rows without a label weigh 0:
    leave them out before fitting.
    """
    y = F.col(label)
    n, pos = (df.agg(F.count_if(c).alias("n")).scalar() for c in (y.isNotNull(), y == 1))
    own = F.when(y == 1, pos).when(y.isNotNull(), n - pos).otherwise(F.lit(None))
    return df.withColumn(name, F.coalesce(F.when(pos * (n - pos) == 0, (own > 0).cast("double")).otherwise(n / (2.0 * own)), F.lit(0.0)))


def score_bin(score: Column) -> Column:
    """Log odds of a score in [0, 1] as a whole number of bins; NULL stays NULL."""
    odds = F.ln(F.greatest(score, F.lit(1e-300))) - F.ln(F.greatest(1 - score, F.lit(1e-300)))
    return F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), odds)) * BIN).cast("int")


def scored(model, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, ``bin`` (of the probability of label 1) and ``label`` if there is one."""
    out = model.transform(df).withColumn("bin", score_bin(F.get(vector_to_array("probability"), F.lit(1))))
    return out.select(*keep, "bin", *(["label"] if "label" in df.columns else []))


def learn_cutoff(scores: DataFrame) -> DataFrame:
    """The bin from which on to predict 1 so that F1 is highest, as one row.

    ``bin``, ``cutoff`` (its lower edge as a score) and the ``precision``,
    ``recall`` and ``f1`` on ``scores`` (columns ``bin``, ``label``). Rows are counted per
    bin, at most ``2 * MOST * BIN + 1`` of them whatever the table, and summed
    from the top over those counts. Of equal F1 the highest bin; without a
    positive row there is no cut-off (NULL), and nothing is predicted.
    """
    y = F.col("label")
    bins = scores.where(y.isNotNull() & F.col("bin").isNotNull()).groupBy("bin")
    bins = bins.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("pos"))
    from_top = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp, pp = F.sum("pos").over(from_top), F.sum("n").over(from_top)
    upto = bins.select("bin", tp.alias("tp"), pp.alias("pp"), F.sum("pos").over(Window.partitionBy()).alias("ap"))
    upto = upto.where("ap > 0").withColumn("f1", F.lit(2.0) * F.col("tp") / (F.col("pp") + F.col("ap")))
    best = upto.agg(F.max_by(F.struct("*"), F.struct("f1", "bin")).alias("b"))
    return best.select(
        F.col("b.bin").alias("bin"),
        (1 / (1 + F.exp(-F.col("b.bin") / BIN))).alias("cutoff"),
        (F.col("b.tp") / F.col("b.pp")).alias("precision"),
        (F.col("b.tp") / F.col("b.ap")).alias("recall"),
        F.col("b.f1").alias("f1"),
    )


def predict_from(model, cutoff: DataFrame, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """M3 with a learned cut-off (the row of ``learn_cutoff``) in place of 0.5."""
    at = F.coalesce(F.col("bin") >= cutoff.select("bin").scalar(), F.lit(False))
    out = scored(model, df, keep)
    return out.select(*keep, at.cast("double").alias("prediction"), *(["label"] if "label" in df.columns else []))


def holdout_rare(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """M4 for rare positives: weighted fit and cut-off on one day, metrics on the next.

    ``estimator`` takes its weights from ``weight`` (``weight_col`` of ``gbt``
    and ``random_forest``). ``train`` should be a written table: it is read to
    weigh, to fit and to learn the cut-off. ``base_f1`` is the F1 of predicting
    every row, which a useful model beats.
    """
    known = train.where(F.col("label").isNotNull())
    model = estimator.fit(with_class_weights(known))
    out = confusion(predict_from(model, learn_cutoff(scored(model, known)), test))
    base = F.try_divide(F.lit(2.0) * F.col("actual_pos"), F.col("rows") + F.col("actual_pos"))
    return out.withColumn("base_f1", base)


def holdout(estimator, train: DataFrame, test: DataFrame) -> DataFrame:
    """M4: fit on one day's rows, score the next day's, return the metrics row."""
    model = estimator.fit(train)
    return confusion(predict(model, test))
