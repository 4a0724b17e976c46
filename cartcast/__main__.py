"""Command-line jobs, one per action of the original pipeline.

    python -m cartcast filter   --catalogue items.csv --log raw.csv --out filtered
    python -m cartcast extract  --log filtered --split 2014-12-16 --out features
    python -m cartcast extract  --log filtered --split 2014-12-16 2014-12-17 2014-12-18 --out f
    python -m cartcast join     --ui features --users users.csv --items items.csv \\
                                --log filtered --split 2014-12-16 --out train
    python -m cartcast libsvm   --table train --out train.svm
    python -m cartcast holdout  --train train.svm --test test.svm --model gbt \\
                                --iterations 20 --depth 5 --step 0.1 --subsample 1.0
    python -m cartcast score    --train train --day next_day --model rf --iterations 20 --depth 5 \\
                                --out submission

Under ``spark-submit`` pass ``--master ''`` to keep the submitted master. All
reading and writing is done by Spark; nothing is collected but the metrics row.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from cartcast.operators.extensions import multi_split_features, submission
from cartcast.operators.features import ui_features
from cartcast.operators.filter import filter_log, row_count
from cartcast.operators.labels import day_buys, positive_count
from cartcast.operators.models import confusion, gbt, predict, random_forest
from cartcast.operators.training import assemble, feature_columns, training_table, write_libsvm
from cartcast.schema import ORIGINAL_CALENDAR, ORIGINAL_ORIGIN
from cartcast.session import get_session
from cartcast.sinks.writers import write_log, write_table
from cartcast.sources.log import read_log, read_log_parquet
from cartcast.sources.tables import read_catalogue, read_keyed_features, read_libsvm, read_ui_features

DEFAULT_ORIGIN = ORIGINAL_ORIGIN


def _log(spark, path, fmt, calendar=None):
    return read_log_parquet(spark, path) if fmt == "parquet" else read_log(spark, path, calendar)


def _filter(spark, a):
    log = filter_log(_log(spark, a.log, a.log_format, a.calendar), read_catalogue(spark, a.catalogue))
    write_log(log, a.out, a.format)
    return {"rows": row_count(_log(spark, a.out, a.format)).first()[0]}


def _extract(spark, a):
    log = _log(spark, a.log, a.log_format, a.calendar)
    if len(a.split) == 1:
        feats = ui_features(log, a.split[0], a.origin, ratio_mode=a.ratio_mode)
        write_table(feats, a.out, a.format, header=a.header)
    else:
        # One pass over the log for all split days; one folder per split day.
        feats = multi_split_features(log, a.split, a.origin, ratio_mode=a.ratio_mode)
        write_table(feats, a.out, a.format, header=a.header, partition_by="split_date")
    return {"out": a.out, "splits": a.split}


def _join(spark, a):
    ui = read_ui_features(spark, a.ui, a.format)
    users = read_keyed_features(spark, a.users, "user_id", a.format, header=not a.no_header)
    items = read_keyed_features(spark, a.items, "item_id", a.format, header=not a.no_header)
    buys = None if a.unlabelled else day_buys(_log(spark, a.log, a.log_format, a.calendar), a.split)
    table = training_table(ui, users, items, buys, how=a.how)
    write_table(table, a.out, "parquet")
    return {"out": a.out}


def _libsvm(spark, a):
    table = spark.read.parquet(a.table)
    cols = feature_columns(table)
    width = write_libsvm(table, cols, a.out)
    out = {"num_features": width}
    if "label" in table.columns:
        out["positives"] = positive_count(table).first()["positives"]
    return out


def _holdout(spark, a):
    train = read_libsvm(spark, a.train, a.num_features)
    test = read_libsvm(spark, a.test, a.num_features)
    metrics = confusion(predict(_estimator(a).fit(train), test)).first()
    return metrics.asDict()


def _estimator(a):
    if a.model == "gbt":
        return gbt(a.iterations, a.depth, a.step, a.subsample, a.seed)
    return random_forest(a.iterations, a.depth) if a.seed is None else random_forest(a.iterations, a.depth, a.seed)


def _score(spark, a):
    train, day = spark.read.parquet(a.train), spark.read.parquet(a.day)
    cols = feature_columns(train)
    train = train.where(F.col("label").isNotNull())
    model = _estimator(a).fit(assemble(train, cols))
    write_table(submission(model, assemble(day.drop("label"), cols)), a.out, a.format, header=a.header)
    return {"out": a.out}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m cartcast")
    p.add_argument("--master", default="local[*]", help="'' keeps the master given to spark-submit")
    sub = p.add_subparsers(dest="action", required=True)

    f = sub.add_parser("filter", help="keep log rows whose item is in the catalogue")
    f.add_argument("--catalogue", required=True)
    f.add_argument("--log", required=True)
    f.add_argument("--log-format", choices=["csv", "parquet"], default="csv")
    f.add_argument("--calendar", nargs=2, metavar=("FIRST", "LAST"), help=f"reject CSV log rows outside these days (the original's: {' '.join(ORIGINAL_CALENDAR)})")
    f.add_argument("--out", required=True)
    f.add_argument("--format", choices=["csv", "parquet"], default="csv")
    f.set_defaults(run=_filter)

    e = sub.add_parser("extract", help="the 47 user-item features as of a split day")
    e.add_argument("--log", required=True)
    e.add_argument("--log-format", choices=["csv", "parquet"], default="csv")
    e.add_argument("--calendar", nargs=2, metavar=("FIRST", "LAST"), help=f"reject CSV log rows outside these days (the original's: {' '.join(ORIGINAL_CALENDAR)})")
    e.add_argument("--split", required=True, nargs="+", help="yyyy-MM-dd; several: one folder each, one pass")
    e.add_argument("--origin", default=DEFAULT_ORIGIN, help="day of hour 0, yyyy-MM-dd")
    e.add_argument("--ratio-mode", choices=["exact", "truncated"], default="exact")
    e.add_argument("--out", required=True)
    e.add_argument("--format", choices=["csv", "parquet"], default="csv")
    e.add_argument("--header", action="store_true")
    e.set_defaults(run=_extract)

    j = sub.add_parser("join", help="user-item features + user and item features + label")
    j.add_argument("--ui", required=True)
    j.add_argument("--users", required=True)
    j.add_argument("--items", required=True)
    j.add_argument("--format", choices=["csv", "parquet"], default="csv", help="of the three inputs")
    j.add_argument("--no-header", action="store_true", help="user/item CSVs have no header; key first")
    j.add_argument("--log", required=True)
    j.add_argument("--log-format", choices=["csv", "parquet"], default="csv")
    j.add_argument("--calendar", nargs=2, metavar=("FIRST", "LAST"), help=f"reject CSV log rows outside these days (the original's: {' '.join(ORIGINAL_CALENDAR)})")
    j.add_argument("--split", required=True)
    j.add_argument("--unlabelled", action="store_true", help="the day to predict: no label")
    j.add_argument("--how", choices=["inner", "left"], default="inner")
    j.add_argument("--out", required=True)
    j.set_defaults(run=_join)

    s = sub.add_parser("libsvm", help="training table to libsvm")
    s.add_argument("--table", required=True)
    s.add_argument("--out", required=True)
    s.set_defaults(run=_libsvm)

    h = sub.add_parser("holdout", help="train on one libsvm file, score another")
    h.add_argument("--train", required=True)
    h.add_argument("--test", required=True)
    h.add_argument("--num-features", type=int, required=True)
    h.add_argument("--model", choices=["gbt", "rf"], default="gbt")
    h.add_argument("--iterations", type=int, required=True, help="boosting rounds or trees")
    h.add_argument("--depth", type=int, required=True)
    h.add_argument("--step", type=float, default=0.1)
    h.add_argument("--subsample", type=float, default=1.0)
    h.add_argument("--seed", type=int, default=None)
    h.set_defaults(run=_holdout)

    c = sub.add_parser("score", help="train on one training table, write the pairs predicted for another day")
    c.add_argument("--train", required=True, help="labelled training table (Parquet)")
    c.add_argument("--day", required=True, help="training table of the day to predict; a label is ignored")
    c.add_argument("--model", choices=["gbt", "rf"], default="gbt")
    c.add_argument("--iterations", type=int, required=True, help="boosting rounds or trees")
    c.add_argument("--depth", type=int, required=True)
    c.add_argument("--step", type=float, default=0.1)
    c.add_argument("--subsample", type=float, default=1.0)
    c.add_argument("--seed", type=int, default=None)
    c.add_argument("--out", required=True)
    c.add_argument("--format", choices=["csv", "parquet"], default="csv")
    c.add_argument("--header", action="store_true")
    c.set_defaults(run=_score)
    return p


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = get_session(args.master or None, shuffle_partitions=None)
    result = args.run(spark, args)
    print(json.dumps({"action": args.action, **result}, default=str))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
