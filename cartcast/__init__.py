"""Interaction-log purchase prediction as Spark DataFrame jobs.

The main entry points, one per step of the pipeline:

    filter_log            keep log rows whose item is in a catalogue (C1)
    ui_features           the 47 user-item features as of a split day (C2)
    day_buys              labels: pairs bought on a day (C3)
    user_profile,
    item_profile          user and item feature tables (E4)
    training_table        features + user/item features + label (C4)
    assemble, write_libsvm  vectors and libsvm export (P11, C5)
    gbt, random_forest, holdout, confusion   models and metrics (M1-M4)
    multi_split_features, multi_split_training   several split days in one pass (E1)
"""

from cartcast.operators.extensions import multi_split_features, multi_split_training, submission
from cartcast.operators.features import pair_days, ui_features
from cartcast.operators.filter import filter_log
from cartcast.operators.labels import attach_label, day_buys, labelled_pairs
from cartcast.operators.models import confusion, gbt, holdout, predict, random_forest
from cartcast.operators.profiles import item_profile, user_profile
from cartcast.operators.skew import SkewConfig
from cartcast.operators.training import assemble, training_table, write_libsvm
from cartcast.session import cluster_conf, get_session

__all__ = [
    "SkewConfig",
    "assemble",
    "attach_label",
    "cluster_conf",
    "confusion",
    "day_buys",
    "filter_log",
    "gbt",
    "get_session",
    "holdout",
    "item_profile",
    "labelled_pairs",
    "multi_split_features",
    "multi_split_training",
    "pair_days",
    "predict",
    "random_forest",
    "submission",
    "training_table",
    "ui_features",
    "user_profile",
    "write_libsvm",
]
