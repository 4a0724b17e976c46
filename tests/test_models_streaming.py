"""Models and metrics (M1-M4, A14/A15, E3) and the streaming filter."""

from __future__ import annotations

import datetime as dt
import tempfile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cartcast.operators.extensions import submission
from cartcast.operators.models import confusion, gbt, holdout, predict, random_forest
from cartcast.operators.training import assemble
from cartcast.streaming.filter import start_filter_stream


def test_confusion_metrics(spark):
    pred = spark.createDataFrame(
        [(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (1.0, 1.0)], "prediction double, label double"
    )
    m = confusion(pred).first()
    assert (m.true_pos, m.pred_pos, m.actual_pos, m.rows) == (2, 3, 3, 5)
    assert m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(2 / 3)
    assert m.f1 == pytest.approx(2 / 3)
    none = confusion(pred.where("prediction = 0")).first()
    assert none.pred_pos == 0 and none.precision is None and none.f1 is None  # D7


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(f"u{n}", f"i{n % 7}", float(n % 5), float(n % 3), 1 if n % 5 >= 3 else 0) for n in range(120)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, a double, b double, label int")
    return assemble(df, ["a", "b"]).repartition(2, "user_id").cache()


@pytest.mark.parametrize("make", [lambda: gbt(5, 3, 0.3, 1.0, seed=3), lambda: random_forest(5, 4)])
def test_holdout_is_learnable_and_repeatable(spark, toy, make):
    first = holdout(make(), toy, toy).first()
    second = holdout(make(), toy, toy).first()
    assert first == second
    assert first.rows == 120 and first.actual_pos == 48
    assert first.true_pos == first.pred_pos == 48  # separable by feature a


def test_predict_and_submission(spark, toy):
    model = random_forest(3, 3).fit(toy)
    p = predict(model, toy, keep=("user_id",))
    assert set(p.columns) == {"user_id", "prediction", "label"}
    sub = submission(model, toy.drop("label"))
    assert sub.columns == ["user_id", "item_id"] and sub.count() == 48


def _events_file(path: Path, rows):
    table = pa.table(
        {
            "event_id": pa.array([r[0] for r in rows], pa.int64()),
            "ts": pa.array([r[1] for r in rows], pa.timestamp("us")),
            "user_id": pa.array([r[2] for r in rows], pa.int64()),
            "event_type": pa.array([r[3] for r in rows], pa.string()),
            "value": pa.array([0.0] * len(rows), pa.float64()),
            "props": pa.array([r[4] for r in rows], pa.string()),
        }
    )
    pq.write_table(table, path)


def test_stream_filter_is_incremental(spark):
    base = Path(tempfile.mkdtemp(prefix="cartcast-stream-"))
    src = base / "in"
    src.mkdir()
    t = dt.datetime(2024, 1, 2, 3)
    _events_file(src / "a.parquet", [(1, t, 10, "view", '{"k": 1}'), (2, t, 11, "error", '{"k": 1}'),
                                     (3, t, 12, "purchase", '{"k": 2}')])
    items = spark.createDataFrame([(1,)], "item_id bigint")
    sink, ckpt = str(base / "out"), str(base / "ckpt")
    q = start_filter_stream(spark, str(src), items, sink, ckpt)
    q.awaitTermination()
    assert sorted(r.user_id for r in spark.read.parquet(sink).collect()) == [10]
    # new file arrives; the restarted query reads only the new one
    _events_file(src / "b.parquet", [(4, t, 13, "click", '{"k": 1}'), (5, t, 14, "view", '{"k": 3}')])
    q = start_filter_stream(spark, str(src), items, sink, ckpt)
    q.awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted(r.user_id for r in got.collect()) == [10, 13]
    assert dict(got.dtypes)["behavior_type"] == "int"
