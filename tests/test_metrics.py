"""Metric literals of the reference tests, plus the driver-side confusion helper."""

import pytest

from rampart.operators import metrics as M

Y = [0, 0, 1, 2, 2, 1]
P = [0, 1, 1, 2, 0, 1]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(list(zip(Y, P)), "y_true int, y_pred int")


def test_detection_metrics(preds):
    m = M.detection_metrics(preds).head()
    assert m["accuracy"] == pytest.approx(4 / 6)
    assert m["fpr"] == pytest.approx(0.5)
    assert m["macro_f1"] == pytest.approx(0.655556, abs=1e-6)
    assert m["balanced_accuracy"] == pytest.approx(0.666667, abs=1e-6)
    assert m["weighted_f1"] == pytest.approx(0.655556, abs=1e-6)
    for k in ("precision", "recall", "f1", "fpr", "accuracy"):
        assert 0.0 <= m[k] <= 1.0


def test_confusion_helper_matches_spark(preds):
    spark_row = M.detection_metrics(preds).head().asDict()
    cells = [(r["y"], r["p"], r["cnt"]) for r in M.confusion(preds).collect()]
    local = M.metrics_from_confusion_rows(cells)
    for k, v in local.items():
        assert v == pytest.approx(spark_row[k])
    conf = M.confusion(preds)
    from_conf = M.metrics_from_confusion(conf).head().asDict()
    for k, v in local.items():
        assert v == pytest.approx(from_conf[k])


def test_empty_denominators_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    m = M.binary_metrics(df).head()
    assert (m["precision"], m["recall"], m["f1"], m["fpr"]) == (0.0, 0.0, 0.0, 0.0)


def test_balanced_class_weights(spark):
    df = spark.createDataFrame([(y,) for y in [0, 0, 0, 1, 1]], "label_id int")
    w = {r["label_id"]: r["weight"] for r in M.balanced_class_weights(df).collect()}
    assert w[0] == pytest.approx(5 / 6) and w[1] == pytest.approx(1.25)


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1.0,), (0.0,)], "p_true double")
    loss = M.log_loss(df).head()["loss"]
    assert loss == pytest.approx(-(0 + __import__("math").log(M.EPS)) / 2)
