"""Model queries' values: least squares and errors by numpy, shuffles, surrogate trees, saved models in another session."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from corvane.plans import models


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 2))
    y = 3 * x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=240) * 0.5
    return x, y


def frame_of(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "entity long, a double, b double, y double")


def test_random_folds_and_errors_like_numpy(spark, data):
    x, y = data
    told = models.out_of_fold(models.random_folds(frame_of(spark, x, y), 5), ["a", "b"], ("linear", "ridge"), 5)
    fold = np.array([i * 2654435761 % 1000003 % 5 for i in range(240)])
    got = {r["model"]: r for r in models.errors(told, ["model"]).collect()}
    for name, alpha in (("linear", 0.0), ("ridge", 1.0)):
        predicted = np.empty(240)
        for f in range(5):
            own, m = fold != f, x[fold != f].mean(axis=0)
            centred = x[own] - m
            beta = np.linalg.solve(centred.T @ centred + alpha * np.eye(2), centred.T @ (y[own] - y[own].mean()))
            predicted[fold == f] = y[own].mean() + (x[fold == f] - m) @ beta
        miss = y - predicted
        want = {"n": 240, "r2": 1 - (miss**2).sum() / ((y - y.mean()) ** 2).sum(), "rmse": np.sqrt((miss**2).mean()), "mae": np.abs(miss).mean()}
        assert {k: got[name][k] for k in want} == pytest.approx(want, rel=1e-6)


def test_shuffles_hurt_what_counts(spark, data):
    x, y = data
    rows = frame_of(spark, x, y)
    model = LinearRegression(labelCol="y", predictionCol="predicted", solver="normal").fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))
    got = {r["input"]: r for r in models.permuted(rows, ["a", "b"], model, 30).collect()}
    slope = model.coefficients.toArray()
    for i, c in enumerate("ab"):  # shuffling adds 2 b^2 var(x) of error on average, and what the column shares with the rest
        assert got[c]["drop"] == pytest.approx(2 * slope[i] ** 2 * x[:, i].var() / y.var(), rel=0.15, abs=0.01) and got[c]["sd"] > 0


def test_surrogate_tells_separate_labels(spark):
    rng = np.random.default_rng(0)
    rows = [(float(k), float(rng.uniform(k, k + 0.9)), float(rng.uniform())) for k in (0, 0, 1, 2) for _ in range(50)]
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "label double, a double, b double"))
    got = models.surrogate(data, 3).first()
    assert got["fidelity"] == 1.0 and got["share"] == 0.5 and got["depth"] <= 3 and got["nodes"] >= 5


def test_saved_model_predicts_the_same_in_another_session(spark, data, tmp_path):
    from pyspark.ml import Pipeline

    rows = frame_of(spark, *data)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), models.MODELS["lasso"](240, 1.0).setLabelCol("y")]).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    other = spark.newSession()
    again = PipelineModel.load(str(tmp_path / "m")).transform(frame_of(other, *data))
    values = lambda df: [r["prediction"] for r in df.orderBy("entity").collect()]
    assert values(again) == values(fitted.transform(rows))


def test_precision_holds_closed_forms():
    r = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    inverse, log_det = models.precision(r)
    assert np.allclose(inverse, np.linalg.inv(r)) and log_det == pytest.approx(np.log(np.linalg.det(r)))
