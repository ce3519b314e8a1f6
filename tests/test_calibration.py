"""Sigmoid calibration of decision values."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortkit.operators.calibration import SigmoidModel, fit_sigmoid, fits_at_once, out_of_fold_margins
from cohortkit.operators.models import make_model, partition_rows, score_column


def test_parameters_minimise_the_smoothed_loss(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=400) * 2
    y = (rng.random(400) < 1 / (1 + np.exp(-1.5 * f + 0.3))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(f, y)] + [(None, 1.0)], "margin double, label double")
    a, b = fit_sigmoid(df)
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(a * f + b))
    assert abs((f * (t - p)).mean()) < 1e-9 and abs((t - p).mean()) < 1e-9 and a < 0


def test_edges(spark):
    schema = "margin double, label double"
    assert fit_sigmoid(spark.createDataFrame([], schema)) == (-1.0, 0.0)
    a, b = fit_sigmoid(spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (1.0, 1.0)], schema))  # equal margins
    assert np.isfinite([a, b]).all()
    a, b = fit_sigmoid(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], schema))  # one class
    assert np.isfinite([a, b]).all()
    a, b = fit_sigmoid(spark.createDataFrame([(900.0, 1.0), (-900.0, 0.0)] * 3, schema))  # separable, large
    assert np.isfinite([a, b]).all() and a < 0


def test_svm_gives_probabilities_monotone_in_the_margin(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 2))
    y = ((x**2).sum(axis=1) < 1.2).astype(float)  # not linear
    df = spark.createDataFrame([(i, float(b), 1.0, a.tolist()) for i, (a, b) in enumerate(zip(x, y))],
                               "row_id long, label double, weight double, a array<double>") \
        .withColumn("features", array_to_vector("a")).drop("a")
    model = make_model("SVM", 2, 160, svm_max_iter=30, rff_components=64).fit(df)
    model.write().save(str(tmp_path / "svm"))
    loaded = PipelineModel.load(str(tmp_path / "svm"))
    assert isinstance(loaded.stages[-1], SigmoidModel)
    rows = score_column(loaded.transform(df)).select(
        vector_to_array("rawPrediction")[1].alias("margin"), "score", "pred", "label").orderBy("margin").collect()
    scores = [r.score for r in rows]
    assert all(0 <= s <= 1 for s in scores) and scores == sorted(scores)
    assert all((r.margin > 0) == (r.pred == 1) for r in rows)
    assert sum(r.pred == r.label for r in rows) > 130
    # a class too rare for any fold's training rows
    lone = df.withColumn("label", (F.col("row_id") == 0).cast("double"))
    est = make_model("SVM", 2, 160, svm_max_iter=2, rff_components=4)
    assert out_of_fold_margins(est.estimator, lone, "label", "row_id", 42).count() < 160


def test_solver_rows_stay_in_memory_and_are_dealt_out(spark):
    # five fold fits of 512 random features a row: all at a time while they fit in memory, then one after the other
    assert [fits_at_once(5, n, 8 * 512) for n in (10_000, 150_000, 400_000, 1_000_000, 10**9)] == [5, 5, 2, 1, 1]
    assert fits_at_once(5, 10**9, 0) == 5
    # a task scans as much of them at a step whatever their number
    assert partition_rows("SVM", 512) * 512 * 8 == 64 * 2**20 and partition_rows("SVM", 8) == 100_000
    assert partition_rows("RF") == 100_000
    est = make_model("SVM", 2, 160, rff_components=64)
    assert est.row_bytes == 8 * 64
