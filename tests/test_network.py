"""Networks: gradient, early stopping, no trace of partitions, persistence."""

import tempfile

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortkit.operators import network as NN
from cohortkit.operators.models import score_column
from cohortkit.plans import catalog as C
from conftest import SF001


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    layers = [4, 5, 3, 1]
    x, y, theta = rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float), NN.starting_weights(layers, 1)
    _, gradient = NN.loss_and_gradient(x, y, theta, layers)
    for i in range(0, len(theta), 3):
        step = np.zeros(len(theta))
        step[i] = 1e-6
        slope = (NN.loss_and_gradient(x, y, theta + step, layers)[0]
                 - NN.loss_and_gradient(x, y, theta - step, layers)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-5


def test_partitions_leave_no_trace_and_training_stops(spark):
    rows = C.network_rows(spark, SF001)
    layers = [64, 8, 1]
    runs = [NN.fit_networks(df, [-1], layers, {}, 0.001, 40)[-1] for df in (rows.repartition(1), rows.repartition(9))]
    assert np.array_equal(runs[0].best, runs[1].best) and runs[0].curve == runs[1].curve
    net = runs[0]
    assert net.curve[-1][0] < net.curve[0][0]
    assert net.epoch <= 41 and (net.wait >= NN.PATIENCE or net.epoch > 40)
    assert net.best_epoch == next(i for i, c in enumerate(net.curve) if c[1] > net.score - NN.GAIN)


def test_folds_train_without_their_rows(spark):
    rows = C.network_rows(spark, SF001).withColumn("fold", (F.col("row_id") % 2).cast("int"))
    together = NN.fit_networks(rows, [0, 1, -1], [64, 4, 1], {}, 0.01, 6)
    alone = NN.fit_networks(rows.filter("fold = 1").withColumn("fold", F.lit(7)), [-1], [64, 4, 1], {}, 0.01, 6)[-1]
    assert np.allclose(together[0].best, alone.best, atol=1e-6)
    scored = NN.score_networks(rows, {f: n.best for f, n in together.items()}, [64, 4, 1], {})
    assert scored.count() == rows.count()


def test_estimator_is_saved_and_loaded(spark):
    df = C.network_rows(spark, SF001).withColumn("features", array_to_vector("x"))
    model = NN.NetworkClassifier(layers=[64, 4, 1], maxIter=5).fit(df)
    path = tempfile.mkdtemp(prefix="cohortkit-net-") + "/m"
    PipelineModel(stages=[model]).write().save(path)
    a = {r.row_id: r.score for r in score_column(model.transform(df)).collect()}
    b = {r.row_id: r.score for r in score_column(PipelineModel.load(path).transform(df)).collect()}
    assert a == b and all(0 <= v <= 1 for v in a.values())


def test_one_class_and_no_rows(spark):
    rows = C.network_rows(spark, SF001)
    one = NN.fit_networks(rows.filter("label = 0"), [-1], [64, 2, 1], {}, 0.01, 5)[-1]
    none = NN.fit_networks(rows.limit(0), [-1], [64, 2, 1], {}, 0.01, 5)[-1]
    assert np.isfinite(one.best).all() and np.isfinite(none.best).all()
