import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors

from cohortkit.operators import reduce as RD
from cohortkit.operators import wide_pca as W
from cohortkit.session import stage_path


def _vectors(spark, x, parts=3):
    return (spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, a array<double>")
            .repartition(parts).select("id", array_to_vector("a").alias("v")))


def _wide(n=120, d=300, seed=3):
    """Sparse rows with a slowly falling spectrum and a mean far from zero in some columns."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) / np.sqrt(1 + np.arange(d))
    x[rng.random(x.shape) < 0.6] = 0.0
    x[:, :4] += 50.0
    return x


def test_axes_equal_the_covariance_way(spark):
    x, k = _wide(), 5
    found = W.principal_axes(_vectors(spark, x), "v", k)
    value, vector = np.linalg.eigh(np.cov(x.T))
    value, vector = value[::-1], vector[:, ::-1][:, :k]
    assert found["residual"] <= W.TOLERANCE and found["passes"] < W.PASSES
    assert np.allclose(found["variance"], value[:k], rtol=1e-9)
    assert abs(found["total"] - value.sum()) < 1e-9 * value.sum()
    # what of the true space lies outside the space found
    assert np.linalg.norm(vector - found["axes"] @ (found["axes"].T @ vector)) < 1e-6
    assert np.allclose(found["axes"].T @ found["axes"], np.eye(k), atol=1e-10)


def test_no_table_wider_than_the_basis_reaches_the_driver(spark, monkeypatch):
    shapes = []
    real = W._covariance_times
    monkeypatch.setattr(W, "_covariance_times", lambda e, m, q, n: shapes.append(q.shape) or real(e, m, q, n))
    W.principal_axes(_vectors(spark, _wide()), "v", 4, extra=6)
    assert max(s[1] for s in shapes) <= 3 * 10 and {s[0] for s in shapes} == {300}


def test_both_ways_give_one_projection_and_reload(spark):
    df = _vectors(spark, _wide())
    narrow, share = RD.fit_pca(df, "v", "p", 3)
    wide, wide_share = RD.fit_pca(df, "v", "p", 3, wide=10)

    def values(model):
        return np.array([r.p for r in model.transform(df).orderBy("id").select(vector_to_array("p").alias("p")).collect()])

    assert abs(share - wide_share) < 1e-9 and np.allclose(values(narrow), values(wide), atol=1e-6)
    path = stage_path(spark, "tests", "wide-pca-model")
    wide.write().overwrite().save(path)
    assert np.allclose(values(PipelineModel.load(path)), values(wide))
    report = RD.pca_report(RD.pca_batch([{"name": "x", "train": df, "test": df, "input_col": "v", "k": 3}])).first()
    assert (report.n_components, report.n_train) == (3, 120)


def test_odd_input(spark):
    x = _wide(40, 30)
    rows = [(Vectors.dense(r.tolist()),) for r in x]
    want = W.principal_axes(spark.createDataFrame(rows, ["v"]), "v", 2)
    nulls = spark.createDataFrame(rows, ["v"]).unionByName(
        spark.createDataFrame(rows[:1], ["v"]).selectExpr("if(v is null, v, null) as v"))
    assert np.allclose(W.principal_axes(nulls, "v", 2)["variance"], want["variance"])
    # repeated rows: the covariance of the repeated table
    twice = W.principal_axes(spark.createDataFrame(rows + rows, ["v"]), "v", 2)
    assert np.allclose(twice["variance"], want["variance"] * (2 * 39) / 79)
    # more components than the rows span, and equal rows
    thin = W.principal_axes(spark.createDataFrame(rows[:3], ["v"]), "v", 4)
    assert np.allclose(thin["variance"][2:], 0, atol=1e-9) and thin["residual"] < 1e-6
    flat = W.principal_axes(spark.createDataFrame(rows[:1] * 5, ["v"]), "v", 2)
    assert np.allclose(flat["variance"], 0) and flat["total"] == 0
    for few in (rows[:0], rows[:1]):
        with pytest.raises(ValueError):
            W.principal_axes(spark.createDataFrame(few, nulls.schema), "v", 2)
    with pytest.raises(ValueError):
        W.principal_axes(spark.createDataFrame(rows, ["v"]), "v", 31)
    uneven = spark.createDataFrame([(Vectors.dense([1.0, 2.0]),), (Vectors.dense([1.0, 2.0, 3.0]),)], ["v"])
    with pytest.raises(Exception):
        W.principal_axes(uneven, "v", 1)
