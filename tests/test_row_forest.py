"""Forests whose small nodes are finished in one task."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortkit.operators import row_forest as RF
from cohortkit.operators.models import make_model, score_column


@pytest.fixture(scope="module")
def rows(spark):
    def part(j, n):
        return F.pmod(F.hash("id", F.lit(j)), F.lit(n)).cast("double")

    x = spark.range(3000).select("id", F.array(part(1, 1000), part(2, 1000), part(3, 5), F.lit(7.0)).alias("x"), part(4, 10).alias("noise"))
    label = (((F.col("x")[0] > 600) | (F.col("x")[2] == 1.0)) & (F.col("noise") > 0)).cast("double")
    return x.withColumn("label", label).select(
        "id", "x", array_to_vector("x").alias("features"), "label", F.when(F.col("label") == 1, 1.7).otherwise(0.6).alias("weight")).cache()


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(s[c], t[c]) for s, t in zip(a, b) for c in s)


def test_passes_hang_on_large_nodes_and_not_on_the_depth(rows, monkeypatch):
    passes, split = [], RF._split_level
    monkeypatch.setattr(RF, "_split_level", lambda cells, open_, *more: passes.append(len(open_)) or split(cells, open_, *more))
    whole, width = RF.fit_rows(rows, 4, 8)
    assert passes == [] and width == 4 and max(len(t["column"]) for t in whole) > 40
    # the same trees, whether a node is split by a pass or by the task that has its rows
    parted, _ = RF.fit_rows(rows, 4, 8, finish_rows=700)
    assert 2 <= len(passes) <= 8 and passes[0] == 4 and sum(passes) < 100 and same(whole, parted)
    # down to the last level, and with sums that do not fit a pass
    monkeypatch.setattr(RF, "PASS_BYTES", 1)
    assert same(RF.fit_rows(rows, 1, 2)[0], RF.fit_rows(rows, 1, 2, finish_rows=0)[0])


def test_forest_does_not_hang_on_where_rows_lie(rows):
    score = lambda df: {r["id"]: r["score"] for r in score_column(
        make_model("RF", 4, 3000).fit(df).transform(rows)).select("id", "score").collect()}
    assert score(rows.repartition(1)) == score(rows.repartition(5, "x"))


def test_scores_are_those_of_a_forest_and_outlive_the_model(spark, rows):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    model = RF.RowForestClassifier(numTrees=20, maxDepth=8, weightCol="weight").fit(train)
    theirs = RandomForestClassifier(numTrees=20, maxDepth=8, maxBins=256, featureSubsetStrategy="sqrt", weightCol="weight", seed=1).fit(train)
    area = BinaryClassificationEvaluator()
    got = model.transform(test)
    assert abs(area.evaluate(got) - area.evaluate(theirs.transform(test))) < 0.03
    a, b = model.featureImportances.toArray(), theirs.featureImportances.toArray()
    assert np.abs(a - b).max() < 0.1 and abs(a.sum() - 1) < 1e-9 and a[3] == 0
    assert 0.7 < model.totalNumNodes / theirs.totalNumNodes < 1.4
    path = tempfile.mkdtemp(prefix="cohortkit-rf-") + "/m"
    PipelineModel(stages=[model]).write().overwrite().save(path)
    p = vector_to_array("probability")[1]
    again = PipelineModel.load(path).transform(test).select("id", p.alias("q"), F.col("prediction").alias("r"))
    joined = got.select("id", p.alias("p"), "prediction").join(again, "id")
    assert joined.filter("p = q AND prediction = r AND (prediction = 1) = (p > 0.5)").count() == test.count()


def test_best_cut_is_the_one_of_least_gini():
    rng = np.random.default_rng(0)
    zero, one = rng.integers(0, 4, (2, 6, 3, 5)).astype(float)
    one[4] = 0  # pure
    zero[5, :, 1:] = one[5, :, 1:] = 0  # one value in the column
    for of in (zero, one):  # each column deals out the same rows
        of[:5, 1], of[:5, 2] = of[:5, 0, ::-1], of[:5, 0][:, [2, 0, 4, 1, 3]]
        of[5] = of[5, :1]
    found, column, cut = RF.best_cuts(zero, one)

    def gini(n, j, c):
        side = [(zero[n, j, of].sum(), one[n, j, of].sum()) for of in (slice(0, c + 1), slice(c + 1, None))]
        return sum(2 * a * b / (a + b) for a, b in side) if all(a + b for a, b in side) else np.inf

    for n in range(4):
        assert found[n] and np.isclose(gini(n, column[n], cut[n]), min(gini(n, j, c) for j in range(3) for c in range(4)))
    assert not found[4] and not found[5]


def test_leaves_of_one_class_are_merged_from_below():
    nodes = {"id": [1, 2, 3, 4, 5, 6, 7], "column": [0, 0, 0, -1, -1, -1, -1], "cut": [0] * 7,
             "zero": [9.0, 6, 3, 4, 2, 3, 0], "one": [5.0, 2, 3, 1, 1, 0, 3]}
    out = RF.pruned({k: np.array(v) for k, v in nodes.items()})
    assert out["id"].tolist() == [1, 2, 3, 6, 7] and out["column"].tolist() == [0, -1, 0, -1, -1]


def test_copies_are_drawn_and_odd_rows_refused(spark, rows):
    cuts = RF.vector_cuts(rows, 4)
    assert [len(c) for c in cuts[2:]] == [4, 0] and 200 < len(cuts[0]) < 256
    once = RF.drawn_cells(rows, cuts, 3, 42, 2)
    cells = RF.drawn_cells(rows.crossJoin(spark.range(4).select(F.col("id").alias("copy"))), cuts, 3, 42, 2)
    assert cells.count() == once.count() and cells.agg(F.sum("n")).first()[0] == 12000
    total = cells.agg(F.sum(F.col("draws")[0])).first()[0]
    assert abs(total / 12000 - 1) < 0.05
    with pytest.raises(ValueError):
        RF.fit_rows(rows.filter("id < 0"), 2, 2)
    with pytest.raises(ValueError):
        RF.fit_rows(rows.withColumn("label", F.lit(2.0)), 2, 2)


def test_one_class_and_few_rows(rows):
    one = RF.RowForestClassifier(numTrees=5).fit(rows.filter("label = 1").limit(2))
    out = one.transform(rows.limit(3)).select(vector_to_array("probability")[1].alias("p"), "prediction").collect()
    assert {(r["p"], r["prediction"]) for r in out} == {(1.0, 1.0)}
