"""Exact trees against a plain search, across partitions, with persistence."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortkit.operators import exact_tree as ET
from cohortkit.operators.models import score_column


def brute(x, y, w, depth):
    """Leaf share of every row by a full search."""
    share = np.zeros(len(y))

    def grow(rows, d):
        one, all_ = w[rows][y[rows] == 1].sum(), w[rows].sum()
        share[rows] = one / all_
        if d == depth or one in (0, all_):
            return
        best = None
        for c in range(x.shape[1]):
            values = np.unique(x[rows, c])
            for a, b in zip(values[:-1], values[1:]):
                cut = a / 2 + b / 2
                sides = [rows[x[rows, c] <= a], rows[x[rows, c] > a]]
                gain = sum((w[s][y[s] == 0].sum() ** 2 + w[s][y[s] == 1].sum() ** 2) / w[s].sum() for s in sides)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, c, cut, sides)
        if best:
            for s in best[3]:
                grow(s, d + 1)

    grow(np.arange(len(y)), 0)
    return share


def frame(spark, x, y, w):
    rows = [(i, float(b), float(c), [float(v) for v in a]) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "row_id long, label double, weight double, a array<double>") \
        .withColumn("features", array_to_vector("a"))


def test_tree_equals_a_full_search(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 40, 150), np.round(rng.normal(size=150), 2)])
    y = ((x[:, 0] > 17) ^ (x[:, 1] > 0.3)).astype(int) ^ (rng.random(150) < 0.08)
    w = np.where(y == 1, 2.0, 1.0)
    df = frame(spark, x, y, w)
    want = brute(x, y, w, 4)
    for parts in (1, 6):
        model = ET.ExactTreeClassifier(weightCol="weight", maxDepth=4).fit(df.repartition(parts))
        got = {r.row_id: r.score for r in score_column(model.transform(df)).collect()}
        assert np.allclose([got[i] for i in range(150)], want)
    PipelineModel(stages=[model]).write().save(str(tmp_path / "t"))
    again = {r.row_id: r.score for r in score_column(PipelineModel.load(str(tmp_path / "t")).transform(df)).collect()}
    assert again == got


def test_leaves(spark):
    """One class, equal rows, no rows, missing values."""
    one = ET.ExactTreeClassifier().fit(frame(spark, np.arange(6).reshape(-1, 1), np.ones(6), np.ones(6)))
    assert one.getOrDefault("columns") == [-1] and one.getOrDefault("shares") == [1.0]
    same = ET.ExactTreeClassifier().fit(frame(spark, np.ones((4, 2)), np.array([0, 1, 1, 1]), np.ones(4)))
    assert same.getOrDefault("columns") == [-1] and same.getOrDefault("shares") == [0.75]
    none = ET.ExactTreeClassifier().fit(frame(spark, np.ones((2, 1)), np.ones(2), np.ones(2)).limit(0))
    assert none.getOrDefault("shares") == [0.0]
    x = np.array([[1.0], [2.0], [float("nan")], [float("nan")]])
    holes = ET.ExactTreeClassifier(maxDepth=2).fit(frame(spark, x, np.array([0, 1, 1, 1]), np.ones(4)))
    rows = score_column(holes.transform(frame(spark, x, np.ones(4), np.ones(4)))).orderBy("row_id").select(F.col("score")).collect()
    assert [r.score for r in rows] == [0.0, 1.0, 1.0, 1.0]
