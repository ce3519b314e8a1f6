"""Forests on binned cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import forest as FO


@pytest.fixture(scope="module")
def rows(spark):
    x = spark.range(4000).select(
        (F.hash("id", F.lit(1)) % 1000).cast("double").alias("strong"), (F.hash("id", F.lit(2)) % 1000).cast("double").alias("weak"),
        (F.pmod(F.col("id"), F.lit(3))).cast("double").alias("few"), F.lit(7.0).alias("same"), F.hash("id", F.lit(3)).alias("r"))
    return x.withColumn("label", ((F.col("strong") > 100) & (F.pmod(F.col("r"), F.lit(10)) > 1)).cast("double")).drop("r").cache()


def test_cells_hold_every_row_once_and_do_not_grow_with_the_rows(rows):
    cols = ["strong", "weak", "few", "same"]
    cuts = FO.bin_cuts(rows, cols, 4)
    assert cuts["few"] == [0.5, 1.5] and cuts["same"] == [] and len(cuts["strong"]) == 3
    one = FO.binned_cells(rows, cols, "label", 4)
    assert one.agg(F.sum("n")).first()[0] == 4000 and one.count() <= 2 * 4 * 4 * 3
    many = FO.binned_cells(rows.crossJoin(rows.sparkSession.range(5)).drop("id"), cols, "label", 4)
    assert many.agg(F.sum("n")).first()[0] == 20000 and many.count() == one.count()


def test_draws_are_poisson_and_hang_on_the_key_alone(spark):
    cells = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(1000).cast("long").alias("n"))
    get = lambda df: {r["id"]: (r["n"], r["d"]) for r in df.withColumn("d", FO.poisson_draws(F.xxhash64("id"), F.col("n"), 50)).collect()}
    a, b = get(cells.repartition(1)), get(cells.repartition(7))
    assert a == b
    for n in (1, 1000):
        d = np.array([x for m, x in a.values() if m == n])
        assert abs(d.mean() / n - 1) < 0.05 and abs(d.var() / n - 1) < 0.1


def test_forest_does_not_hang_on_where_rows_lie(rows):
    cols = ["strong", "weak", "few"]
    fit = lambda df: FO.fit_cell_forest(df, cols, n_trees=3, max_depth=4)
    a, b = fit(rows.repartition(1)), fit(rows.repartition(6, "weak"))
    x, y = a.featureImportances.toArray(), b.featureImportances.toArray()
    assert np.allclose(x, y, rtol=0, atol=1e-12) and abs(x.sum() - 1) < 1e-12 and x.argmax() == 0
    assert all(t.depth > 0 for t in a.trees)
