"""Fold-batched logistic regression against one solver run a fit."""

import tempfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import foldfit as FF
from cohortkit.plans import study as ST
from conftest import SF001


def scores(spark, cfg, study):
    res = ST.run_study(spark, study, replace(cfg, out_dir=tempfile.mkdtemp(prefix="cohortkit-fit-")))
    assert {r.status for r in res["test_results"].collect()} == {"ok"}
    return {(r.feature_set, r.model, r.split, r.fold, r.row_id): r.score for r in res["predictions"].collect()}


@pytest.mark.parametrize("variant,scope,sets", [("optimised", "fold", ["a-x", "a-x,z"]), ("base", "train", ["a-x", "a-x,z"])])
def test_same_scores_as_single_fits(spark, variant, scope, sets):
    study = ST.document_study_table(spark, SF001, k=3).withColumn(
        "n_lines", F.when(F.col("row_id") % 4 != 0, F.col("n_lines")))  # missing values: medians of each fit
    cfg = ST.StudyConfig(variant=variant, feature_sets=sets, models=["LR", "SGD"], n_folds=3, text_width=16, pca_k=3,
                         fit_scope=scope, tol=1e-12)
    together, one_by_one = scores(spark, cfg, study), scores(spark, replace(cfg, batched=False), study)
    assert together.keys() == one_by_one.keys() and len(together) > 0
    assert max(abs(together[k] - one_by_one[k]) for k in together) < 1e-5


def table(spark, n=600, d=3, parts=1):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, d))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0, 0.0]) - 0.5)))).astype(float)
    rows = [(i, float(b), "train" if i % 5 else "test", i % 4 if i % 5 else -1, None, a.tolist())
            for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, label double, split string, fold int, fit int, x array<double>")
    return df.repartition(parts, "row_id"), x, y


def test_few_passes_and_no_trace_of_partitions(spark):
    fits = [0, 1, 2, 3, -1]
    weight, reg = {f: {0: 1.0, 1: 1.0} for f in fits}, {f: 0.01 for f in fits}
    runs = [FF.fit_folds(table(spark, parts=p)[0], fits, 3, {}, weight, reg) for p in (1, 7)]
    assert max(n for _, passes in runs for n in passes.values()) <= 12
    for f in fits:
        assert np.allclose(runs[0][0][f], runs[1][0][f], atol=1e-10)
    # optimality of one fit, on its own rows only
    _, x, y = table(spark)
    i = np.arange(len(y))
    mine = (i % 5 != 0) & (i % 4 != 2)
    b = runs[0][0][2]
    p = 1 / (1 + np.exp(-(x[mine] @ b[:-1] + b[-1])))
    gradient = x[mine].T @ (p - y[mine]) / mine.sum() + 0.01 * b[:-1]
    assert np.abs(gradient).max() < 1e-9 and abs((p - y[mine]).mean()) < 1e-9


def test_fits_take_turns_beyond_the_memory_bound(spark, monkeypatch):
    rows, _, _ = table(spark)
    args = ([0, 1, -1], 3, {}, {f: {0: 1.0, 1: 1.0} for f in (0, 1, -1)}, {f: 0.1 for f in (0, 1, -1)})
    whole, _ = FF.fit_folds(rows, *args)
    monkeypatch.setattr(FF, "PASS_BYTES", 1)
    single, _ = FF.fit_folds(rows, *args)
    assert all(np.allclose(whole[f], single[f], atol=1e-12) for f in whole)
