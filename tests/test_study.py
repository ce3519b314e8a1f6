import tempfile

from pyspark.sql import functions as F

from cohortkit.plans import study as ST
from conftest import SF001


def test_tiny_study_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="cohortkit-study-")
    tab = ST.document_study_table(spark, SF001, k=3).cache()
    cfg = ST.StudyConfig(variant="optimised", feature_sets=["a-x", "y"], models=["LR", "DT"], n_folds=3,
                         pca_k=5, use_smote=True, threads=4, out_dir=out)
    res = ST.run_study(spark, tab, cfg)
    test = res["test_results"].collect()
    assert len(test) == 4 and all(r.status == "ok" for r in test)
    assert all(0.0 <= r.AUC <= 1.0 for r in test if r.AUC is not None)
    # text sets are rebalanced only with more than k minority rows; what was left as it is shows in the note
    assert {r.feature_set: "not rebalanced" in r.note for r in test} == {"a-x": False, "y": True}
    preds = res["predictions"]
    n_train = tab.filter("split = 'train'").count()
    n_test = tab.filter("split = 'test'").count()
    per = {(r.feature_set, r.model, r.split): r["count"] for r in preds.groupBy("feature_set", "model", "split").count().collect()}
    assert all(per[(fs, m, "train")] == n_train and per[(fs, m, "test")] == n_test
               for fs in cfg.feature_sets for m in cfg.models)
    # a rerun resumes: nothing is refitted and the table is unchanged
    again = ST.run_study(spark, tab, cfg)
    assert again["predictions"].count() == preds.count()
    # a saved model reloads and reproduces its test scores
    feats, _, _ = ST.prepare_features(tab, cfg)
    scored = ST.batch_score(spark, f"{out}/models/a_x_LR", feats.filter("split = 'test'"))
    saved = preds.filter("feature_set = 'a-x' AND model = 'LR' AND split = 'test'")
    j = scored.select("row_id", F.col("score").alias("s1")).join(saved.select("row_id", F.col("score").alias("s2")), "row_id")
    assert j.filter(F.abs(F.col("s1") - F.col("s2")) > 1e-9).count() == 0 and j.count() == n_test


def test_retrain_drivers_write_stage_tables(spark):
    import os
    from cohortkit.plans.retrain import pipeline_balanced_retrain
    out = tempfile.mkdtemp(prefix="cohortkit-retrain-")
    res = pipeline_balanced_retrain(spark, SF001, out, threads=4, feature_sets=["z"], models=["SGD"])
    assert res["test_results"].first().status == "ok"
    for name in ("labels/labels", "labels/encoder", "results/cv_results", "results/test_results",
                 "results/class_ratio", "results/pca_report"):
        assert os.path.exists(os.path.join(out, name)), name
    codes = {r.y: r.label_code for r in spark.read.parquet(os.path.join(out, "labels/labels")).select("y", "label_code").distinct().collect()}
    assert codes == {"N": 0, "Y": 1}


def test_fold_scope_fits_without_the_held_out_fold(spark):
    tab = ST.document_study_table(spark, SF001, k=3).cache()
    cfg = ST.StudyConfig(variant="optimised", pca_k=4, fit_scope="fold", text_width=64)
    f0 = ST.fold_features(tab, 0, cfg)
    full = ST.fold_features(tab, -1, cfg)
    # same rows, same splits; the scaler was fitted without fold 0, so values differ
    assert f0.count() == full.count()
    assert f0.filter("split = 'test'").count() == full.filter("split = 'test'").count()
    a = {r.row_id: r.n_chars for r in f0.select("row_id", "n_chars").collect()}
    b = {r.row_id: r.n_chars for r in full.select("row_id", "n_chars").collect()}
    assert any(abs(a[k] - b[k]) > 1e-12 for k in a)
    out = tempfile.mkdtemp(prefix="cohortkit-fold-")
    cfg2 = ST.StudyConfig(variant="optimised", feature_sets=["a-y"], models=["SGD"], n_folds=3, pca_k=4,
                          fit_scope="fold", text_width=64, threads=4, out_dir=out)
    res = ST.run_study(spark, tab, cfg2)
    assert res["cv_results"].first().status == "ok"


def test_solver_limit_is_noted(spark):
    tab = ST.document_study_table(spark, SF001, k=3)
    cfg = ST.StudyConfig(feature_sets=["a-x"], svm_max_iter=1, rff_components=8)
    feats, _, _ = ST.prepare_features(tab, cfg)
    assert feats.columns == ["row_id", "split", "fold", "label", *ST.STRUCTURED]  # unused text columns are not encoded
    notes = []
    ST.fit_pipeline(feats.filter("split = 'train'"), "a-x", "SVM", cfg, notes=notes)
    assert notes == ["LinearSVCModel stopped at 1 iterations"]
