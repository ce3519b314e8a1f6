"""End-to-end drivers: cohort description (E3), full retrain (E1), balanced
retrain (E2). Each step is a lazy plan; stage boundaries are Parquet tables in
the shared checkpoint folder, so a failed step can be rerun alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.operators import split as S
from cohortkit.plans import study as ST
from cohortkit.plans.cohort import cohort_report
from cohortkit.session import stage_path
from cohortkit.sources import write_labels, write_result_tables
from cohortkit.spec import CohortSpec


def describe_cohort(cleaned: DataFrame, spec: CohortSpec, out_dir: str | None = None, alpha: float = 0.05) -> dict:
    """E3: basic info, profiles, association screen and summary; optionally saved."""
    rep = cohort_report(cleaned, spec, alpha)
    if out_dir:
        write_result_tables({k: v for k, v in rep.items()}, out_dir)
    return rep


def _labels_stage(spark: SparkSession, study: DataFrame, out_dir: str) -> None:
    lab = study.select("row_id", "split", F.when(F.col("label") == 1, "Y").otherwise("N").alias("y"))
    enc = S.label_encoder(lab.filter("split = 'train'"), lab.filter("split = 'test'"), "y")
    write_labels(S.label_encode(lab, enc, "label_code"), enc, f"{out_dir}/labels")


def pipeline_retrain(spark: SparkSession, sf_dir: str, out_dir: str | None = None, threads: int = 8,
                     feature_sets=None, models=None) -> dict:
    """E1: load -> split -> features -> labels -> base study -> results and models."""
    out_dir = out_dir or stage_path(spark, "retrain", "base")
    study = ST.document_study_table(spark, sf_dir)
    _labels_stage(spark, study, out_dir)
    cfg = ST.StudyConfig(variant="base", threads=threads, out_dir=out_dir)
    if feature_sets:
        cfg.feature_sets = list(feature_sets)
    if models:
        cfg.models = list(models)
    res = ST.run_study(spark, study, cfg)
    write_result_tables({k: res[k] for k in ("cv_results", "test_results", "best_cv", "best_test")},
                        f"{out_dir}/results")
    return res


def pipeline_balanced_retrain(spark: SparkSession, sf_dir: str, out_dir: str | None = None, threads: int = 8,
                              feature_sets=None, models=None) -> dict:
    """E2: as E1 plus PCA of text vectors, class weights and SMOTE+Tomek on the
    text-only sets (fold training rows only), with the class ratio and PCA report."""
    out_dir = out_dir or stage_path(spark, "retrain", "optimised")
    study = ST.document_study_table(spark, sf_dir)
    ratio = study.groupBy("label").count()
    _labels_stage(spark, study, out_dir)
    cfg = ST.StudyConfig(variant="optimised", use_smote=True, threads=threads, out_dir=out_dir)
    if feature_sets:
        cfg.feature_sets = list(feature_sets)
    if models:
        cfg.models = list(models)
    res = ST.run_study(spark, study, cfg)
    tables = {k: res[k] for k in ("cv_results", "test_results", "best_cv", "best_test")}
    tables["class_ratio"] = ratio
    if res.get("pca_report") is not None:
        tables["pca_report"] = res["pca_report"]
    write_result_tables(tables, f"{out_dir}/results")
    return res
