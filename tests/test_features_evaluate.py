import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import evaluate as EV
from cohortkit.operators import features as FE


def test_zscore_population_std_null_safe(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "id int, a double, c double")
    out = {r.id: (r.a, r.c) for r in FE.fit_zscore(df, ["a", "c"]).transform(df).collect()}
    assert out[1] == (-1.0, 0.0) and out[2] == (1.0, 0.0) and out[3][0] is None  # zero variance -> scale 1


def test_median_imputer_exact_and_drops_empty(spark):
    df = spark.createDataFrame([(float(v), None) for v in (1, 2, 4, 10)] + [(None, None)], "a double, b double")
    imp, kept = FE.fit_median_imputer(df, ["a", "b"])
    assert kept == ["a"]
    out = imp.transform(df)
    assert "b" not in out.columns and sorted(r.a for r in out.collect())[2] == 3.0


def test_fold_local_imputation(spark):
    # an outlier placed in fold 1 must not change fold 0's fill value
    rows = [(0, float(v)) for v in (1, 2, 3)] + [(1, 1e9), (1, 2.0), (0, None)]
    df = spark.createDataFrame(rows, "fold int, a double")
    _, _ = FE.fit_median_imputer(df, ["a"])
    imp0, _ = FE.fit_median_imputer(df.filter("fold = 0"), ["a"])
    filled = imp0.transform(df.filter("fold = 0 AND a IS NULL")).first().a
    assert filled == 2.0


def test_feature_sets_and_unknown():
    assert FE.feature_set_columns("a-z", ["s1", "s2"], {"chief": "c", "diagnosis": "d"}) == ["s1", "s2", "c", "d"]
    with pytest.raises(ValueError):
        FE.feature_set_parts("q")


def _pred(spark, labels, scores, preds=None):
    preds = preds or [int(s >= 0.5) for s in scores]
    rows = [("s", "m", "train", 0, i, y, float(s), p) for i, (y, s, p) in enumerate(zip(labels, scores, preds))]
    return spark.createDataFrame(rows, "feature_set string, model string, split string, fold int, row_id long, "
                                       "label int, score double, pred int")


def _brute_auc(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_ties_single_class_and_brute_force(spark):
    assert EV.roc_auc(_pred(spark, [0, 1, 0, 1], [0.5] * 4)).first().AUC == 0.5
    assert EV.roc_auc(_pred(spark, [1, 1], [0.2, 0.9])).first().AUC is None
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 300).tolist()
    scores = np.round(rng.random(300), 2).tolist()
    df = _pred(spark, labels, scores)
    assert EV.roc_auc(df).first().AUC == pytest.approx(_brute_auc(labels, scores), abs=1e-12)
    assert EV.roc_auc(df, bucket_rows=7).first().AUC == pytest.approx(_brute_auc(labels, scores), abs=1e-12)


def test_zero_division_metrics(spark):
    m = EV.classification_metrics(_pred(spark, [1, 0, 1], [0.1, 0.2, 0.3], [0, 0, 0])).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)
    perfect = EV.evaluate(_pred(spark, [1, 0, 1, 0], [0.9, 0.1, 0.8, 0.2])).first()
    assert perfect.AUC == 1.0 and perfect.f1 == 1.0


def test_best_model_tie_goes_to_earlier_model(spark):
    df = spark.createDataFrame([("a-x", "RF", 0.9), ("a-x", "DT", 0.9), ("a-x", "LR", 0.5)],
                               "feature_set string, model string, AUC double")
    assert EV.best_model(df, "AUC").first().model == "DT"


def test_failed_runs_stay_visible(spark):
    grid = EV.run_grid(["a-x"], ["DT", "SVM"])
    res = spark.createDataFrame([("a-x", "DT", 0.7)], "feature_set string, model string, AUC double")
    out = {r.model: (r.AUC, r.status) for r in EV.with_status(grid, res).collect()}
    assert out == {"DT": (0.7, "ok"), "SVM": (None, "failed")}
    zero = {r.model: r.AUC for r in EV.with_status(grid, res, zero_fill=True).collect()}
    assert zero["SVM"] == 0.0


def test_has_missing_scalar_and_array(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0]), (2.0, [None, 1.0])], "a double, v array<double>")
    assert FE.has_missing(df, ["v"]) and not FE.has_missing(df, ["a"])


def test_csv_report_single_file(spark, tmp_path):
    import glob
    from cohortkit.sources import write_csv_report
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "variable string, score double").repartition(3)
    write_csv_report(df, str(tmp_path / "rep"))
    files = glob.glob(str(tmp_path / "rep" / "part-*.csv"))
    assert len(files) == 1 and open(files[0]).readline().strip() == "variable,score"


def test_median_is_exact_by_both_plans(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("few"), F.col("id").cast("double").alias("many"),
                                  F.when(F.col("id") % 3 == 0, F.col("id") * 0.1).alias("gaps"),
                                  F.when(F.col("id") == 5, 2.5).alias("one"), F.lit(None).cast("double").alias("none"))
    assert FE.wide_columns(df, ["few", "many"], limit=100) == {"many"}
    imp, kept = FE.fit_median_imputer(df, ["few", "many"])
    assert kept == ["few", "many"] and "3.0" in imp.getStatement() and "1499.5" in imp.getStatement()
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    by_count = FE.exact_quantiles(df, df.columns, probs, wide=())
    assert by_count["none"] is None
    assert FE.exact_quantiles(df.repartition(5), df.columns, probs, wide=df.columns) == by_count


def test_evaluate_in_one_pass_equals_its_parts(spark):
    rng = np.random.default_rng(3)
    labels, scores = rng.integers(0, 2, 200).tolist(), np.round(rng.random(200), 2).tolist()
    df = _pred(spark, labels, scores)
    both, rates = EV.evaluate(df).first(), EV.classification_metrics(df).first()
    assert both.AUC == EV.roc_auc(df).first().AUC
    assert [both[c] for c in ("precision", "recall", "f1", "accuracy")] == [rates[c] for c in ("precision", "recall", "f1", "accuracy")]


def test_loose_bound_of_scores_reads_the_predictions_once_and_keeps_all_groups(spark):
    """Few distinct scores under a large bound; group values beyond the known ones and null are groups too."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        read.add(1)
        return x

    rows = [(fs, m, "train", f, float((i * 7) % 5), i % 2, int((i * 7) % 5 > 2))
            for fs in ("x", "mine", None) for m in ("DT", "own") for f in (0, 1) for i in range(20 + f)]
    df = spark.createDataFrame(rows, "feature_set string, model string, split string, fold int, score double, label int, pred int")
    got = EV.evaluate(df.withColumn("label", counted("label")), max_group_scores=1_000_000).collect()
    assert read.value == len(rows)
    assert {(r.feature_set, r.model, r.split, r.fold) for r in got} == {r[:4] for r in rows} and len(got) == 12
    for r in got:
        of = [x for x in rows if x[:4] == (r.feature_set, r.model, r.split, r.fold)]
        pos, neg = [x[4] for x in of if x[5] == 1], [x[4] for x in of if x[5] == 0]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(r.AUC - auc) < 1e-12
        assert abs(r.accuracy - sum(x[5] == x[6] for x in of) / len(of)) < 1e-12
