"""Evaluation from a predictions table.

predictions: (feature_set, model, split, fold, row_id, label, score, pred).
Every metric of every (set, model, split, fold) comes out of grouped
aggregates over that one table, so 539 fits are scored in two jobs instead
of 2,156 small ones.

ROC AUC is the exact rank statistic with ties counted one half:
AUC = sum over positives of (#negatives scored lower + 0.5 * #negatives tied)
/ (P * N). The running count of negatives is a prefix sum; to avoid one task
per very large group, its distinct scores are cut into order-preserving
buckets (global approximate quantiles; the cut points only balance work,
exactness does not depend on them), bucket totals are prefix-summed on a
small table, and the window runs inside a (group, bucket) only. Unless no group
can be that large, the counts per score are written once and measured, so that the
predictions are read in one pass.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.formatting import format_metric_pm
from cohortkit.operators.features import FEATURE_SETS
from cohortkit.session import stage_path

# Model families in report order, and the metrics reported.
MODEL_ORDER = ("DT", "SVM", "RF", "ANN", "LR", "NN", "SGD")
METRICS = ("AUC", "precision", "recall", "f1")
GROUP = ("feature_set", "model", "split", "fold")
#: Group values that are counted under a number; others are counted under their text.
LEVELS = {"feature_set": tuple(FEATURE_SETS), "model": MODEL_ORDER, "split": ("train", "test")}


def confusion(pred: DataFrame, group_cols=GROUP, label: str = "label", pred_col: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred_col)
    return pred.groupBy(*group_cols).agg(
        F.count_if((p == 1) & (y == 1)).cast("bigint").alias("tp"),
        F.count_if((p == 1) & (y == 0)).cast("bigint").alias("fp"),
        F.count_if((p == 0) & (y == 1)).cast("bigint").alias("fn"),
        F.count_if((p == 0) & (y == 0)).cast("bigint").alias("tn"))


def _zero_div(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def classification_metrics(pred: DataFrame, group_cols=GROUP, label: str = "label",
                           pred_col: str = "pred") -> DataFrame:
    """precision, recall, f1 for class 1 (0 when undefined) and accuracy."""
    c = confusion(pred, group_cols, label, pred_col)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*group_cols, *_rates(tp, fp, fn, tn))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list:
    return [_zero_div(tp, tp + fp).alias("precision"),
            _zero_div(tp, tp + fn).alias("recall"),
            _zero_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
            F.try_divide((tp + tn).cast("double"), (tp + tn + fp + fn).cast("double")).alias("accuracy")]


def roc_auc(pred: DataFrame, group_cols=GROUP, label: str = "label", score: str = "score",
            max_group_scores: int | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """Exact ROC AUC per group (NULL when a group has a single class).

    ``max_group_scores``: a bound of the number of distinct scores in one group, when
    known; where it is not, or allows more than ``bucket_rows``, the number is measured. Groups up to
    ``bucket_rows`` distinct scores use one window partition each; larger ones
    are split into order-preserving buckets.
    """
    g = list(group_cols)
    dist = _score_counts(pred, g, score, {"__pos": F.col(label) == 1, "__neg": F.col(label) == 0})
    return _auc_of_scores(dist, g, max_group_scores, bucket_rows).select(*g, "AUC")


def _score_counts(pred: DataFrame, g: list, score: str, cells: dict) -> DataFrame:
    """Rows of each cell per (group, score). Text of LEVELS is grouped as one number: a short key for every row."""
    coded = [c for c in g if c in LEVELS and pred.schema[c].dataType.typeName() == "string"]
    code, known = F.lit(0), F.lit(True)
    for i, c in enumerate(coded):
        at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in LEVELS[c]]), F.col(c)), F.lit(0)).cast("int")
        code, known = code.bitwiseOR(F.shiftleft(at, 8 * i)), known & (at > 0)
    plain = [c for c in g if c not in coded]
    keys = [*plain, F.col(score).cast("double").alias("__s")]
    if coded:
        keys += [code.alias("__code"), F.when(~known, F.struct(*coded)).alias("__other")]
    counts = pred.groupBy(*keys).agg(*[F.count_if(x).alias(c) for c, x in cells.items()])
    back = {c: F.when(F.col("__other").isNotNull(), F.col("__other")[c]).otherwise(
        F.get(F.array(*[F.lit(v) for v in LEVELS[c]]), F.shiftright("__code", 8 * i).bitwiseAND(255) - 1))
        for i, c in enumerate(coded)}
    return counts.select(*[back[c].alias(c) if c in back else c for c in g], "__s", *cells)


def _auc_of_scores(dist: DataFrame, g: list, max_group_scores: int | None, bucket_rows: int = 100_000,
                   sums=()) -> DataFrame:
    """AUC per group, and the totals of ``sums``, from one row per (group, score) with __s, __pos, __neg."""
    n_groups = None
    if max_group_scores is None or max_group_scores > bucket_rows:
        path = stage_path(dist.sparkSession, "score-counts", uuid.uuid4().hex)
        dist.write.parquet(path)
        dist = dist.sparkSession.read.parquet(path)
        sizes = dist.groupBy(*g).count().agg(F.max("count"), F.count(F.lit(1))).first()  # reduced to one row
        max_group_scores, n_groups = int(sizes[0] or 0), int(sizes[1] or 0)
    n_buckets = int(max(1, -(-max_group_scores // bucket_rows)))
    if n_buckets == 1:
        w = Window.partitionBy(*g).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        d4 = dist.withColumn("__contrib", F.col("__pos") * (F.coalesce(F.sum("__neg").over(w), F.lit(0))
                                                             + 0.5 * F.col("__neg")))
    else:
        from pyspark.ml.feature import Bucketizer
        # order-preserving buckets from global quantiles of the distinct scores:
        # at most n_buckets - 1 cut points reach the driver
        cuts = dist.approxQuantile("__s", [i / n_buckets for i in range(1, n_buckets)], 1.0 / n_buckets)
        splits = [float("-inf"), *sorted(set(c for c in cuts if c == c)), float("inf")]
        d2 = Bucketizer(splits=splits, inputCol="__s", outputCol="__bk", handleInvalid="keep").transform(dist)
        per = d2.groupBy(*g, "__bk").agg(F.sum("__neg").alias("__bn"))
        wb = Window.partitionBy(*g).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
        prefix = per.withColumn("__before", F.coalesce(F.sum("__bn").over(wb), F.lit(0))).drop("__bn")
        # prefix: groups x n_buckets rows; broadcast only when that bound is known and small
        if n_groups is not None and n_groups * n_buckets <= 2_000_000:
            prefix = F.broadcast(prefix)
        d3 = d2.join(prefix, [*g, "__bk"])
        wi = Window.partitionBy(*g, "__bk").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
        below = F.col("__before") + F.coalesce(F.sum("__neg").over(wi), F.lit(0))
        d4 = d3.withColumn("__contrib", F.col("__pos").cast("double") * (below + 0.5 * F.col("__neg")))
    res = d4.groupBy(*g).agg(F.sum("__contrib").alias("__c"), F.sum("__pos").alias("__p"), F.sum("__neg").alias("__n"),
                             *[F.sum(c).alias(c) for c in sums])
    ok = (F.col("__p") > 0) & (F.col("__n") > 0)
    return res.select(*g, *sums, F.when(ok, F.col("__c") / (F.col("__p").cast("double") * F.col("__n"))).alias("AUC"))


def evaluate(pred: DataFrame, group_cols=GROUP, max_group_scores: int | None = None) -> DataFrame:
    """AUC, precision, recall, f1, accuracy per group.

    One pass: the (group, score) counts carry the confusion counts too.
    """
    g = list(group_cols)
    y, p = F.col("label"), F.col("pred")
    cells = {"tp": (p == 1) & (y == 1), "fp": (p == 1) & (y == 0), "fn": (p == 0) & (y == 1), "tn": (p == 0) & (y == 0)}
    dist = _score_counts(pred, g, "score", {"__pos": y == 1, "__neg": y == 0, **cells})
    out = _auc_of_scores(dist, g, max_group_scores, sums=tuple(cells))
    return out.select(*g, "AUC", *_rates(*[F.col(c) for c in cells]))


def cv_aggregate(fold_metrics: DataFrame, by=("feature_set", "model"), metrics=METRICS) -> DataFrame:
    """Mean and population std of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*by).agg(*aggs)


def model_order_col(model: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), model)


def best_model(results: DataFrame, metric: str, by: str = "feature_set") -> DataFrame:
    """Row with the highest ``metric`` per ``by``; ties go to the earlier model."""
    w = Window.partitionBy(by).orderBy(F.col(metric).desc_nulls_last(), model_order_col(F.col("model")))
    return results.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def cv_summary_table(cv: DataFrame, metrics=METRICS) -> DataFrame:
    """'mean ± std' strings per metric."""
    return cv.select("feature_set", "model", *[format_metric_pm(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m)
                                               for m in metrics])


def test_summary_table(test: DataFrame, metrics=METRICS, digits: int = 4) -> DataFrame:
    return test.select("feature_set", "model", *[F.round(F.col(m), digits).alias(m) for m in metrics])


def run_grid(feature_sets, models=MODEL_ORDER) -> DataFrame:
    """Every feature set x every model, as a small config table (no join)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(fs, i, m, j) for i, fs in enumerate(feature_sets) for j, m in enumerate(models)]
    return spark.createDataFrame(rows, "feature_set string, set_order int, model string, model_order int")


def with_status(grid: DataFrame, results: DataFrame, zero_fill: bool = False) -> DataFrame:
    """Left-join results onto the run grid: failed runs keep a row with status
    'failed' and NULL metrics (or zeros when ``zero_fill``, the reference's policy)."""
    metric_cols = [c for c in results.columns if c not in ("feature_set", "model")]
    j = grid.join(results, ["feature_set", "model"], "left")
    ok = F.col(metric_cols[0]).isNotNull() if metric_cols else F.lit(True)
    out = j.withColumn("status", F.when(ok, "ok").otherwise("failed"))
    if zero_fill:
        out = out.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in metric_cols else F.col(c)
                           for c in out.columns])
    return out


def compare_studies(base: DataFrame, optimised: DataFrame, metrics=METRICS) -> DataFrame:
    """Full outer join of two result tables with before / after / delta columns."""
    b = base.select("feature_set", "model", *[F.col(m).alias(f"{m}_base") for m in metrics])
    o = optimised.select("feature_set", "model", *[F.col(m).alias(f"{m}_opt") for m in metrics])
    j = b.join(o, ["feature_set", "model"], "full_outer")
    return j.select("feature_set", "model", *[c for m in metrics for c in (
        F.col(f"{m}_base"), F.col(f"{m}_opt"), (F.col(f"{m}_opt") - F.col(f"{m}_base")).alias(f"{m}_delta"))])
