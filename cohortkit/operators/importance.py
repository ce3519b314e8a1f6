"""Per-variable association strength with the outcome, for ranking features.

Mutual information, one-way ANOVA F and Pearson correlation come from grouped
aggregates (one or two scans for all variables together); only the p-values
use the Arrow tail UDFs on one row per variable. Random-forest importance
comes from a fitted Spark ML forest.

The mutual-information estimator is the binned plug-in estimate: each variable
is cut into 10 bins, of equal width over its observed range or, with
``cut_at='quantile'``, between its exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.columns import qcol
from cohortkit.functions.special import f_sf_udf, t_two_sided_udf
from cohortkit.operators.features import exact_quantiles
from cohortkit.operators.profile import describe_by_group
from cohortkit.spec import CohortSpec

MI_BINS = 10


def _binary(spec: CohortSpec) -> F.Column:
    return F.when(qcol(spec.label) == spec.positive, 1.0).when(qcol(spec.label) == spec.negative, 0.0)


def mutual_information(df: DataFrame, spec: CohortSpec, variables, bins: int = MI_BINS, cut_at: str = "width") -> DataFrame:
    """I(X; Y) in nats from bins, per variable (rows with X and Y present).

    ``cut_at='quantile'``: a value's bin is the number of quantiles (1/bins, 2/bins, ...) below it, so that ties stay
    together and a variable of few values has fewer bins. The quantiles are exact at any size.
    """
    variables = list(variables)
    lab = df.filter(qcol(spec.label).isin(spec.positive, spec.negative))
    if cut_at == "quantile":
        cuts = exact_quantiles(lab, variables, [j / bins for j in range(1, bins)])
        pairs = []
        for v in variables:
            x, below = qcol(v).cast("double"), F.lit(0)
            for c in sorted(set(cuts[v] or [])):
                below = below + (x > F.lit(float(c))).cast("int")
            pairs.append(F.struct(F.lit(v).alias("variable"), F.when(x.isNotNull(), below).alias("bin")))
        return _information(lab, spec, variables, pairs)
    rng = lab.agg(*[F.min(qcol(v).cast("double")).alias(f"lo{i}") for i, v in enumerate(variables)],
                  *[F.max(qcol(v).cast("double")).alias(f"hi{i}") for i, v in enumerate(variables)]).first()
    pairs = []
    for i, v in enumerate(variables):
        lo, hi = rng[f"lo{i}"], rng[f"hi{i}"]
        x = qcol(v).cast("double")
        if lo is None:
            b = F.lit(None).cast("int")
        elif hi == lo:
            b = F.when(x.isNotNull(), F.lit(0))
        else:
            # least() skips NULLs, so guard missing values explicitly
            b = F.when(x.isNotNull(),
                       F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1)).cast("int"))
        pairs.append(F.struct(F.lit(v).alias("variable"), b.alias("bin")))
    return _information(lab, spec, variables, pairs)


def _information(lab: DataFrame, spec: CohortSpec, variables, pairs) -> DataFrame:
    """Mutual information from one (variable, bin) struct a variable."""
    cells = (lab.select(qcol(spec.label).alias("y"), F.inline(F.array(*pairs)))
             .filter(F.col("bin").isNotNull())
             .groupBy("variable", "bin", "y").agg(F.count(F.lit(1)).alias("n")))
    # cells: variables x bins x 2 rows -> windows over a tiny table
    wv = Window.partitionBy("variable")
    c = (cells.withColumn("tot", F.sum("n").over(wv))
         .withColumn("nb", F.sum("n").over(Window.partitionBy("variable", "bin")))
         .withColumn("ny", F.sum("n").over(Window.partitionBy("variable", "y"))))
    term = (F.col("n") / F.col("tot")) * F.log((F.col("n").cast("double") * F.col("tot")) / (F.col("nb").cast("double") * F.col("ny")))
    out = c.groupBy("variable").agg(F.sum(term).alias("mutual_information"))
    names = lab.sparkSession.createDataFrame([(v,) for v in variables], "variable string")
    return names.join(out, "variable", "left").select(
        "variable", F.coalesce("mutual_information", F.lit(0.0)).alias("mutual_information"))


def f_statistic(profile: DataFrame, spec: CohortSpec) -> DataFrame:
    """One-way ANOVA F between the outcome groups and its p-value, from the profile."""
    g = profile.filter(F.col("grp").isin(spec.positive, spec.negative) & (F.col("count") > 0))
    per = g.groupBy("variable").agg(
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("count") * F.col("mean")).alias("sx"),
        F.sum(F.col("count") * F.col("mean") * F.col("mean")).alias("sxx_between"),
        F.sum(F.coalesce((F.col("count") - 1) * F.col("std") * F.col("std"), F.lit(0.0))).alias("ss_within"))
    grand = F.try_divide(F.col("sx"), F.col("n").cast("double"))
    ss_between = F.col("sxx_between") - F.col("n") * grand * grand
    fstat = F.try_divide(F.try_divide(ss_between, (F.col("k") - 1).cast("double")),
                         F.try_divide(F.col("ss_within"), (F.col("n") - F.col("k")).cast("double")))
    out = per.select("variable", F.when(F.col("k") >= 2, fstat).alias("f_statistic"),
                     (F.col("k") - 1).cast("double").alias("d1"), (F.col("n") - F.col("k")).cast("double").alias("d2"))
    return out.select("variable", "f_statistic",
                      f_sf_udf(F.col("f_statistic"), F.col("d1"), F.col("d2")).alias("f_p_value"))


def correlation(df: DataFrame, spec: CohortSpec, variables) -> DataFrame:
    """Pearson r with the 0/1 outcome (pairwise complete rows) and its t-test p-value."""
    variables = list(variables)
    y = _binary(spec)
    lab = df.filter(y.isNotNull())
    aggs = []
    for i, v in enumerate(variables):
        x = qcol(v).cast("double")
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count(x).alias(f"n{i}")]
    wide = lab.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
                     for i, v in enumerate(variables)])
    long = wide.select(F.inline(rows))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1.0 - F.col("r") * F.col("r")))
    return long.select("variable", F.col("r").alias("correlation"),
                       t_two_sided_udf(t, (F.col("n") - 2).cast("double")).alias("corr_p_value"))


def random_forest_importance(model, feature_names) -> DataFrame:
    """Impurity importances of a fitted forest (one value per feature)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(feature_names, [float(v) for v in imp])),
                                 "variable string, rf_importance double")


def rank_features(scores: DataFrame, score_col: str, rank_col: str = "rank") -> DataFrame:
    """1-based rank by descending score (ties by name); one row per feature."""
    return scores.withColumn(rank_col, F.row_number().over(Window.orderBy(F.desc(score_col), "variable")))


def importance_comparison(mi: DataFrame, f: DataFrame, corr: DataFrame, rf: DataFrame | None = None) -> DataFrame:
    """All measures per feature (importances default 0, p-values default 1), by MI."""
    out = mi.join(f, "variable", "left").join(corr, "variable", "left")
    if rf is not None:
        out = out.join(rf, "variable", "left")
    else:
        out = out.withColumn("rf_importance", F.lit(None).cast("double"))
    return out.select(
        "variable", F.coalesce("rf_importance", F.lit(0.0)).alias("rf_importance"),
        F.coalesce("mutual_information", F.lit(0.0)).alias("mutual_information"),
        F.coalesce("f_statistic", F.lit(0.0)).alias("f_statistic"),
        F.coalesce("correlation", F.lit(0.0)).alias("correlation"),
        F.coalesce("f_p_value", F.lit(1.0)).alias("f_p_value"),
        F.coalesce("corr_p_value", F.lit(1.0)).alias("corr_p_value"),
    ).orderBy(F.desc("mutual_information"), "variable")


def dataset_info(df: DataFrame, spec: CohortSpec, n_features: int) -> DataFrame:
    """Rows, positives, positive share (%), feature count."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.count_if(qcol(spec.label) == spec.positive).cast("bigint").alias("n_positive")) \
        .withColumn("positive_pct", F.round(F.try_divide(F.col("n_positive") * 100.0, F.col("n_rows").cast("double")), 2)) \
        .withColumn("n_features", F.lit(n_features))


def importance_table(df: DataFrame, spec: CohortSpec, variables=None, rf=None) -> DataFrame:
    variables = list(variables or spec.numeric)
    prof = describe_by_group(df, spec, variables)
    return importance_comparison(mutual_information(df, spec, variables), f_statistic(prof, spec),
                                 correlation(df, spec, variables), rf)
