"""Profiling: descriptive statistics, class counts, cross-tabs, distinct counts.

Scale notes
-----------
* ``describe_by_group`` is one scan: a wide aggregate grouped by label with
  partial aggregation map-side, merged into the 'all' row; the result (one row
  a label) is unpivoted afterwards, never the input.
* Cross-tabs aggregate (variable, value, label) with map-side combine; their
  output is bounded by the number of distinct values, so windows over it
  (row percentages) run on a tiny table.
* ``distinct_count`` is exact at any number: (variable, value) groups, combined
  before the shuffle, then counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortkit.functions.columns import qcol
from cohortkit.operators.features import exact_quantiles
from cohortkit.spec import CATEGORICAL_MAX_DISTINCT, CohortSpec

ALL_GROUP = "all"
PROFILE_COLUMNS = ["grp", "variable", "min", "max", "mean", "std", "count", "missing", "missing_ratio"]


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NumericType)


def _stat_aggs(df: DataFrame, variables) -> list:
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(variables):
        x = qcol(c)
        if _is_numeric(df, c):
            xd = x.cast("double")
            aggs += [F.min(xd).alias(f"mn{i}"), F.max(xd).alias(f"mx{i}"),
                     F.avg(xd).alias(f"av{i}"), F.stddev_samp(xd).alias(f"sd{i}")]
        else:
            nul = F.lit(None).cast("double")
            aggs += [F.first(nul).alias(f"mn{i}"), F.first(nul).alias(f"mx{i}"),
                     F.first(nul).alias(f"av{i}"), F.first(nul).alias(f"sd{i}")]
        aggs.append(F.count(x).alias(f"ct{i}"))
    return aggs


def _unpivot_stats(wide: DataFrame, variables, grp_col) -> DataFrame:
    rows = F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(c).alias("variable"),
        F.col(f"mn{i}").alias("min"), F.col(f"mx{i}").alias("max"),
        F.col(f"av{i}").alias("mean"), F.col(f"sd{i}").alias("std"),
        F.col(f"ct{i}").cast("bigint").alias("count"),
        (F.col("__n") - F.col(f"ct{i}")).cast("bigint").alias("missing"),
        F.try_divide((F.col("__n") - F.col(f"ct{i}")) * 100.0, F.col("__n").cast("double")).alias("missing_ratio"),
    ) for i, c in enumerate(variables)])
    return wide.select(grp_col.alias("grp"), F.inline(rows))


def describe_numeric(df: DataFrame, variables) -> DataFrame:
    """min, max, mean, sample std, count, missing, missing % per variable (grp='all')."""
    variables = list(variables)
    wide = df.agg(*_stat_aggs(df, variables))
    return _unpivot_stats(wide, variables, F.lit(ALL_GROUP)).orderBy("ord").drop("ord")


def describe_by_group(df: DataFrame, spec: CohortSpec, variables=None) -> DataFrame:
    """The profile for all rows and for each outcome group, in one scan.

    Groups: 'all', spec.positive, spec.negative (absent groups yield no rows).
    The scan is a plain GROUP BY label (no Expand of the input); the 'all' row
    is merged from the per-label sufficient statistics (count, mean, M2 with
    the parallel-variance formula) on the tiny grouped table.
    """
    return _grouped_profile(df, spec, variables)


def _grouped_profile(df: DataFrame, spec: CohortSpec, variables=None) -> DataFrame:
    variables = list(variables or spec.variables)
    numeric = [_is_numeric(df, c) for c in variables]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(variables):
        x = qcol(c).cast("double") if numeric[i] else qcol(c)
        aggs.append(F.count(x).alias(f"ct{i}"))
        if numeric[i]:
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"av{i}"),
                     (F.var_pop(x) * F.count(x)).alias(f"m2{i}")]
    per_label = df.groupBy(qcol(spec.label).alias("__label")).agg(*aggs)
    # per_label has one row per label value (a binary outcome plus NULL): the
    # windows below run on that tiny table, in the same pipeline as the scan
    everything = Window.partitionBy()
    first = [F.row_number().over(Window.orderBy(F.col("__label").asc_nulls_first())).alias("__rn"),
             F.sum("__n").over(everything).alias("__tn")]
    for i, _ in enumerate(variables):
        first.append(F.sum(f"ct{i}").over(everything).alias(f"tct{i}"))
        if numeric[i]:
            first += [F.try_divide(F.sum(F.col(f"ct{i}") * F.col(f"av{i}")).over(everything),
                                   F.sum(f"ct{i}").over(everything).cast("double")).alias(f"tav{i}"),
                      F.min(f"mn{i}").over(everything).alias(f"tmn{i}"),
                      F.max(f"mx{i}").over(everything).alias(f"tmx{i}")]
    t = per_label.select("*", *first)
    t = t.select("*", *[F.sum(F.col(f"m2{i}") + F.coalesce(F.col(f"ct{i}") * F.pow(F.col(f"av{i}") - F.col(f"tav{i}"), 2),
                                                          F.lit(0.0))).over(everything).alias(f"tm2{i}")
                        for i, _ in enumerate(variables) if numeric[i]])

    def row(kind, i, c, p):
        n, ct = F.col("__tn" if p == "t" else "__n"), F.col(f"{p}ct{i}")
        if numeric[i]:
            mn, mx, av = F.col(f"{p}mn{i}"), F.col(f"{p}mx{i}"), F.col(f"{p}av{i}")
            sd = F.when(ct > 1, F.sqrt(F.try_divide(F.col(f"{p}m2{i}"), (ct - 1).cast("double"))))
        else:
            mn = mx = av = sd = F.lit(None).cast("double")
        fields = [F.lit(kind).alias("kind"), F.lit(i).alias("ord"), F.lit(c).alias("variable"),
                  mn.alias("min"), mx.alias("max"), av.alias("mean"), sd.alias("std"),
                  ct.cast("bigint").alias("count"), (n - ct).cast("bigint").alias("missing"),
                  F.try_divide((n - ct) * 100.0, n.cast("double")).alias("missing_ratio")]
        return F.struct(*fields)

    own = [row(0, i, c, "") for i, c in enumerate(variables)]
    tot = [row(1, i, c, "t") for i, c in enumerate(variables)]
    out = (t.select("__label", "__rn", F.inline(F.array(*own, *tot)))
           .filter(((F.col("kind") == 0) & F.col("__label").isin(spec.positive, spec.negative))
                   | ((F.col("kind") == 1) & (F.col("__rn") == 1))))
    grp = F.when(F.col("kind") == 1, F.lit(ALL_GROUP)).otherwise(F.col("__label"))
    out = out.select(grp.alias("grp"), "ord", "variable", "min", "max", "mean", "std", "count", "missing",
                     "missing_ratio")
    order = F.when(F.col("grp") == ALL_GROUP, 0).when(F.col("grp") == spec.positive, 1).otherwise(2)
    return out.orderBy(order, "ord").drop("ord")


def cohort_basic_info(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Total rows, case/control counts, sorted distinct labels, case percentage."""
    label = qcol(spec.label)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_samples"),
        F.count_if(label == spec.positive).cast("bigint").alias("n_case"),
        F.count_if(label == spec.negative).cast("bigint").alias("n_control"),
        # bounded by the label's cardinality (a binary outcome)
        F.sort_array(F.collect_set(label)).alias("labels"),
    ).withColumn("case_pct", F.round(F.try_divide(F.col("n_case") * 100.0, F.col("total_samples").cast("double")), 2)) \
     .withColumn("ratio_control_case", F.round(F.try_divide(F.col("n_control").cast("double"), F.col("n_case").cast("double")), 2))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per non-null value, most frequent first (ties by value)."""
    c = qcol(column)
    return (df.filter(c.isNotNull()).groupBy(c.alias("value")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy(F.desc("n"), "value"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, ascending class."""
    return (df.groupBy(qcol(label).alias("label")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy("label"))


def crosstab(df: DataFrame, variable: str, label: str) -> DataFrame:
    """value x label counts; rows with a NULL in either are dropped."""
    v, y = qcol(variable), qcol(label)
    return (df.filter(v.isNotNull() & y.isNotNull())
            .groupBy(v.alias("value"), y.alias("label"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def crosstab_margins(df: DataFrame, variable: str, label: str) -> DataFrame:
    """Cross-tab with row, column and grand totals via CUBE.

    ``value_total`` / ``label_total`` flag the margin rows.
    """
    v, y = qcol(variable), qcol(label)
    return (df.filter(v.isNotNull() & y.isNotNull())
            .select(v.alias("value"), y.alias("label"))
            .cube("value", "label")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.grouping("value").cast("boolean").alias("value_total"),
                 F.grouping("label").cast("boolean").alias("label_total")))


def crosstab_row_pct(df: DataFrame, variable: str, label: str) -> DataFrame:
    """Share (%) of each label within each value (rows sum to 100)."""
    ct = crosstab(df, variable, label)
    w = Window.partitionBy("value")  # the cross-tab is tiny: one row per (value, label)
    return ct.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(w))


def within_group_distribution(df: DataFrame, variable: str, spec: CohortSpec) -> DataFrame:
    """Share (%) of each value inside each outcome group.

    The denominator is every row of the group, including rows whose value is
    NULL. One scan: ROLLUP(label, value) yields both the cells and the group totals.
    """
    v, y = qcol(variable), qcol(spec.label)
    r = (df.filter(y.isin(spec.positive, spec.negative))
         .rollup(y.alias("label"), v.alias("value"))
         .agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.grouping_id().alias("gid")))
    cells = r.filter((F.col("gid") == 0) & F.col("value").isNotNull()).select("label", "value", "n")
    totals = r.filter(F.col("gid") == 1).select("label", F.col("n").alias("group_n"))
    # totals has at most two rows: a bounded broadcast
    return (cells.join(F.broadcast(totals), "label")
            .withColumn("pct", F.col("n") * 100.0 / F.col("group_n"))
            .orderBy("label", F.desc("n"), "value"))


def distinct_count(df: DataFrame, variables, limit: int = 2 * CATEGORICAL_MAX_DISTINCT) -> DataFrame:
    """Distinct non-null values per variable, exact at any number.

    One scan groups (variable, value), combined before the shuffle, and counts
    the groups; no task holds all values of a variable. ``above_limit`` flags
    variables with more than ``limit`` values.
    Schema: variable string, n_distinct bigint, above_limit boolean.
    """
    variables = list(variables)
    spark = df.sparkSession
    if not variables:
        return spark.createDataFrame([], "variable string, n_distinct bigint, above_limit boolean")
    values = long_values(df, variables).groupBy("variable", "value").agg(F.lit(1).alias("one"))
    exact = values.groupBy("variable").agg(F.count(F.lit(1)).cast("bigint").alias("k"))
    names = spark.createDataFrame([(c,) for c in variables], "variable string")
    n = F.coalesce("k", F.lit(0)).cast("bigint")
    return names.join(exact, "variable", "left").select(
        "variable", n.alias("n_distinct"), (n > limit).alias("above_limit"))


def long_values(df: DataFrame, variables, extra=()) -> DataFrame:
    """(variable, value as string, *extra) for non-null values of the listed columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), qcol(c).cast("string").alias("value"))
                      for c in variables])
    return (df.select(*[qcol(e).alias(e) for e in extra], F.inline(pairs))
            .filter(F.col("value").isNotNull()))


def variable_kind(df: DataFrame, spec: CohortSpec, variables=None) -> DataFrame:
    """categorical if forced or 2 <= distinct <= 10; else numeric for numeric
    columns; else 'other' (tested as categorical by the dispatcher)."""
    variables = list(variables or spec.variables)
    dc = distinct_count(df, variables)
    num = [c for c in variables if _is_numeric(df, c)]
    forced = list(spec.categorical)
    kmax = CATEGORICAL_MAX_DISTINCT
    return dc.select(
        "variable", "n_distinct",
        F.when(F.col("variable").isin(forced) if forced else F.lit(False), "categorical")
         .when(~F.col("above_limit") & (F.col("n_distinct") >= 2) & (F.col("n_distinct") <= kmax), "categorical")
         .when(F.col("variable").isin(num) if num else F.lit(False), "numeric")
         .otherwise("other").alias("kind"))


def median_iqr(df: DataFrame, variables, wide=None) -> DataFrame:
    """First quartile, median and third quartile per variable, exact at any
    number of values; ``wide``: see ``features.exact_quantiles``."""
    variables = list(variables)
    found = exact_quantiles(df, variables, [0.25, 0.5, 0.75], wide)
    rows = [(i, c, *(found[c] or [None] * 3)) for i, c in enumerate(variables)]
    out = df.sparkSession.createDataFrame(rows, "ord int, variable string, q1 double, median double, q3 double")
    return out.withColumn("iqr", F.col("q3") - F.col("q1")).orderBy("ord").drop("ord")
