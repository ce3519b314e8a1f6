"""Cohort description ("Table 1"): profile by group joined to the test screen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.formatting import NO_DATA, NOT_TESTED, format_mean_sd, format_p_value
from cohortkit.operators.association import association_screen, local_profile
from cohortkit.operators.profile import ALL_GROUP, cohort_basic_info, describe_by_group
from cohortkit.spec import CohortSpec


def _variable_order(spec: CohortSpec):
    order = {v: i for i, v in enumerate(spec.variables)}
    return F.create_map(*[x for v, i in order.items() for x in (F.lit(v), F.lit(i))])[F.col("variable")]


def cohort_summary(profile: DataFrame, screen: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row per variable: overall / case / control 'mean (sd)', counts, p, test.

    The profile (<= 3 rows per variable) is pivoted by conditional aggregation
    and left-joined to the screen, so untested variables keep their row.
    """
    def pick(grp, col):
        return F.max(F.when(F.col("grp") == grp, F.col(col)))

    wide = profile.groupBy("variable").agg(
        pick(ALL_GROUP, "mean").alias("m0"), pick(ALL_GROUP, "std").alias("s0"), pick(ALL_GROUP, "count").alias("n0"),
        pick(spec.positive, "mean").alias("m1"), pick(spec.positive, "std").alias("s1"), pick(spec.positive, "count").alias("n1"),
        pick(spec.negative, "mean").alias("m2"), pick(spec.negative, "std").alias("s2"), pick(spec.negative, "count").alias("n2"),
    )
    # the screen holds one row per variable: a bounded broadcast
    joined = wide.join(F.broadcast(screen.select("variable", "p_value", "test_type")), "variable", "left")
    return joined.select(
        "variable",
        format_mean_sd(F.col("m0"), F.col("s0"), NO_DATA).alias("total_mean_sd"),
        format_mean_sd(F.col("m1"), F.col("s1"), NO_DATA).alias("case_mean_sd"),
        format_mean_sd(F.col("m2"), F.col("s2"), NO_DATA).alias("control_mean_sd"),
        F.col("p_value"),
        F.coalesce(F.col("test_type"), F.lit(NOT_TESTED)).alias("test_type"),
        F.coalesce(F.col("n0"), F.lit(0)).cast("int").alias("total_n"),
        F.coalesce(F.col("n1"), F.lit(0)).cast("int").alias("case_n"),
        F.coalesce(F.col("n2"), F.lit(0)).cast("int").alias("control_n"),
    ).orderBy(_variable_order(spec))


def cohort_report(df: DataFrame, spec: CohortSpec, alpha: float = 0.05) -> dict:
    """Everything the cohort description produces.

    The cleaned cohort is not cached (at scale it is the whole table); each
    product is a column-pruned scan, and the profile travels as a small local
    table so the summary and the tests do not rescan for it.

    Keys: basic_info, overall_stats, case_stats, control_stats, screen, summary,
    significant (formatted p for display).
    """
    prof = local_profile(df, spec)  # one scan; 3 x p rows to the driver
    screen = association_screen(df, spec, alpha, profile=prof)
    return {
        "basic_info": cohort_basic_info(df, spec),
        "overall_stats": prof.filter(F.col("grp") == ALL_GROUP),
        "case_stats": prof.filter(F.col("grp") == spec.positive),
        "control_stats": prof.filter(F.col("grp") == spec.negative),
        "screen": screen,
        "summary": cohort_summary(prof, screen, spec),
        "significant": screen.filter("significant").select(
            "variable", format_p_value(F.col("p_value")).alias("p_value"), "significance_level", "test_type"),
    }


def categorical_report(df: DataFrame, spec: CohortSpec, variable: str, alpha: float = 0.05) -> DataFrame:
    """Cross-tab of one categorical variable by outcome with row percentages,
    the association test and its significance marker, as one table."""
    from cohortkit.operators.profile import crosstab_row_pct
    ct = crosstab_row_pct(df, variable, spec.label)
    screen = association_screen(df, spec, alpha, variables=[variable])
    # the screen has exactly one row: a bounded broadcast
    return (ct.withColumn("variable", F.lit(variable))
            .join(F.broadcast(screen.select("variable", "p_value", "test_type", "significance_level")), "variable")
            .drop("variable"))
