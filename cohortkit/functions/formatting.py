"""Report formatting as built-in column expressions (no row-wise Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display strings of the reports.
NO_DATA = "no data"
NOT_TESTED = "untested"
P_NULL_TEXT = "N/A"
P_SMALL_TEXT = "<0.001"


def format_p_value(p: Column) -> Column:
    """NULL/NaN -> 'N/A'; p < 0.001 -> '<0.001'; else three decimals."""
    return (F.when(p.isNull() | F.isnan(p), F.lit(P_NULL_TEXT))
            .when(p < 0.001, F.lit(P_SMALL_TEXT))
            .otherwise(F.format_string("%.3f", p)))


def format_mean_sd(mean: Column, sd: Column, empty: str = NO_DATA) -> Column:
    """'mean (sd)' to two decimals, or ``empty`` when the mean is missing."""
    return F.when(mean.isNull(), F.lit(empty)).otherwise(
        F.format_string("%.2f (%.2f)", mean, sd))


def format_metric_pm(mean: Column, sd: Column) -> Column:
    """'mean ± sd' to three decimals."""
    return F.format_string("%.3f ± %.3f", mean, sd)


def significance_stars(p: Column) -> Column:
    """'***' < .001, '**' < .01, '*' < .05, else (and for NULL) 'ns'."""
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("ns"))


def round_metrics(df, cols, digits: int = 4):
    """Round the named double columns."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole * 100, rounded; NULL when whole is 0."""
    return F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)
