"""Column expressions for ingest: NA tokens and numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number with optional exponent, after trimming blanks. Spark's
# cast also accepts '1.0d', '2f', 'Infinity'; the reader this mirrors does not.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def qcol(name: str) -> Column:
    """Column reference that tolerates '-', '.', spaces in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def na_token_expr(c: Column, tokens) -> Column:
    """NULL when the raw cell is exactly one of ``tokens`` (no trimming)."""
    return F.when(~c.isin(list(tokens)), c)


def coerce_numeric_expr(c: Column) -> Column:
    """String (or number) -> double; anything that is not a plain number -> NULL.

    NaN never survives: it becomes NULL so that comparisons and aggregates skip it
    the way the reference's missing values are skipped.
    """
    s = F.trim(c.cast("string"))
    num = F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    return F.when(~F.isnan(num), num)
