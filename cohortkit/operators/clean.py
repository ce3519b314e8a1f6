"""Ingest cleaning: NA tokens, column drops, numeric coercion, plausible-range
rules and the audit of every removed cell.

Everything is a projection, so the whole cleaning step is one narrow stage
fused into the scan by whole-stage codegen; the audit is one aggregate whose
single result row is unpivoted afterwards (no per-variable rescans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cohortkit.functions.columns import coerce_numeric_expr, na_token_expr, qcol
from cohortkit.spec import DEFAULT_NA_TOKENS, SHEET_NA_TOKENS, CohortSpec


def read_na_tokens(df: DataFrame, tokens=None, columns=None) -> DataFrame:
    """Replace exact missing-value tokens by NULL in string columns.

    ``tokens`` defaults to the sheet tokens plus the reader's default NA set.
    """
    tokens = tuple(dict.fromkeys((tokens if tokens is not None else SHEET_NA_TOKENS + DEFAULT_NA_TOKENS)))
    string_cols = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    targets = set(columns) if columns is not None else string_cols
    return df.select(*[na_token_expr(qcol(c), tokens).alias(c) if c in targets and c in string_cols
                       else qcol(c) for c in df.columns])


def drop_columns_if_present(df: DataFrame, columns) -> DataFrame:
    """Drop the listed columns; absent names are ignored."""
    present = [c for c in columns if c in df.columns]
    return df.drop(*present) if present else df


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Listed columns -> double; unparseable values and NaN -> NULL.

    Columns that are already numeric skip the text parse (only NaN -> NULL).
    """
    cols = set(columns)
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if f.name not in cols:
            out.append(c)
        elif isinstance(f.dataType, NumericType):
            x = c.cast("double")
            out.append(F.when(~F.isnan(x), x).alias(f.name))
        else:
            out.append(coerce_numeric_expr(c).alias(f.name))
    return df.select(*out)


def range_rule(c: Column, lo=None, hi=None, zero_invalid: bool = False) -> Column:
    """Value kept only if inside the inclusive range (and non-zero when asked).

    NULL stays NULL and is never counted as an outlier.
    """
    keep = F.lit(True)
    if lo is not None:
        keep = keep & (c >= F.lit(float(lo)))
    if hi is not None:
        keep = keep & (c <= F.lit(float(hi)))
    if zero_invalid:
        keep = keep & (c != F.lit(0.0))
    return F.when(keep, c)


def _rule_columns(spec_ranges: dict, zero_cols) -> list[str]:
    out = list(spec_ranges)
    out += [c for c in zero_cols if c not in out]
    return out


def range_clean(df: DataFrame, ranges: dict, zero_invalid=()) -> DataFrame:
    """Apply every range rule (and zero rule) in a single projection."""
    zero = set(zero_invalid)
    rules = {c: r for c, r in ranges.items() if c in df.columns}
    out = []
    for c in df.columns:
        if c in rules:
            lo, hi = rules[c]
            out.append(range_rule(qcol(c), lo, hi, c in zero).alias(c))
        elif c in zero:
            out.append(range_rule(qcol(c), None, None, True).alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def zero_invalid(df: DataFrame, columns) -> DataFrame:
    """0 -> NULL for the listed columns (``nullif``)."""
    cols = set(columns)
    return df.select(*[F.nullif(qcol(c), F.lit(0.0)).alias(c) if c in cols else qcol(c)
                       for c in df.columns])


def clean_cohort(raw: DataFrame, spec: CohortSpec, tokens=None) -> DataFrame:
    """The full load step: NA tokens -> drop -> coerce -> range/zero rules."""
    df = read_na_tokens(raw, tokens)
    df = drop_columns_if_present(df, spec.drop)
    numeric = [c for c in df.columns if c not in spec.text and c != spec.label
               and c != spec.id_col and c not in spec.passthrough]
    df = coerce_numeric(df, numeric)
    return range_clean(df, spec.ranges, spec.zero_invalid)


def cleaning_audit(coerced: DataFrame, spec: CohortSpec, only_changed: bool = False) -> DataFrame:
    """Per rule column: missing before, cells removed, missing after.

    ``coerced`` is the table after numeric coercion and before range rules.
    One aggregate computes all 3 x p counters; the single row is unpivoted.
    Schema: variable string, n_missing bigint, n_removed bigint, n_missing_after bigint.
    """
    cols = [c for c in _rule_columns(spec.ranges, spec.zero_invalid) if c in coerced.columns]
    zero = set(spec.zero_invalid)
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c)
        lo, hi = spec.ranges.get(c, (None, None))
        cleaned = range_rule(x, lo, hi, c in zero)
        aggs += [F.count_if(x.isNull()).alias(f"m{i}"),
                 F.count_if(x.isNotNull() & cleaned.isNull()).alias(f"r{i}"),
                 F.count_if(cleaned.isNull()).alias(f"a{i}")]
    wide = coerced.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("variable"),
                              F.col(f"m{i}").cast("bigint").alias("n_missing"),
                              F.col(f"r{i}").cast("bigint").alias("n_removed"),
                              F.col(f"a{i}").cast("bigint").alias("n_missing_after"))
                     for i, c in enumerate(cols)])
    out = wide.select(F.inline(rows))
    if only_changed:
        out = out.filter((F.col("n_missing") > 0) | (F.col("n_removed") > 0))
    return out.orderBy("ord").drop("ord")


def audit_totals(audit: DataFrame) -> DataFrame:
    """Totals of the audit and the identity missing + removed = after."""
    return audit.agg(
        F.sum("n_missing").cast("bigint").alias("total_missing"),
        F.sum("n_removed").cast("bigint").alias("total_removed"),
        F.sum("n_missing_after").cast("bigint").alias("total_missing_after"),
    ).withColumn("identity_holds",
                 (F.col("total_missing") + F.col("total_removed")) == F.col("total_missing_after"))
