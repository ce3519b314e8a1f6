"""Results do not depend on the session's ANSI setting."""

import __spark_entry__ as E
from conftest import SF001

NAMES = ["cohort_summary", "cleaning_audit", "coerce_numeric", "zscore_fit_transform", "metric_auc",
         "importance_comparison", "pct_ratio"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_results_with_ansi_off(spark):
    qs = E.queries()
    on = {n: _rows(qs[n](spark, SF001)) for n in NAMES}
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        off = {n: _rows(qs[n](spark, SF001)) for n in NAMES}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)
    assert on == off
