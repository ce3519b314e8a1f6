import pytest
from pyspark.sql import functions as F

from cohortkit.functions.formatting import format_p_value, significance_stars
from cohortkit.operators import association as A
from cohortkit.operators import profile as P
from cohortkit.spec import CohortSpec

SPEC = CohortSpec(label="y", numeric=("x", "c", "z"), categorical=("s",), id_col=None)


def _df(spark):
    rows = [("Y", 1.0, 5.0, None, "m"), ("Y", 2.0, 5.0, None, "f"), ("N", 4.0, 5.0, None, "m"),
            ("N", 10.0, 5.0, None, "m"), ("N", None, 5.0, None, "f")]
    return spark.createDataFrame(rows, "y string, x double, c double, z double, s string")


def test_describe_by_group_single_scan(spark):
    prof = {(r.grp, r.variable): r for r in P.describe_by_group(_df(spark), SPEC).collect()}
    assert prof[("all", "x")]["count"] == 4 and prof[("all", "x")].missing == 1
    assert prof[("all", "x")].missing_ratio == pytest.approx(20.0)
    assert prof[("Y", "x")].mean == 1.5 and prof[("Y", "x")].std == pytest.approx(0.7071067811865476)
    assert prof[("all", "c")].std == 0.0  # constant column
    assert prof[("all", "z")]["count"] == 0 and prof[("all", "z")].mean is None  # all-null column


def test_absent_group_and_one_row_group(spark):
    df = spark.createDataFrame([("Y", 1.0), ("N", 2.0), ("N", 3.0)], "y string, x double")
    spec = CohortSpec(label="y", numeric=("x",), id_col=None)
    prof = {(r.grp, r.variable): r for r in P.describe_by_group(df, spec).collect()}
    assert prof[("Y", "x")].std is None  # one row: sample std undefined
    only_n = P.describe_by_group(df.filter("y = 'N'"), spec).collect()
    assert {r.grp for r in only_n} == {"all", "N"}


def test_median_interpolated(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "x double")
    assert P.median_iqr(df, ["x"]).first().median == 3.0


def test_distinct_and_kind(spark):
    rows = [(i % 2, i % 10, i % 11, i) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").withColumn("y", F.lit("Y"))
    spec = CohortSpec(label="y", numeric=("a", "b", "c", "d"), id_col=None)
    kinds = {r.variable: (r.n_distinct, r.kind) for r in P.variable_kind(df, spec).collect()}
    assert kinds["a"] == (2, "categorical") and kinds["b"] == (10, "categorical")
    assert kinds["c"] == (11, "numeric") and kinds["d"] == (200, "numeric")


def test_chi_square_yates_and_uncorrected(spark):
    # [[10, 5], [3, 9]] with Yates: 3.1172 (SciPy-style correction)
    rows = [("a", "Y")] * 10 + [("a", "N")] * 5 + [("b", "Y")] * 3 + [("b", "N")] * 9
    df = spark.createDataFrame(rows, "s string, y string")
    spec = CohortSpec(label="y", categorical=("s",), id_col=None)
    res = A.chi_square_test(A.contingency(df, spec, ["s"])).first()
    assert res.statistic == pytest.approx(3.1172, abs=1e-4) and res.dof == 1


def test_fisher_switch_on_small_cells(spark):
    rows = [("a", "Y")] * 3 + [("a", "N")] * 1 + [("b", "Y")] * 1 + [("b", "N")] * 3
    df = spark.createDataFrame(rows, "s string, y string")
    spec = CohortSpec(label="y", categorical=("s",), id_col=None)
    r = A.association_screen(df, spec).first()
    assert r.test_type == "fisher-exact" and r.p_value == pytest.approx(34 / 70)


def test_screen_sorted_nulls_last(spark):
    df = _df(spark)
    out = A.association_screen(df, SPEC).collect()
    ps = [r.p_value for r in out]
    assert ps[-1] is None or all(p is not None for p in ps)
    assert "z" not in {r.variable for r in out}  # no values -> skipped


def test_stars_and_p_text(spark):
    df = spark.createDataFrame([(0.0009,), (0.001,), (0.01,), (0.05,), (None,)], "p double")
    out = df.select(significance_stars(F.col("p")).alias("s"), format_p_value(F.col("p")).alias("t")).collect()
    assert [r.s for r in out] == ["***", "**", "*", "ns", "ns"]
    assert [r.t for r in out] == ["<0.001", "0.001", "0.010", "0.050", "N/A"]


def test_ansi_safe_edge_groups(spark):
    from cohortkit.operators import importance as IM
    # all-null variable, one row per group, empty input: no division-by-zero errors under ANSI
    df = spark.createDataFrame([("Y", None, 1.0), ("N", None, 2.0)], "y string, z double, x double")
    spec = CohortSpec(label="y", numeric=("z", "x"), id_col=None)
    prof = P.describe_by_group(df, spec)
    assert prof.filter("grp = 'all' AND variable = 'z'").first().mean is None
    f = IM.f_statistic(prof, spec).filter("variable = 'x'").first()
    assert f.f_statistic is None
    empty = df.limit(0)
    assert IM.dataset_info(empty, spec, 2).first().positive_pct is None


def test_median_iqr_auto_mode_matches_exact_on_small_cardinality(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 10)], "x double")
    assert P.median_iqr(df, ["x"], wide=None).first().median == 3.0
    assert P.median_iqr(df, ["x"], wide={"x"}).collect() == P.median_iqr(df, ["x"], wide=()).collect()
