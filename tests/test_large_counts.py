"""Counts, labels and order statistics where small fixtures show nothing."""

import math

from pyspark.sql import functions as F

from cohortkit.functions.special import betainc
from cohortkit.operators import association as A
from cohortkit.operators import split as S
from cohortkit.operators.balance import class_weight_balanced
from cohortkit.sources.tables import read_sheet


def test_chi_square_of_ten_billion(spark):
    rows = [("v", "a", "x", 10**10), ("v", "a", "y", 10**10 + 10**6), ("v", "b", "x", 10**10), ("v", "b", "y", 10**10)]
    cont = spark.createDataFrame(rows, "variable string, value string, label string, n long")
    a, b, c, d = (float(r[3]) for r in rows)
    n = a + b + c + d
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = A.chi_square_test(cont).first()
        assert math.isclose(got["statistic"], want, rel_tol=1e-6)
    spark.conf.set("spark.sql.ansi.enabled", "true")


def test_null_labels_stay(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else "ab"[i % 2]) for i in range(300)], "k long, y string")
    for out in (S.stratified_split(df, "y", "k"), S.stratified_kfold(df, "y", "k"), S.split_and_folds(df, "y", "k"),
                class_weight_balanced(df, "y")):
        assert out.count() == 300 and out.filter("y is null").count() == 30
    assert S.stratified_split(df, "y", "k").filter("split = 'test'").count() == 100
    folds = S.stratified_kfold(df, "y", "k").groupBy("fold").count().collect()
    assert {r["count"] for r in folds} == {30}


def test_kth_smallest_at_bin_edges(spark):
    df = spark.range(4097 * 5).select((F.floor(F.col("id") / 5) / 10).alias("x"))
    assert S.kth_smallest(df, "x", 456) == 9.1 and S.kth_smallest(df, "x", 911) == 18.2


def test_null_times_are_train(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("t"))
    got = S.temporal_split(df, "t", 0.2)
    assert got.filter("split = 'test'").count() == 10
    assert got.filter("t is null and split = 'test'").count() == 0


def test_line_break_in_a_quoted_cell(spark, tmp_path):
    (tmp_path / "s.csv").write_text('label,chief\nY,"first line\nsecond ""line"""\nN,plain\n')
    rows = read_sheet(spark, str(tmp_path / "s.csv")).orderBy("label").collect()
    assert [tuple(r) for r in rows] == [("N", "plain"), ("Y", 'first line\nsecond "line"')]


def test_student_tail_keeps_digits():
    # I_x(a, 1/2) with many degrees of freedom nears the normal tail
    for dof in (1e7, 1e9, 1e11):
        t = 2.5
        assert math.isclose(betainc(dof / 2, 0.5, dof / (dof + t * t)), math.erfc(t / math.sqrt(2)), rel_tol=1e-5)
