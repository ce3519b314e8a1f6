import math
import random

import pytest

from cohortkit.operators import split as S


def _expected(values, k):
    return sorted(values, key=lambda v: (math.isnan(v), v))[k - 1]


@pytest.mark.parametrize("accuracy", [4, 100_000])
def test_equals_sorting(spark, accuracy):
    rng = random.Random(1)
    cases = {
        "long": [rng.choice([2 ** 60 + i for i in range(40)] + [-2 ** 63, 2 ** 63 - 1, 0]) for _ in range(300)],
        "double": [rng.choice([1e-300, 1.0, 1e300, -1e308, 1.7e308, 0.5, 0.25]) * rng.random() for _ in range(300)]
        + [float("inf")] * 20 + [float("-inf")] * 20 + [float("nan")] * 20,
    }
    for kind, values in cases.items():
        df = spark.createDataFrame([(v,) for v in values + [None]], f"x {kind}").repartition(3)
        for k in (1, 30, 150, len(values) - 10):
            got = S.order_statistic(df, "x", k / len(values), lambda n, k=k: k, accuracy)
            want = _expected(values, k)
            assert got == want or (math.isnan(got) and math.isnan(want)), (kind, k, got, want)


def test_neighbouring_doubles(spark):
    values = [1e16, 1e16 + 2, 1e16 + 2, 1e16 + 4, 5e-324, 1e-323, 0.0, -5e-324]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, 9):
        assert S.kth_smallest(df, "x", k, bins=4096, small=1) == sorted(values)[k - 1]
        assert S.order_statistic(df, "x", k / 8, lambda n: k) == sorted(values)[k - 1]


def test_a_wrong_bracket_is_opened(spark):
    df = spark.range(1000).selectExpr("id * id as x")
    for share in (0.0, 0.3, 1.0):  # far from the position asked for
        assert S.order_statistic(df, "x", share, lambda n: 700, 1000) == 699 * 699


def test_two_scans_of_the_table(spark, monkeypatch):
    """The table is read by the sketch and by the counting; all else reads the small table."""
    reads = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(2.0 ** (i % 1000),) for i in range(3000)], "x double").mapInPandas(through, "x double")
    assert S.order_statistic(rows, "x", 2 / 3, lambda n: 2001) == 2.0 ** 666
    assert reads.value == 2 * 3000


def test_no_position(spark):
    none = spark.createDataFrame([(None,)], "x long")
    assert S.order_statistic(none, "x", 0.5, lambda n: n) is None
    assert S.order_statistic(none.limit(0), "x", 0.5, lambda n: 1) is None
    assert {r.split for r in S.temporal_split(none, "x").collect()} == {"train"}
    some = spark.range(5).selectExpr("id as x")
    assert {r.split for r in S.temporal_split(some, "x", 0.0).collect()} == {"train"}
    assert {r.split for r in S.temporal_split(some, "x", 1.0).collect()} == {"test"}
