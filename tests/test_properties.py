"""Row-order and partition-count independence (results are functions of the data only)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.operators import association as A
from cohortkit.operators import evaluate as EV
from cohortkit.operators import profile as P
from cohortkit.spec import CohortSpec

SPEC = CohortSpec(label="y", numeric=("x", "k"), categorical=("s",), id_col=None)


def _data(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    rows = [("Y" if rng.random() < 0.3 else "N", float(rng.normal()) if rng.random() > 0.1 else None,
             float(rng.integers(0, 4)), "abc"[int(rng.integers(0, 3))]) for _ in range(n)]
    return spark.createDataFrame(rows, "y string, x double, k double, s string")


def _round(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_profile_and_screen_partition_independent(spark, seed):
    df = _data(spark, seed)
    a, b = df.repartition(1), df.orderBy(F.rand(seed)).repartition(13)
    assert _round(P.describe_by_group(a, SPEC).collect()) == _round(P.describe_by_group(b, SPEC).collect())
    assert _round(A.association_screen(a, SPEC).collect()) == _round(A.association_screen(b, SPEC).collect())


def test_auc_partition_independent(spark):
    rng = np.random.default_rng(3)
    rows = [("s", "m", "train", int(i % 3), i, int(rng.random() < 0.4), float(np.round(rng.random(), 2)), 0)
            for i in range(600)]
    df = spark.createDataFrame(rows, "feature_set string, model string, split string, fold int, row_id long, "
                                     "label int, score double, pred int")
    a = EV.roc_auc(df.repartition(1)).collect()
    b = EV.roc_auc(df.repartition(11), bucket_rows=20).collect()
    assert _round(a) == _round(b)
