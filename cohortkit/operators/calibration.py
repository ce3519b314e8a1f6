"""Probabilities for decision values: a sigmoid fitted on out-of-fold margins.

P(1 | f) = 1 / (1 + exp(a f + b)) with the two parameters that minimise the log loss
against smoothed targets, (n1 + 1) / (n1 + 2) for class 1 and 1 / (n0 + 2) for class
0 (Platt 1999). The margins come from models that did not see the row; they are
written once, and every Newton step is one aggregate over them.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.hashing import uniform
from cohortkit.session import checkpoint_dir

# Fixed value: folds whose margins the sigmoid is fitted on.
CALIBRATION_FOLDS = 5
# Fixed value: bytes that the solvers of fold models may hold at a time. Rows beyond it are fitted fold by fold, as
# solvers whose rows do not fit in memory read them from disk at every step.
FITS_BYTES = 4_000_000_000


def fit_sigmoid(margins: DataFrame, margin: str = "margin", label: str = "label", max_steps: int = 100,
                tol: float = 1e-10) -> tuple[float, float]:
    """(a, b) by Newton steps, halved while the loss rises; one aggregate a step.

    Without rows the plain logistic curve (-1, 0) is returned. Null margins are left out.
    """
    rows = margins.select(F.col(margin).cast("double").alias("f"), F.col(label).cast("double").alias("y")).dropna()
    n1, n0 = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)).first()
    if n1 + n0 == 0:
        return -1.0, 0.0
    target = F.when(F.col("y") == 1, (n1 + 1.0) / (n1 + 2.0)).otherwise(1.0 / (n0 + 2.0))
    n = float(n1 + n0)

    def sums(a: float, b: float):
        z = F.col("f") * a + F.lit(b)  # log odds of class 0
        # log(1 + exp(z)) without overflow
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(z))
        t = rows.select("f", (soft - (F.lit(1.0) - target) * z).alias("loss"), (target - p).alias("g"), (p * (1 - p)).alias("h"))
        return t.agg(F.avg("loss"), F.avg(F.col("f") * F.col("g")), F.avg("g"), F.avg(F.col("f") ** 2 * F.col("h")),
                     F.avg(F.col("f") * F.col("h")), F.avg("h")).first()

    a, b = 0.0, math.log((n0 + 1.0) / (n1 + 1.0))
    value, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(max_steps):
        haa, hbb = haa + 1e-12 / n, hbb + 1e-12 / n
        det = haa * hbb - hab * hab
        if not det > 0:  # all margins equal: only b can move
            da, db = 0.0, -gb / hbb
        else:
            da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step = 1.0
        while True:
            now = sums(a + step * da, b + step * db)
            if now[0] <= value + 1e-4 * step * (ga * da + gb * db) + 1e-15 or step < 1e-10:
                break
            step /= 2
        a, b = a + step * da, b + step * db
        value, ga, gb, haa, hab, hbb = now
        if max(abs(step * da), abs(step * db)) < tol:
            break
    return a, b


class SigmoidModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the probability of a decision value; the class stays that of the margin."""

    a = Param(Params._dummy(), "a", "slope", typeConverter=TypeConverters.toFloat)
    b = Param(Params._dummy(), "b", "offset", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, a=-1.0, b=0.0):
        super().__init__()
        self._setDefault(a=-1.0, b=0.0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        f = vector_to_array("rawPrediction")[1]
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(f * self.getOrDefault("a") + F.lit(self.getOrDefault("b"))))
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))


def fits_at_once(fits: int, n_rows: int, row_bytes: int) -> int:
    """How many of the fits run at a time, so that their rows stay in memory; the results do not depend on it."""
    return max(1, min(fits, FITS_BYTES // max(1, n_rows * row_bytes)))


def out_of_fold_margins(estimator: Estimator, rows: DataFrame, label: str, id_col: str, seed: int,
                        folds: int = CALIBRATION_FOLDS, row_bytes: int = 0) -> DataFrame:
    """(margin, label) of every row by a model fitted without its fold; folds are drawn by a hash of the id.

    A fold whose other rows lack a class is left out. ``row_bytes``: what a solver holds a row; it says how many
    folds are fitted at a time.
    """
    checkpoint_dir(rows.sparkSession)
    dealt = rows.withColumn("__fold", F.floor(uniform(seed, F.lit("cal"), F.col(id_col)) * folds).cast("int")).checkpoint()
    held: dict = {}
    for r in dealt.groupBy("__fold", label).count().collect():
        held.setdefault(r["__fold"], {})[r[label]] = r["count"]
    total = {c: sum(h.get(c, 0) for h in held.values()) for c in {c for h in held.values() for c in h}}
    usable = [f for f, h in sorted(held.items()) if len(total) > 1 and all(total[c] > h.get(c, 0) for c in total)]

    def one(f: int) -> DataFrame:
        model = estimator.copy().fit(dealt.filter(F.col("__fold") != f))
        part = model.transform(dealt.filter(F.col("__fold") == f))
        return part.select(vector_to_array("rawPrediction")[1].alias("margin"), F.col(label).alias("label"))

    if not usable:
        return rows.sparkSession.createDataFrame([], "margin double, label double")
    with ThreadPoolExecutor(max_workers=fits_at_once(len(usable), sum(total.values()), row_bytes)) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(one), usable))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.checkpoint()


class CalibratedClassifier(Estimator):
    """An estimator with decision values, plus the sigmoid that turns them into probabilities."""

    def __init__(self, estimator: Estimator, label: str = "label", id_col: str = "row_id", seed: int = 42,
                 folds: int = CALIBRATION_FOLDS, row_bytes: int = 0):
        super().__init__()
        self.estimator, self.label, self.id_col, self.seed, self.folds = estimator, label, id_col, seed, folds
        self.row_bytes = row_bytes

    def _fit(self, df: DataFrame) -> PipelineModel:
        model = self.estimator.fit(df)
        a, b = fit_sigmoid(out_of_fold_margins(self.estimator, df, self.label, self.id_col, self.seed, self.folds,
                                               self.row_bytes))
        return PipelineModel(stages=[*getattr(model, "stages", [model]), SigmoidModel(a=a, b=b)])
