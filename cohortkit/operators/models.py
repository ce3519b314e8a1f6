"""The seven classifier families as Spark ML estimators.

Base / optimised hyper-parameters follow the study; where Spark's estimator
differs from the single-machine one the mapping is stated:

DT   DecisionTreeClassifier(maxDepth 10, gini, maxBins 256); binned splits, or with
     exact_trees ExactTreeClassifier: all distinct values, no bins
SVM  RBF kernel approximated by random Fourier features (Rahimi & Recht 2007)
     with gamma = 1 / (d * var X), then LinearSVC(regParam = 1 / (C n)); the
     score is a probability, by a sigmoid on out-of-fold decision values
     (``operators.calibration``), the class that of the decision value
RF   RowForestClassifier (``operators.row_forest``), Spark's forest with small nodes finished
     in one task each (numTrees 50 | 100, maxDepth 10 | 15, sqrt features, maxBins 256)
ANN  NetworkClassifier (``operators.network``) [d, 50, 1] | [d, 100, 50, 1]: ReLU
     units, L2 term, early stopping on a tenth of the rows; full-batch steps
LR   LogisticRegression(regParam = 1 / (C * sum w), no standardisation)
NN   NetworkClassifier [d, 100, 50, 25, 1] | [d, 200, 100, 50, 1]
SGD  LogisticRegression(regParam = alpha): the same objective as log-loss SGD,
     solved by L-BFGS
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LinearSVCModel, LogisticRegression,
                                       LogisticRegressionModel)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cohortkit.operators.calibration import CalibratedClassifier
from cohortkit.operators.evaluate import MODEL_ORDER
from cohortkit.operators.exact_tree import ExactTreeClassifier
from cohortkit.operators.network import NetworkClassifier
from cohortkit.operators.row_forest import RowForestClassifier

# Hyper-parameters of the base and the optimised study.
BASE = {
    "DT": {"max_depth": 10},
    "SVM": {"C": 1.0},
    "RF": {"n_trees": 50, "max_depth": 10},
    "ANN": {"hidden": (50,), "max_iter": 300, "alpha": 0.0001},
    "LR": {"C": 1.0, "max_iter": 1000},
    "NN": {"hidden": (100, 50, 25), "max_iter": 500, "alpha": 0.01},
    "SGD": {"alpha": 0.01, "max_iter": 1000},
}
OPTIMISED = {
    "DT": {"max_depth": 10, "balanced": True},
    "SVM": {"C": 1.0, "balanced": True},
    "RF": {"n_trees": 100, "max_depth": 15, "balanced": True},
    "ANN": {"hidden": (100, 50), "max_iter": 500, "alpha": 0.001},
    "LR": {"C": 1.0, "max_iter": 2000, "balanced": True},
    "NN": {"hidden": (200, 100, 50), "max_iter": 800, "alpha": 0.0001},
    "SGD": {"alpha": 0.001, "max_iter": 2000, "balanced": True},
}
RFF_COMPONENTS = 512
SVM_MAX_ITER = 200
SVM_PARTITION = 64 * 2**20  # bytes of random features a task scans at a step
# Stopping tolerances of the reference's library defaults
# (logistic regression and MLP 1e-4, SGD and SVC 1e-3).
TOL = {"LR": 1e-4, "ANN": 1e-4, "NN": 1e-4, "SGD": 1e-3, "SVM": 1e-3}


class _RFFParams(HasInputCol, HasOutputCol, HasSeed):
    gamma = Param(Params._dummy(), "gamma", "RBF kernel width", typeConverter=TypeConverters.toFloat)
    nComponents = Param(Params._dummy(), "nComponents", "random features", typeConverter=TypeConverters.toInt)
    nInput = Param(Params._dummy(), "nInput", "input width", typeConverter=TypeConverters.toInt)


def _rff_matrix(seed: int, d: int, D: int, gamma: float):
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(d, D))
    b = rng.uniform(0.0, 2.0 * np.pi, size=D)
    return W, b


class RandomFourierFeaturesModel(Model, _RFFParams, DefaultParamsReadable, DefaultParamsWritable):
    """z(x) = sqrt(2/D) cos(x W + b); W, b regenerated from the seed, so only
    four numbers persist. Arrow-batched NumPy matmul per partition."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, seed=42, gamma=1.0, nComponents=RFF_COMPONENTS, nInput=1):
        super().__init__()
        self._setDefault(seed=42, gamma=1.0, nComponents=RFF_COMPONENTS, nInput=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        d, D = self.getOrDefault("nInput"), self.getOrDefault("nComponents")
        seed, gamma = self.getOrDefault("seed"), self.getOrDefault("gamma")

        @F.pandas_udf(ArrayType(DoubleType()))
        def rff(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            W, b = _rff_matrix(seed, d, D, gamma)
            for col in batches:
                X = np.stack(col.to_numpy()) if len(col) else np.zeros((0, d))
                yield pd.Series(list(np.sqrt(2.0 / D) * np.cos(X @ W + b)))

        return df.withColumn(self.getOutputCol(),
                             array_to_vector(rff(vector_to_array(F.col(self.getInputCol())))))


class RandomFourierFeatures(Estimator, _RFFParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits gamma = 1 / (d * Var[X]) (variance over all entries, the library's
    'scale' default) with one Summarizer pass."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, seed=42, nComponents=RFF_COMPONENTS):
        super().__init__()
        self._setDefault(seed=42, nComponents=RFF_COMPONENTS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RandomFourierFeaturesModel:
        col = F.col(self.getInputCol())
        s = df.select(Summarizer.metrics("mean", "variance", "count").summary(col).alias("s")).first()["s"]
        mean, var, n = s["mean"].toArray(), s["variance"].toArray(), float(s["count"])
        d = len(mean)
        # variance of all n*d entries from per-column moments (population form)
        col_sq = var * (n - 1) / max(n, 1.0) + mean ** 2
        total_var = float(col_sq.mean() - mean.mean() ** 2)
        gamma = 1.0 / (d * total_var) if total_var > 0 else 1.0
        return RandomFourierFeaturesModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
                                          seed=self.getOrDefault("seed"), gamma=gamma,
                                          nComponents=self.getOrDefault("nComponents"), nInput=d)


def make_model(name: str, n_features: int, n_rows: float, variant: str = "base", seed: int = 42,
               features: str = "features", label: str = "label", weight: str | None = "weight",
               tol: float | None = None, svm_max_iter: int = SVM_MAX_ITER, rff_components: int = RFF_COMPONENTS,
               exact_trees: bool = False):
    """Estimator for one family; ``weight`` is used only where the optimised
    study asks for balanced class weights (and the estimator supports it).
    ``tol`` replaces the family's stopping tolerance."""
    if name not in MODEL_ORDER:
        raise ValueError(f"unknown model {name!r}")
    hp = (OPTIMISED if variant == "optimised" else BASE)[name]
    wcol = weight if (hp.get("balanced") and weight) else None
    common = {"featuresCol": features, "labelCol": label}
    if name == "DT" and exact_trees:
        return ExactTreeClassifier(maxDepth=hp["max_depth"], weightCol=wcol, **common)
    if name == "DT":
        est = DecisionTreeClassifier(maxDepth=hp["max_depth"], impurity="gini", maxBins=256, seed=seed, **common)
        if wcol:
            est.setWeightCol(wcol)
        return est
    if name == "RF":
        return RowForestClassifier(numTrees=hp["n_trees"], maxDepth=hp["max_depth"], maxBins=256, seed=seed, weightCol=wcol, **common)
    if name in ("ANN", "NN"):
        return NetworkClassifier(layers=[n_features, *hp["hidden"], 1], alpha=hp["alpha"], maxIter=hp["max_iter"],
                                 tol=tol or TOL[name], seed=seed, **common)
    if name == "LR":
        est = LogisticRegression(maxIter=hp["max_iter"], regParam=1.0 / (hp["C"] * max(n_rows, 1.0)),
                                 elasticNetParam=0.0, standardization=False, tol=tol or TOL["LR"], **common)
        if wcol:
            est.setWeightCol(wcol)
        return est
    if name == "SGD":
        est = LogisticRegression(maxIter=hp["max_iter"], regParam=hp["alpha"], elasticNetParam=0.0,
                                 standardization=False, tol=tol or TOL["SGD"], **common)
        if wcol:
            est.setWeightCol(wcol)
        return est
    # SVM: kernel approximation + linear SVM on the random features
    rff = RandomFourierFeatures(inputCol=features, outputCol="__rff", seed=seed, nComponents=rff_components)
    svc = LinearSVC(featuresCol="__rff", labelCol=label, regParam=1.0 / (hp["C"] * max(n_rows, 1.0)),
                    maxIter=svm_max_iter, tol=tol or TOL["SVM"])
    if wcol:
        svc.setWeightCol(wcol)
    return CalibratedClassifier(Pipeline(stages=[rff, svc]), label=label, seed=seed, row_bytes=8 * rff_components)


def partition_rows(name: str, rff_components: int = RFF_COMPONENTS) -> int:
    """Rows a partition for a family's solver: 100,000, or as many as fill ``SVM_PARTITION`` as random features."""
    return max(1, min(100_000, SVM_PARTITION // (8 * rff_components))) if name == "SVM" else 100_000


def unconverged(fitted) -> list[str]:
    """A note for every linear solver that stopped at its iteration limit."""
    out = []
    for m in getattr(fitted, "stages", [fitted]):
        if isinstance(m, (LinearSVCModel, LogisticRegressionModel)) and m.hasSummary:
            summary = m.summary() if callable(m.summary) else m.summary
            if summary.totalIterations >= m.getMaxIter():
                out.append(f"{type(m).__name__} stopped at {m.getMaxIter()} iterations")
    return out


def score_column(predictions: DataFrame) -> DataFrame:
    """P(class 1) when the model gives probabilities, else the decision value."""
    if "probability" in predictions.columns:
        s = vector_to_array(F.col("probability"))[1]
    else:
        s = vector_to_array(F.col("rawPrediction"))[1]
    return predictions.withColumn("score", s).withColumn("pred", F.col("prediction").cast("int"))
