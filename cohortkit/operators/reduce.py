"""PCA reduction of text vectors.

Centre (Spark's PCA does not), project on the top-k principal axes, then fix
the sign of each axis so its largest-magnitude loading is positive, which
makes the projection deterministic. Up to ``WIDE`` columns Spark ML forms the d x d
covariance on the driver; wider vectors take ``wide_pca``, whose driver holds a
few d x k blocks. Rows stay distributed in both.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, SQLTransformer, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from cohortkit.operators.wide_pca import pca_model, principal_axes

# Components kept per text column in the optimised study.
PCA_COMPONENTS = 30

WIDE = 4096  # columns up to which the covariance matrix (128 MB) is formed


def fit_pca(train: DataFrame, input_col: str, output_col: str, k: int = PCA_COMPONENTS, wide: int = WIDE):
    """Return (PipelineModel, explained variance ratio of the kept components)."""
    tmp_c, tmp_p = f"__{output_col}_c", f"__{output_col}_p"
    centre = StandardScaler(inputCol=input_col, outputCol=tmp_c, withMean=True, withStd=False).fit(train)
    if centre.mean.size > wide:
        pca = pca_model(train.sparkSession, principal_axes(train, input_col, k), tmp_c, tmp_p)
    else:
        pca = PCA(k=k, inputCol=tmp_c, outputCol=tmp_p).fit(centre.transform(train))
    pc = pca.pc.toArray()  # d x k on the driver
    idx = np.argmax(np.abs(pc), axis=0)
    signs = np.sign(pc[idx, np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    flip = ElementwiseProduct(scalingVec=Vectors.dense(signs.tolist()), inputCol=tmp_p, outputCol=output_col)
    drop = SQLTransformer(statement=f"SELECT * EXCEPT (`{tmp_c}`, `{tmp_p}`) FROM __THIS__")
    model = PipelineModel(stages=[centre, pca, flip, drop])
    return model, float(np.sum(pca.explainedVariance.toArray()))


def pca_batch(configs: list) -> list:
    """Fit and apply PCA for several inputs.

    ``configs``: dicts with name, train, test, input_col, k. Returns dicts with
    name, model, variance, train (projected), test (projected).
    """
    out = []
    for cfg in configs:
        model, var = fit_pca(cfg["train"], cfg["input_col"], cfg.get("output_col", f"{cfg['name']}_pca"),
                             cfg.get("k", PCA_COMPONENTS))
        out.append({"name": cfg["name"], "model": model, "variance": var,
                    "train": model.transform(cfg["train"]), "test": model.transform(cfg["test"])})
    return out


def pca_report(results: list) -> DataFrame:
    """feature, n_components, variance_ratio, n_train, n_test."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(r["name"], int(len(r["model"].stages[1].explainedVariance)), r["variance"],
             r["train"].count(), r["test"].count()) for r in results]
    return spark.createDataFrame(rows, "feature string, n_components int, variance_ratio double, n_train bigint, n_test bigint")

