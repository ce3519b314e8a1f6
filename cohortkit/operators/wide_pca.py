"""Principal axes of wide vectors without the d x d covariance matrix.

A random block of k + extra directions is turned into the leading axes by
repeated passes over the rows. Each pass multiplies the centred rows with a
basis Q of at most 3 (k + extra) columns (the present axes, their residuals and
the last steps) and adds up C Q, where C is the covariance matrix, which is
never formed. A Rayleigh-Ritz step on Q' C Q gives the next axes; C Q gives
their residuals too, so that the test for an end costs no pass of its own.

The partial sums of a task are d x 3 (k + extra) numbers; they are added per
column in a shuffle, and only the sums reach the driver. Rows are staged once as
their non-zero entries and are spread out in blocks of bounded bytes.

Null vectors take no part in the fit. A table without rows, or with one, has no
variance: an error, as there are no axes. Vectors of different widths are an
error. Repeated rows count as often as they stand there; of equal variances any
basis of their space may come back.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.session import stage_path

BLOCK_BYTES = 32 << 20  # bytes of one dense block of rows
EXTRA = 10
TOLERANCE = 1e-8  # largest residual |C v - variance v| against the largest variance
PASSES = 60


def _entries(rows: DataFrame, input_col: str, width: int) -> DataFrame:
    """(at, x): positions and values of the non-zero entries, written once for all passes."""
    spark = rows.sparkSession
    dense = rows.select(vector_to_array(input_col).alias("v"))
    pairs = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda p: p["x"] != 0)
    held = F.when(F.size("v") == width, pairs).otherwise(F.raise_error(F.lit("vectors differ in width")))
    path = stage_path(spark, "wide-pca", uuid.uuid4().hex)
    dense.select(held.alias("p")).select(F.col("p.at").alias("at"), F.col("p.x").alias("x")).write.parquet(path)
    return spark.read.parquet(path)


def _covariance_times(entries: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """C q: one pass over the rows; the sums of each column of q meet in a shuffle."""
    step = max(1, BLOCK_BYTES // (8 * len(mean)))

    def partial(batches):
        total = np.zeros_like(q)
        for batch in batches:
            for first in range(0, len(batch), step):
                part = batch.iloc[first:first + step]
                lengths = part["at"].map(len).to_numpy()
                dense = np.zeros((len(part), len(mean)))
                if lengths.sum():
                    dense[np.repeat(np.arange(len(part)), lengths), np.concatenate(part["at"].to_list())] = \
                        np.concatenate(part["x"].to_list())
                dense -= mean
                total += dense.T @ (dense @ q)
        yield pd.DataFrame({"column": np.arange(q.shape[1]), "part": list(total.T)})

    sums = (entries.mapInPandas(partial, "column int, part array<double>")
            .groupBy("column").agg(Summarizer.sum(array_to_vector("part")).alias("total")))
    out = np.empty_like(q)
    for row in sums.collect():  # q's columns
        out[:, row["column"]] = row["total"].toArray()
    return out / (n - 1)


def _orthonormal(blocks: list) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, the first block kept; what depends on earlier columns goes."""
    basis = np.empty((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            basis = np.hstack([basis, u[:, s > 1e-10]])
    return basis


def principal_axes(rows: DataFrame, input_col: str, k: int, extra: int = EXTRA, tolerance: float = TOLERANCE,
                   passes: int = PASSES, seed: int = 42) -> dict:
    """Leading axes of `input_col`: axes (d x k), variance (k), total, mean, rows, residual, passes.

    Columns follow falling variance, the largest loading of each is positive.
    `residual` is the largest |C v - variance v| of the kept axes against the
    largest variance; where `passes` end first, it is what was reached.
    """
    rows = rows.filter(F.col(input_col).isNotNull())
    if rows.isEmpty():
        raise ValueError("principal axes need two rows or more")
    stats = rows.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(input_col)).alias("s")) \
        .select("s.mean", "s.variance", "s.count").first()
    if stats["count"] < 2:
        raise ValueError("principal axes need two rows or more")
    mean, total, n = stats["mean"].toArray(), float(stats["variance"].toArray().sum()), stats["count"]
    d = len(mean)
    if not 1 <= k <= d:
        raise ValueError(f"k = {k} of {d} columns")
    entries = _entries(rows, input_col, d)

    block = min(d, k + extra)
    last, lead = None, None
    q = _orthonormal([np.random.default_rng(seed).normal(size=(d, block))])
    for done in range(1, passes + 1):
        cq = _covariance_times(entries, mean, q, n)
        small = q.T @ cq
        value, turn = np.linalg.eigh((small + small.T) / 2)
        turn, value = turn[:, ::-1][:, :block], value[::-1][:block]
        axes, image = q @ turn, cq @ turn
        rest = image - axes * value
        scale = max(value[0], np.finfo(float).tiny)
        residual = float(np.linalg.norm(rest[:, :k], axis=0).max() / scale)
        if residual <= tolerance or q.shape[1] == d:
            break
        # the last step: what the new axes hold beyond the axes before
        last = None if lead is None else axes - lead @ (lead.T @ axes)
        lead = axes
        q = _orthonormal([axes, rest] + ([last] if last is not None else []))
    axes, value = axes[:, :k], np.maximum(value[:k], 0.0)
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return {"axes": axes * np.where(signs == 0, 1.0, signs), "variance": value, "total": total, "mean": mean,
            "rows": n, "residual": residual, "passes": done}


def pca_model(spark, found: dict, input_col: str, output_col: str) -> PCAModel:
    """The axes as Spark ML's own model, so that scoring, saving and loading are those of any other PCA."""
    sc = spark.sparkContext
    d, k = found["axes"].shape
    share = found["variance"] / found["total"] if found["total"] > 0 else np.zeros(k)
    java = sc._jvm.org.apache.spark.ml.feature.PCAModel(
        f"PCA_{uuid.uuid4().hex[:12]}", _py2java(sc, DenseMatrix(d, k, found["axes"].ravel(order="F").tolist())),
        _py2java(sc, Vectors.dense(share.tolist())))
    model = PCAModel(java)
    model._resetUid(java.uid())
    return model._set(k=k, inputCol=input_col, outputCol=output_col)
