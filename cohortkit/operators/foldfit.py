"""Logistic regressions of all folds fitted together, one data pass a Newton step.

k-fold cross-validation plus the refit are k + 1 fits over almost the same rows: a
row feeds every fit but that of its own fold. One pass over the rows computes
loss, gradient and Hessian of every fit at its current weights; tasks add them up
over their rows, Spark adds the tasks up, and only the sums, (width + 2)^2 numbers
a fit, reach the driver, which solves for the next weights. Newton steps are few
(5 to 8) whatever the number of rows, so k + 1 fits cost as many passes as one.
A step that raises a fit's objective is halved.

The objective is that of a ridge logistic regression: weighted mean of the log
loss plus reg / 2 times the squared weights; the intercept has no penalty.

Rows come in one of two forms, told apart by the column `fit`:
* null: the row is shared; each fit maps the raw numbers to its own features
  (fill for missing values, centre and scale from its own training rows);
* a number: the row's features were made for that fit alone (encoders and
  projections fitted without a fold), and no other fit sees it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the sums that one pass holds in a task; more fits than fit in take turns.
PASS_BYTES = 128_000_000
MAX_PASSES = 100


@dataclass
class FoldMap:
    """A fit's features: (x or fill) - centre, over scale; for the first columns of x, the rest stays."""

    fill: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = len(self.fill)
        head = x[:, :n]
        head = (np.where(np.isnan(head), self.fill, head) - self.centre) / self.scale
        return head if n == x.shape[1] else np.hstack([head, x[:, n:]])


def fold_maps(train: DataFrame, columns, fits, scaled: bool, medians) -> dict[int, FoldMap]:
    """Maps of every fit from one aggregate: moments of each fold, merged without the held-out one.

    ``scaled``: the columns are scaled already, only fill. ``medians(f, columns)``
    gives the training medians of fit f and is asked only for columns with nulls.
    A column without any training value becomes 0.
    """
    columns = list(columns)
    if not columns:
        none = np.empty(0)
        return {f: FoldMap(none, none, none) for f in fits}
    per = [(F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"))
           for i, c in enumerate(F.col(f"`{c}`").cast("double") for c in columns)]
    stats = train.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *[a for three in per for a in three]).collect()
    maps = {}
    for f in fits:
        used = [r for r in stats if r["fold"] != f]
        fill, centre, scale = np.zeros(len(columns)), np.zeros(len(columns)), np.ones(len(columns))
        holes = []
        for i, c in enumerate(columns):
            n = sum(r[f"n{i}"] for r in used)
            if n == 0:
                continue
            mean = sum(r[f"n{i}"] * r[f"m{i}"] for r in used if r[f"n{i}"]) / n
            square = sum(r[f"n{i}"] * (r[f"v{i}"] + (r[f"m{i}"] - mean) ** 2) for r in used if r[f"n{i}"])
            if not scaled:
                centre[i], scale[i] = mean, np.sqrt(square / n) if square > 0 else 1.0
            if any(r[f"n{i}"] < r["rows"] for r in stats):
                holes.append(c)
        for c, value in (medians(f, holes) if holes else {}).items():
            fill[columns.index(c)] = value if value is not None else 0.0
        maps[f] = FoldMap(fill, centre, scale)
    return maps


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _design(batch: pa.RecordBatch, f: int, maps: dict, training: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers of the fit's training or held-out rows, their features with a last column of ones)."""
    fold = batch.column("fold").to_numpy(zero_copy_only=False)
    fit = batch.column("fit").fill_null(-2).to_numpy(zero_copy_only=False)
    role = batch.column("split").to_numpy(zero_copy_only=False) == "train"
    mine = np.flatnonzero(((fit == -2) | (fit == f)) & ((role & (fold != f)) if training else (fold == f)))
    x = _numbers(batch, "x")[mine]
    if len(mine) and f in maps:
        x = maps[f](x)
    return mine, np.column_stack([x, np.ones(len(mine))])


def _probability(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def _sums(rows: DataFrame, weights: dict, maps: dict, class_weight: dict, width: int) -> dict[int, np.ndarray]:
    """{fit: [loss, gradient, Hessian, weight of the rows]} at the given weights; one pass over the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(2 + width + width * width) for f in weights}
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            for f, beta in weights.items():
                mine, x = _design(batch, f, maps, training=True)
                if not len(mine):
                    continue
                y = label[mine]
                w = np.where(y == 1, class_weight[f][1], class_weight[f][0])
                z = x @ beta
                p = _probability(z)
                out = total[f]
                out[0] += (w * (np.logaddexp(0, z) - y * z)).sum()
                out[1:1 + width] += x.T @ (w * (p - y))
                out[1 + width:-1] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
                out[-1] += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array(list(total.values()), pa.list_(pa.float64()))], names=["fit", "part"])

    parts = rows.mapInArrow(run, "fit int, part array<double>").select("fit", F.posexplode("part").alias("at", "value"))
    got = parts.groupBy("fit", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {f: np.zeros(2 + width + width * width) for f in weights}
    for f, of in got.groupby("fit"):
        out[f][of["at"].to_numpy()] = of["value"].to_numpy()
    return out


def fit_folds(rows: DataFrame, fits, width: int, maps: dict, class_weight: dict, reg: dict, tol: float = 1e-8,
              max_passes: int = MAX_PASSES) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Weights of every fit (the intercept last), and the passes each took.

    ``rows``: fit, fold, split, label, x. ``class_weight`` {fit: {0: w, 1: w}} and
    ``reg`` {fit: penalty}. A fit that takes ``max_passes`` has not converged.
    """
    width += 1
    ridge = np.append(np.ones(width - 1), 0.0)
    at_once = max(1, PASS_BYTES // (8 * (2 + width + width * width)))
    beta = {f: np.zeros(width) for f in fits}
    kept: dict = {}  # fit -> (objective, weights) of the best step so far
    passes = {f: 0 for f in fits}
    active = list(fits)
    while active:
        for begin in range(0, len(active), at_once):
            turn = active[begin:begin + at_once]
            for f, s in _sums(rows, {f: beta[f] for f in turn}, maps, class_weight, width).items():
                passes[f] += 1
                n = max(s[-1], 1e-300)
                value = s[0] / n + reg[f] / 2 * (ridge * beta[f] ** 2).sum()
                if f in kept and value > kept[f][0] + 1e-12 * abs(kept[f][0]):
                    beta[f] = (beta[f] + kept[f][1]) / 2
                    continue
                kept[f] = (value, beta[f])
                gradient = s[1:1 + width] / n + reg[f] * ridge * beta[f]
                hessian = s[1 + width:-1].reshape(width, width) / n + np.diag(reg[f] * ridge + 1e-12)
                step = np.linalg.solve(hessian, gradient)
                beta[f] = beta[f] - step
                if np.abs(step).max() < tol:
                    passes[f] = -passes[f]  # done
        active = [f for f in active if 0 <= passes[f] < max_passes]
    return beta, {f: abs(n) for f, n in passes.items()}


def score_folds(rows: DataFrame, beta: dict, maps: dict) -> DataFrame:
    """(row_id, label, split, fold, score, pred): every row by the fit that did not see it; one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, b in beta.items():
                mine, x = _design(batch, f, maps, training=False)
                p = _probability(x @ b)
                own = batch.take(pa.array(mine)).select(["row_id", "label", "split", "fold"])
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(p), pa.array((p > 0.5).astype(np.int32))],
                    names=["row_id", "label", "split", "fold", "score", "pred"])

    plain = rows.select("row_id", F.col("label").cast("int").alias("label"), "split", F.col("fold").cast("int").alias("fold"),
                        "fit", "x")
    key = rows.schema["row_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"row_id {key}, label int, split string, fold int, score double, pred int")


class LinearScorer(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted logistic regression as a persistable stage; scores JVM-side."""

    coefficients = Param(Params._dummy(), "coefficients", "weights", typeConverter=TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, featuresCol="features", coefficients=None, intercept=0.0):
        super().__init__()
        self._setDefault(featuresCol="features", coefficients=[], intercept=0.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.getOrDefault("coefficients")]).cast("array<double>")
        products = F.zip_with(vector_to_array(self.getFeaturesCol()), weights, lambda x, w: x * w)
        margin = F.lit(self.getOrDefault("intercept")) + F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
        return (df.withColumn("__margin", margin)
                .withColumn("rawPrediction", array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))))
                .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("prediction", (F.col("__margin") > 0).cast("double")).drop("__margin"))
