"""Feed-forward networks with ReLU units, an L2 term and early stopping, on Spark.

Full-batch back-propagation: in a pass every task computes loss and gradient over
its rows, the sums over tasks are the gradient, and the driver takes a limited-
memory quasi-Newton step (10 last steps, halved until the loss falls enough). All
folds of a cross-validation are trained in the same passes, each on its own rows.

A tenth of a fit's rows, drawn by a hash of the row id, is not trained on; after
every step (an epoch) their accuracy is measured in the same pass. Training stops
when it has not risen by `tol` for `patience` epochs, and the best epoch's weights
are kept. Without validation rows the training loss takes that part.

Results do not depend on partitions, retries or the order of sums: rows lie in
blocks dealt by a hash of their id and sorted inside, a block's sums are rounded
to a fixed binary fraction, and those integers add up exactly.

The loss is the mean log loss plus alpha / (2 n) times the squared weights (biases
have no penalty); starting weights are hash-uniform within +-sqrt(6 / (in + out)).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasTol, Param, Params,
                                     TypeConverters)
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions.hashing import uniform
from cohortkit.operators.foldfit import _design, _probability
from cohortkit.session import checkpoint_dir

# Share of rows kept for validation, epochs without gain, and the gain that counts.
VALIDATION, PATIENCE, GAIN = 0.1, 10, 1e-4
#: Rows of a block, blocks of a partition, and numbers of one piece of the summed gradient.
BLOCK_ROWS, BLOCKS_PER_PART, PIECE = 2048, 10, 4096
HISTORY = 10


def shapes(layers) -> list[tuple[int, int]]:
    """(rows, columns) of every weight matrix; its last row holds the biases."""
    return [(a + 1, b) for a, b in zip(layers[:-1], layers[1:])]


def starting_weights(layers, seed: int) -> np.ndarray:
    """Uniform numbers of md5('seed|w|layer|row|column'), row by row; the bias row comes last."""
    out = []
    for number, (rows, columns) in enumerate(shapes(layers)):
        bound = math.sqrt(6.0 / (rows - 1 + columns))
        for i in range(rows):
            for j in range(columns):
                u = int(hashlib.md5(f"{seed}|w|{number}|{i}|{j}".encode()).hexdigest()[:8], 16) / 2**32
                out.append((2 * u - 1) * bound)
    return np.array(out)


def _matrices(theta: np.ndarray, layers) -> list[np.ndarray]:
    out, at = [], 0
    for rows, columns in shapes(layers):
        out.append(theta[at:at + rows * columns].reshape(rows, columns))
        at += rows * columns
    return out


def margins(x: np.ndarray, theta: np.ndarray, layers) -> tuple[np.ndarray, list[np.ndarray]]:
    """Output before the sigmoid, and the inputs of every layer (each with a last column of ones)."""
    a, inputs = x, []
    for m in (matrices := _matrices(theta, layers)):
        a = np.column_stack([a, np.ones(len(a))])
        inputs.append(a)
        a = a @ m
        if m is not matrices[-1]:
            a = np.maximum(a, 0.0)
    return a[:, 0], inputs


def loss_and_gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, layers) -> tuple[float, np.ndarray]:
    """Sums of the log loss and of its gradient over the rows."""
    z, inputs = margins(x, theta, layers)
    delta = (_probability(z) - y)[:, None]
    parts = []
    for m, a in zip(reversed(_matrices(theta, layers)), reversed(inputs)):
        parts.append((a.T @ delta).ravel())
        delta = (delta @ m[:-1].T) * (a[:, :-1] > 0)
    return float((np.logaddexp(0, z) - y * z).sum()), np.concatenate(parts[::-1])


def _blocks(rows: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """Rows packed into blocks that depend on row ids only, written once; and the number of blocks."""
    checkpoint_dir(rows.sparkSession)
    n = rows.count()
    count = max(1, math.ceil(n / BLOCK_ROWS))
    one = F.struct("row_id", "fit", "fold", "split", "label", "x",
                   (uniform(seed, F.lit("val"), F.col("row_id")) < VALIDATION).alias("held"))
    packed = (rows.groupBy(F.pmod(F.xxhash64("row_id"), F.lit(count)).alias("block"))
              .agg(F.sort_array(F.collect_list(one)).alias("rows")))
    return packed.repartition(max(1, math.ceil(count / BLOCKS_PER_PART)), "block").checkpoint(), count


def _pass(blocks: DataFrame, thetas: dict, layers, maps: dict, bits: int) -> dict[int, tuple]:
    """{fit: (loss, gradient, rows, validation rows, of them right)}, one pass over the blocks."""
    size = len(next(iter(thetas.values())))
    scale = 2.0**bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(size + 4, np.int64) for f in thetas}
        for batch in batches:
            for i in range(len(batch)):
                block = pa.RecordBatch.from_struct_array(batch.column("rows").slice(i, 1).flatten())
                held = block.column("held").to_numpy(zero_copy_only=False)
                label = block.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                for f, theta in thetas.items():
                    mine, x = _design(block, f, maps, training=True)
                    x, y, check = x[:, :-1], label[mine], held[mine]
                    loss, gradient = loss_and_gradient(x[~check], y[~check], theta, layers)
                    numbers = np.append(gradient, loss) * scale
                    if not np.abs(numbers).max(initial=0.0) < 2.0**62:
                        raise ValueError("the gradient leaves the summing range; scale the features")
                    total[f][:size + 1] += np.rint(numbers).astype(np.int64)
                    right = (margins(x[check], theta, layers)[0] > 0) == (y[check] == 1)
                    total[f][size + 1:] += [int((~check).sum()), int(check.sum()), int(right.sum())]
        for f, numbers in total.items():
            pieces = [numbers[a:a + PIECE] for a in range(0, len(numbers), PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()),
                 pa.array(pieces, pa.list_(pa.int64()))], names=["fit", "piece", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = table.column("part").combine_chunks()
        total = parts.flatten().to_numpy(zero_copy_only=False).reshape(len(parts), -1).sum(axis=0)
        return pa.table({"fit": table.column("fit").slice(0, 1), "piece": table.column("piece").slice(0, 1),
                         "part": pa.array([total], pa.list_(pa.int64()))})

    schema = "fit int, piece int, part array<bigint>"
    got = blocks.select("rows").mapInArrow(run, schema).groupBy("fit", "piece").applyInArrow(add, schema).collect()
    out = {}
    for f in thetas:
        numbers = np.concatenate([np.array(r["part"], np.int64) for r in sorted(
            (r for r in got if r["fit"] == f), key=lambda r: r["piece"])] or [np.zeros(size + 4, np.int64)])
        out[f] = (numbers[size] / scale, numbers[:size] / scale, *(int(v) for v in numbers[size + 1:]))
    return out


class _Fit:
    """One network's training state between passes."""

    def __init__(self, theta: np.ndarray, layers, alpha: float, max_epochs: int, patience: int, tol: float):
        self.trial, self.best = theta, theta
        self.layers, self.alpha, self.max_epochs, self.patience, self.tol = layers, alpha, max_epochs, patience, tol
        self.at = None  # accepted (weights, value, gradient)
        self.moves: list = []
        self.score, self.wait, self.epoch, self.done, self.best_epoch = -math.inf, 0, 0, False, 0
        self.curve: list = []
        self.ridge = np.concatenate([np.append(np.ones((r - 1) * c), np.zeros(c)) for r, c in shapes(layers)])

    def take(self, loss, gradient, n, n_held, right) -> None:
        n = max(n, 1)
        value = loss / n + self.alpha / (2 * n) * float((self.ridge * self.trial**2).sum())
        gradient = gradient / n + self.alpha / n * self.ridge * self.trial
        if self.at is not None:
            slope = float(self.at[2] @ self.direction)
            if value > self.at[1] + 1e-4 * self.step * slope:
                self.step /= 2
                self.done = self.step < 1e-8
                self.trial = self.at[0] + self.step * self.direction
                return
            move, turn = self.trial - self.at[0], gradient - self.at[2]
            if move @ turn > 1e-12:
                self.moves = [*self.moves, (move, turn)][-HISTORY:]
        self.at = (self.trial, value, gradient)
        score = right / n_held if n_held else -value
        self.curve.append((value, score))
        if score > self.score + self.tol:
            self.score, self.wait, self.best, self.best_epoch = score, 0, self.trial, self.epoch
        else:
            self.wait += 1
        self.done = self.wait >= self.patience or self.epoch >= self.max_epochs or np.abs(gradient).max() < 1e-10
        self.epoch += 1
        q, rates = gradient.copy(), []
        for move, turn in reversed(self.moves):
            rates.append(move @ q / (move @ turn))
            q -= rates[-1] * turn
        if self.moves:
            move, turn = self.moves[-1]
            q *= (move @ turn) / (turn @ turn)
        for (move, turn), rate in zip(self.moves, reversed(rates)):
            q += move * (rate - turn @ q / (move @ turn))
        self.direction = -q
        self.step = 1.0 if self.moves else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-300))
        self.trial = self.trial + self.step * self.direction


def fit_networks(rows: DataFrame, fits, layers, maps: dict, alpha: float, max_epochs: int, seed: int = 42,
                 patience: int = PATIENCE, tol: float = GAIN) -> dict[int, _Fit]:
    """Train one network a fit on rows (row_id, fit, fold, split, label, x) in common passes."""
    blocks, count = _blocks(rows, seed)
    bits = 62 - 20 - max(1, count).bit_length()  # a block's sums may reach 2^20
    state = {f: _Fit(starting_weights(layers, seed), layers, alpha, max_epochs, patience, tol) for f in fits}
    while active := [f for f in fits if not state[f].done]:
        for f, sums in _pass(blocks, {f: state[f].trial for f in active}, layers, maps, bits).items():
            state[f].take(*sums)
    return state


def first_step(rows: DataFrame, layers, alpha: float, seed: int = 42) -> tuple[float, dict]:
    """Loss and gradient {(layer, row, column): value} of one fit at its starting weights."""
    blocks, count = _blocks(rows, seed)
    theta = starting_weights(layers, seed)
    net = _Fit(theta, layers, alpha, 0, 0, 0.0)
    net.take(*_pass(blocks, {-1: theta}, layers, {}, 42 - max(1, count).bit_length())[-1])
    return float(net.at[1]), {(n, i, j): float(m[i, j]) for n, m in enumerate(_matrices(net.at[2], layers))
                       for i in range(m.shape[0]) for j in range(m.shape[1])}


def score_networks(rows: DataFrame, thetas: dict, layers, maps: dict) -> DataFrame:
    """(row_id, label, split, fold, score, pred): every row by the network that did not see it; one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, theta in thetas.items():
                mine, x = _design(batch, f, maps, training=False)
                p = _probability(margins(x[:, :-1], theta, layers)[0])
                own = batch.take(pa.array(mine)).select(["row_id", "label", "split", "fold"])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(p), pa.array((p > 0.5).astype(np.int32))],
                                                 names=["row_id", "label", "split", "fold", "score", "pred"])

    plain = rows.select("row_id", F.col("label").cast("int").alias("label"), "split", F.col("fold").cast("int").alias("fold"),
                        "fit", "x")
    key = rows.schema["row_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"row_id {key}, label int, split string, fold int, score double, pred int")


class _NetworkParams(HasFeaturesCol, HasLabelCol, HasSeed, HasMaxIter, HasTol):
    layers = Param(Params._dummy(), "layers", "widths from input to output", typeConverter=TypeConverters.toListInt)
    alpha = Param(Params._dummy(), "alpha", "L2 term", typeConverter=TypeConverters.toFloat)
    idCol = Param(Params._dummy(), "idCol", "row id, for blocks and the validation draw",
                  typeConverter=TypeConverters.toString)


class NetworkModel(Model, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """A trained network as a persistable stage."""

    weights = Param(Params._dummy(), "weights", "all weights", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", layers=None, weights=None):
        super().__init__()
        self._setDefault(featuresCol="features", layers=[], weights=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        layers, weights = self.getOrDefault("layers"), np.array(self.getOrDefault("weights"))

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for col in batches:
                x = np.stack(col.to_numpy()) if len(col) else np.zeros((0, layers[0]))
                yield pd.Series(margins(x, weights, layers)[0])

        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("__margin")))
        return (df.withColumn("__margin", margin(vector_to_array(self.getFeaturesCol())))
                .withColumn("rawPrediction", array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))))
                .withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("prediction", (F.col("__margin") > 0).cast("double")).drop("__margin"))


class NetworkClassifier(Estimator, _NetworkParams, DefaultParamsReadable, DefaultParamsWritable):
    """One network on assembled features, as an estimator."""

    @keyword_only
    def __init__(self, layers=None, alpha=1e-4, maxIter=200, seed=42, tol=GAIN, featuresCol="features", labelCol="label",
                 idCol="row_id"):
        super().__init__()
        self._setDefault(layers=[], alpha=1e-4, maxIter=200, seed=42, tol=GAIN, featuresCol="features", labelCol="label",
                         idCol="row_id")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> NetworkModel:
        get = self.getOrDefault
        rows = df.select(F.col(get("idCol")).alias("row_id"), F.lit(None).cast("int").alias("fit"), F.lit(0).alias("fold"),
                         F.lit("train").alias("split"), F.col(get("labelCol")).cast("double").alias("label"),
                         vector_to_array(get("featuresCol")).alias("x"))
        state = fit_networks(rows, [-1], get("layers"), {}, get("alpha"), get("maxIter"), get("seed"), tol=get("tol"))[-1]
        return NetworkModel(featuresCol=get("featuresCol"), layers=get("layers"), weights=[float(w) for w in state.best])
