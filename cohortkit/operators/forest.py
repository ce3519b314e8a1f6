"""Random forests on binned cells: one pass over the rows, whatever their number.

A forest sees a value only through its bin, and each tree counts a row as often as a
Poisson(1) draw says. Rows with the same bins and class are therefore one cell of n
rows, which a tree counts Poisson(n) times: the sum of its rows' draws. So the rows
are read once to count the cells, at most 2 x max_bins^columns of them, and the trees
grow on the cells, each as Spark's own one-tree forest under its draws as weights.
Where cells do not repeat there is one a row, and nothing is lost.

The draws come from a hash of the cell, not from where a row lies.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cohortkit.functions.columns import qcol
from cohortkit.operators.features import assembler, exact_quantiles, wide_columns
from cohortkit.session import checkpoint_dir

# Bins a column (Spark's default), trees grown at a time.
MAX_BINS = 32
TREES_AT_ONCE = 8


@dataclass
class CellForest:
    """The trees of a forest; the importances are weighed as in Spark's own ensembles."""

    trees: list
    numFeatures: int

    @property
    def featureImportances(self) -> DenseVector:
        total = np.sum([t.featureImportances.toArray() for t in self.trees], axis=0)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)


def bin_cuts(df: DataFrame, columns, max_bins: int = MAX_BINS, wide=None) -> dict:
    """{column: ascending cuts between its bins}, from all rows.

    A column of at most ``max_bins`` values is cut between neighbouring values, any other at its exact quantiles.
    ``wide``: see ``exact_quantiles``.
    """
    columns = list(columns)
    row = df.agg(*[F.approx_count_distinct(qcol(c), 0.05).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if row[f"d{i}"] <= 2 * max_bins]  # an estimate: what was found decides
    values = {}
    if few:
        found = df.agg(*[F.collect_set(qcol(c).cast("double")).alias(f"v{i}") for i, c in enumerate(few)]).first()
        values = {c: sorted(found[f"v{i}"]) for i, c in enumerate(few)}
    values = {c: v for c, v in values.items() if len(v) <= max_bins}
    cuts = {c: [a / 2 + b / 2 for a, b in zip(v, v[1:])] for c, v in values.items()}
    many = [c for c in columns if c not in cuts]
    if many:
        wide = wide_columns(df, many) if wide is None else set(wide) & set(many)
        for c, q in exact_quantiles(df, many, [j / max_bins for j in range(1, max_bins)], wide).items():
            cuts[c] = sorted(set(q or []))
    return cuts


def binned_cells(df: DataFrame, columns, label: str, max_bins: int = MAX_BINS, wide=None) -> DataFrame:
    """(label, b0, b1, ..., n): the number of rows of each class in each combination of bins."""
    columns = list(columns)
    cuts = bin_cuts(df, columns, max_bins, wide)
    out = df.select(qcol(label).cast("double").alias("label"), *[qcol(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    of = [i for i, c in enumerate(columns) if cuts[c]]
    if of:
        inf = float("inf")
        out = Bucketizer(inputCols=[f"x{i}" for i in of], outputCols=[f"b{i}" for i in of], handleInvalid="error",
                         splitsArray=[[-inf, *cuts[columns[i]], inf] for i in of]).transform(out)
    out = out.select("label", *[(F.col(f"b{i}") if i in of else F.lit(0.0)).alias(f"b{i}") for i in range(len(columns))])
    return out.groupBy("label", *[f"b{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("n"))


def poisson_draws(key: F.Column, n: F.Column, size: int) -> F.Column:
    """``size`` Poisson(n) draws, the same for a key wherever its row lies."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def draw(keys: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([np.random.Generator(np.random.Philox(key=int(k) & (2**64 - 1))).poisson(m, size).astype(np.int32)
                          for k, m in zip(keys, ns)], dtype=object)

    return draw(key, n)


def fit_cell_forest(df: DataFrame, columns, label: str = "label", n_trees: int = 50, max_depth: int = 10, seed: int = 42,
                    max_bins: int = MAX_BINS, wide=None) -> CellForest:
    """A forest of ``n_trees`` on numeric columns without nulls; sqrt of the columns a node."""
    columns = list(columns)
    checkpoint_dir(df.sparkSession)
    names = [f"b{i}" for i in range(len(columns))]
    cells = binned_cells(df, columns, label, max_bins, wide)
    key = F.xxhash64(F.lit(seed), "label", *names)
    drawn = assembler(names).transform(cells.withColumn("draws", poisson_draws(key, F.col("n"), n_trees)))
    drawn = drawn.select("features", "label", "draws").checkpoint()
    # bins are few: with as many allowed as this, all cells and not a sample of them say which there are
    every = max(max_bins, math.ceil(math.sqrt(drawn.count())) + 1)

    def tree(t: int):
        bag = drawn.select("features", "label", F.col("draws")[t].cast("double").alias("bag")).filter("bag > 0")
        one = RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                     maxBins=every, seed=seed + t, weightCol="bag")
        return one.fit(bag).trees[0]

    with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as pool:
        trees = list(pool.map(inheritable_thread_target(df.sparkSession)(tree), range(n_trees)))
    return CellForest(trees, len(columns))
