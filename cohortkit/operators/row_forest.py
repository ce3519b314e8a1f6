"""Random forests whose small nodes are finished each in one task.

Spark's forest sends the sums of all bins of every open node from every partition, a
pass over all rows for each group of nodes that fits its memory; the nodes of deep
trees grow with the rows, so passes times rows grow with their square. Here only
nodes of more than ``FINISH_ROWS`` rows are split that way, a level a pass. The rows
of every other node travel once to the task that grows the rest of its tree, so each
row moves once a tree, whatever the depth.

The forest is that of Spark: up to 256 bins a column, Poisson(1) draws of each row
for each tree, sqrt of the columns a node, gini, class shares of the leaves averaged,
two leaves of the same class merged. Cuts are sketched from all rows. Rows with the
same bins, class and weight are one cell that is drawn Poisson(n) times
(``operators.forest``), so copies of a row do not fill a node.

Draws and columns come from hashes of the cell and of (tree, node), not from where a
row lies. Weights are scaled to whole numbers, so that sums do not hang on their order.

A node has the number 1 at the root, 2i and 2i + 1 below i. The driver holds the
nodes, at most 2^(depth + 1) a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed, HasWeightCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from cohortkit.operators.forest import poisson_draws
from cohortkit.session import checkpoint_dir

# Bins a column; rank error of a sketched cut; rows up to which a node is finished in one task;
# rows a partition of the passes; bytes of sums a task holds (more nodes take turns); cells of sums scanned at a time.
BINS = 256
CUT_ERROR = 1 / 4096
FINISH_ROWS = 100_000
PART_ROWS = 20_000
PASS_BYTES = 128_000_000
SCAN_CELLS = 2**17
FINISH_TASKS = 1000

_NODES = "tree int, id array<bigint>, column array<int>, cut array<int>, zero array<double>, one array<double>"


def vector_cuts(rows: DataFrame, width: int, max_bins: int = BINS) -> list:
    """Ascending cuts of each entry of ``x``: between neighbouring values where there are few, else at sketched quantiles."""
    flat = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in range(width)])
    names = flat.columns
    about = flat.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in names]).first()
    few = [c for c in names if about[c] <= 2 * max_bins]  # an estimate: what was found decides
    cuts = {}
    if few:
        for c, v in flat.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict().items():
            if len(v) <= max_bins:
                v = sorted(v)
                cuts[c] = [a / 2 + b / 2 for a, b in zip(v, v[1:])]
    many = [c for c in names if c not in cuts]
    if many:
        probs = [j / max_bins for j in range(1, max_bins)]
        cuts |= {c: sorted(set(q)) for c, q in zip(many, flat.approxQuantile(many, probs, CUT_ERROR))}
    return [np.array(cuts[c], dtype=np.float64) for c in names]


def drawn_cells(rows: DataFrame, cuts: list, n_trees: int, seed: int, parts: int) -> DataFrame:
    """(label, weight, bins binary, draws array<int>) of every different row; one byte a bin."""

    @F.pandas_udf(BinaryType())
    def binned(xs: pd.Series) -> pd.Series:
        out = np.empty((len(xs), len(cuts)), dtype=np.uint8)
        if len(xs):
            x = np.stack(xs.to_numpy())
            for j, c in enumerate(cuts):
                out[:, j] = np.searchsorted(c, x[:, j])
        return pd.Series([r.tobytes() for r in out], dtype=object)

    cell = ["label", "weight", "bins"]
    cells = rows.select("label", "weight", binned("x").alias("bins")).groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("key", F.xxhash64(F.lit(seed), *cell)).repartition(parts, "key")
    return cells.select(*cell, "n", poisson_draws(F.col("key"), F.col("n"), n_trees).alias("draws")).checkpoint()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def chosen_columns(seed: int, tree: int, nodes: np.ndarray, width: int, k: int) -> np.ndarray:
    """The ``k`` columns that each node may split on, ascending; equally likely, by a hash."""
    step = np.uint64(0x9E3779B97F4A7C15)
    start = _mix(np.array([seed & (2**64 - 1)], dtype=np.uint64) + step) ^ np.uint64(tree)
    own = _mix(_mix(start * step) + nodes.astype(np.uint64) * step)
    drawn = _mix(own[:, None] + np.arange(1, width + 1, dtype=np.uint64) * step)
    return np.sort(np.argpartition(drawn, k - 1, axis=1)[:, :k], axis=1)


def best_cuts(zero: np.ndarray, one: np.ndarray) -> tuple:
    """(found, place of the column, bin) of the cut with the least gini, for sums (node, column, bin) of both classes.

    Rows up to the bin go left. Equal gains go to the earlier column, then to the smaller cut.
    """
    l0, l1 = zero.cumsum(axis=2), one.cumsum(axis=2)
    t0, t1 = l0[:, :1, -1:], l1[:, :1, -1:]
    left, right = l0 + l1, (t0 - l0) + (t1 - l1)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (l0 * l0 + l1 * l1) / left + ((t0 - l0) ** 2 + (t1 - l1) ** 2) / right
        score[(left <= 0) | (right <= 0)] = -np.inf
        score = score.reshape(len(zero), -1)
        at = score.argmax(axis=1)
        t0, t1 = t0.ravel(), t1.ravel()
        found = score[np.arange(len(at)), at] - (t0 * t0 + t1 * t1) / (t0 + t1) > 1e-12 * (t0 + t1)
    return found, at // zero.shape[2], at % zero.shape[2]


def pruned(nodes: dict) -> dict:
    """The nodes, ascending, with two leaves of the same class merged into their parent, from below."""
    order = np.argsort(nodes["id"])
    nodes = {k: v[order] for k, v in nodes.items()}
    ids, column, kind = nodes["id"], nodes["column"].copy(), nodes["one"] > nodes["zero"]
    keep = np.ones(len(ids), dtype=bool)
    level = np.frexp(ids.astype(np.float64))[1]
    for depth in range(int(level.max()), 0, -1):
        inner = np.flatnonzero((level == depth) & (column >= 0))
        a = np.searchsorted(ids, 2 * ids[inner])  # the two children are neighbours
        same = (column[a] < 0) & (column[a + 1] < 0) & (kind[a] == kind[a + 1]) if len(inner) else np.zeros(0, dtype=bool)
        column[inner[same]] = -1
        keep[a[same]] = keep[a[same] + 1] = False
    return {k: v[keep] for k, v in (nodes | {"column": column}).items()}


def grow(bins: np.ndarray, zero: np.ndarray, one: np.ndarray, seed: int, tree: int, root: int, max_depth: int, k: int) -> dict:
    """The nodes from ``root`` down, grown on its rows; a level at a time."""
    ids, at = np.array([root], dtype=np.int64), np.zeros(len(bins), dtype=np.int64)
    made = []
    at_once = max(1, SCAN_CELLS // (k * BINS))
    for depth in range(root.bit_length() - 1, max_depth + 1):
        n = len(ids)
        t0, t1 = np.bincount(at, zero, n), np.bincount(at, one, n)
        column, cut = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        made.append((ids, column, cut, t0, t1))
        mixed = np.flatnonzero((t0 > 0) & (t1 > 0))
        if depth == max_depth or not len(mixed):
            break
        rank = np.full(n, -1, dtype=np.int64)
        rank[mixed] = np.arange(len(mixed))
        keep = rank[at] >= 0
        bins, zero, one, at = bins[keep], zero[keep], one[keep], at[keep]
        order = np.argsort(rank[at], kind="stable")
        bins, zero, one, at = bins[order], zero[order], one[order], at[order]
        ends = np.searchsorted(rank[at], np.arange(len(mixed) + 1))
        may = chosen_columns(seed, tree, ids[mixed], bins.shape[1], k)
        for a in range(0, len(mixed), at_once):
            b = min(a + at_once, len(mixed))
            rows = slice(ends[a], ends[b])
            place = rank[at[rows]]
            cell = (np.take_along_axis(bins[rows], may[place], axis=1)
                    + ((place - a)[:, None] * k + np.arange(k)) * BINS).ravel()
            shape, size = (b - a, k, BINS), (b - a) * k * BINS
            found, j, c = best_cuts(np.bincount(cell, np.repeat(zero[rows], k), size).reshape(shape),
                                    np.bincount(cell, np.repeat(one[rows], k), size).reshape(shape))
            split = mixed[a:b][found]
            column[split], cut[split] = may[a:b][found, j[found]], c[found]
        split = np.flatnonzero(column >= 0)
        if not len(split):
            break
        rank = np.full(n, -1, dtype=np.int64)
        rank[split] = np.arange(len(split))
        keep = column[at] >= 0
        bins, zero, one, at = bins[keep], zero[keep], one[keep], at[keep]
        at = 2 * rank[at] + (bins[np.arange(len(at)), column[at]] > cut[at])
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()
    return dict(zip(("id", "column", "cut", "zero", "one"), (np.concatenate(of) for of in zip(*made))))


def _decoded(batch, scale: float) -> tuple:
    """(bins, draws, weight of a draw in each class) of a batch of cells; weights are whole numbers."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
    draws = batch.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    weight = np.round(batch.column("weight").to_numpy(zero_copy_only=False) * scale)
    one = batch.column("label").to_numpy(zero_copy_only=False) == 1
    return bins, draws, np.where(one, 0.0, weight), np.where(one, weight, 0.0)


def _node_of(top: dict, bins: np.ndarray) -> np.ndarray:
    """The node that each row reaches in the part {node: (column, cut)} of a tree."""
    node = np.ones(len(bins), dtype=np.int64)
    for n in sorted(top):
        column, cut = top[n]
        here = np.flatnonzero(node == n)
        node[here] = 2 * n + (bins[here, column] > cut)
    return node


def _split_level(cells: DataFrame, open_: list, tops: list, scale: float, seed: int, width: int, k: int) -> list:
    """Best cuts of (tree, node) pairs and the sums on both sides; one pass over the cells, added up by Spark."""
    of: dict = {}
    for t, node in open_:
        of.setdefault(t, []).append((node, chosen_columns(seed, t, np.array([node]), width, k)[0]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {(t, n): np.zeros((3, k * BINS)) for t in of for n, _ in of[t]}
        for batch in batches:
            if not len(batch):
                continue
            bins, draws, zero, one = _decoded(batch, scale)
            for t in of:
                drawn = np.flatnonzero(draws[:, t])
                node = _node_of(tops[t], bins[drawn])
                for n, columns in of[t]:
                    mine = drawn[node == n]
                    cell = (bins[mine][:, columns] + np.arange(k) * BINS).ravel()
                    times = draws[mine, t]
                    for s, w in enumerate((zero[mine] * times, one[mine] * times, np.ones(len(mine)))):
                        total[t, n][s] += np.bincount(cell, np.repeat(w, k), k * BINS)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.int32()), pa.array([n for _, n in keys], pa.int64()),
                                          pa.array([total[key].tobytes() for key in keys], pa.binary())],
                                         names=["tree", "node", "sums"])

    def best(key, table):
        t, n = (v.as_py() for v in key)
        s = np.sum([np.frombuffer(b) for b in table.column("sums").to_pylist()], axis=0).reshape(3, k, BINS)
        found, j, c = best_cuts(s[:1], s[1:2])
        j, c = int(j[0]), int(c[0])
        column = int(chosen_columns(seed, t, np.array([n]), width, k)[0][j]) if found[0] else -1
        whole = s[:, 0].sum(axis=1)
        left = s[:, j, :c + 1].sum(axis=1) if found[0] else whole
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int64()), "column": pa.array([column], pa.int32()),
                         "cut": pa.array([c], pa.int32()), "left": pa.array([left], pa.list_(pa.float64())),
                         "right": pa.array([whole - left], pa.list_(pa.float64()))})

    parts = cells.mapInArrow(sums, "tree int, node bigint, sums binary")
    return parts.groupBy("tree", "node").applyInArrow(
        best, "tree int, node bigint, column int, cut int, left array<double>, right array<double>").collect()


def _finish(cells: DataFrame, todo: set, tops: list, scale: float, seed: int, max_depth: int, k: int) -> list:
    """The nodes below every (tree, node) of ``todo``: its rows travel to one task, which grows them."""
    trees = sorted({t for t, _ in todo})
    ends = {t: [n for s, n in todo if s == t] for t in trees}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            bins, draws, zero, one = _decoded(batch, scale)
            for t in trees:
                drawn = np.flatnonzero(draws[:, t])
                node = _node_of(tops[t], bins[drawn])
                out = []
                for n in ends[t]:
                    mine = drawn[node == n]
                    if len(mine):
                        times = draws[mine, t]
                        out.append((n, bins[mine].tobytes(), (zero[mine] * times).tobytes(), (one[mine] * times).tobytes()))
                if out:
                    n, *of = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(n), pa.int32()), pa.array(n, pa.int64()),
                                                      *[pa.array(o, pa.binary()) for o in of]],
                                                     names=["tree", "node", "bins", "zero", "one"])

    def grown(key, table):
        t, n = (v.as_py() for v in key)
        bins, zero, one = (b"".join(table.column(c).to_pylist()) for c in ("bins", "zero", "one"))
        zero, one = np.frombuffer(zero), np.frombuffer(one)
        nodes = pruned(grow(np.frombuffer(bins, dtype=np.uint8).reshape(len(zero), -1), zero, one, seed, t, n, max_depth, k))
        kinds = {"id": pa.int64(), "column": pa.int32(), "cut": pa.int32(), "zero": pa.float64(), "one": pa.float64()}
        return pa.table({"tree": pa.array([t], pa.int32())}
                        | {c: pa.array([nodes[c]], pa.list_(kind)) for c, kind in kinds.items()})

    rows = cells.mapInArrow(dealt, "tree int, node bigint, bins binary, zero binary, one binary")
    rows = rows.repartition(min(len(todo), FINISH_TASKS), "tree", "node")
    return rows.groupBy("tree", "node").applyInArrow(grown, _NODES).collect()


def fit_rows(rows: DataFrame, n_trees: int, max_depth: int, seed: int = 42, max_bins: int = BINS,
             finish_rows: int = FINISH_ROWS) -> tuple[list, int]:
    """([nodes of each tree], width) of a forest on rows (x array<double>, label 0/1, weight)."""
    checkpoint_dir(rows.sparkSession)
    bad = F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0)
    n_rows, strange, width = rows.agg(F.count(F.lit(1)), F.count(F.when(bad, 1)), F.max(F.size("x"))).first()
    if not n_rows or strange:
        raise ValueError(f"a forest needs rows of the classes 0 and 1: {n_rows} rows, {strange} of no such class")
    if not 2 <= max_bins <= BINS:
        raise ValueError(f"bins a column: 2 to {BINS}, not {max_bins}")
    k = math.ceil(math.sqrt(width))
    cuts = vector_cuts(rows, width, max_bins)
    cells = drawn_cells(rows, cuts, n_trees, seed, math.ceil(n_rows / PART_ROWS))
    n_cells, weight = cells.agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("weight"))).first()
    # a tree's draws weigh about as much as all rows; sums stay below 2^53
    scale = 2.0 ** (48 - math.ceil(math.log2(weight))) if weight and weight > 0 else 1.0
    tops: list = [{} for _ in range(n_trees)]
    ended: list = [[] for _ in range(n_trees)]  # (id, column, cut, zero, one) of nodes whose sums are known
    roots = [(t, 1) for t in range(n_trees)]
    todo, open_ = (set(roots), []) if n_cells <= finish_rows else (set(), roots)
    at_once = max(1, PASS_BYTES // (3 * 8 * k * BINS))
    depth = 0
    while open_:
        after = []
        for begin in range(0, len(open_), at_once):
            for r in _split_level(cells, open_[begin:begin + at_once], tops, scale, seed, width, k):
                t, n, left, right = r["tree"], r["node"], r["left"], r["right"]
                ended[t].append((n, r["column"], r["cut"], left[0] + right[0], left[1] + right[1]))
                for child, side in ((2 * n, left), (2 * n + 1, right)) if r["column"] >= 0 else ():
                    if side[2] <= finish_rows:
                        todo.add((t, child))
                    elif depth + 1 == max_depth or not (side[0] > 0 and side[1] > 0):
                        ended[t].append((child, -1, 0, side[0], side[1]))
                    else:
                        after.append((t, child))
        for t in range(n_trees):
            tops[t] = {n: (column, cut) for n, column, cut, *_ in ended[t] if column >= 0}
        open_, depth = after, depth + 1
    made: list = [[] for _ in range(n_trees)]
    for r in _finish(cells, todo, tops, scale, seed, max_depth, k) if todo else ():
        made[r["tree"]].append([np.array(r[c]) for c in ("id", "column", "cut", "zero", "one")])
    trees = []
    for t in range(n_trees):
        if ended[t]:
            made[t].append([np.array(v) for v in zip(*ended[t])])
        if not made[t]:  # no row was drawn
            made[t].append([np.array([v]) for v in (1, -1, 0, 0.0, 0.0)])
        nodes = pruned(dict(zip(("id", "column", "cut", "zero", "one"), (np.concatenate(of) for of in zip(*made[t])))))
        inner = nodes["column"] >= 0
        value = np.zeros(len(inner))
        value[inner] = [cuts[c][b] for c, b in zip(nodes["column"][inner], nodes["cut"][inner])]
        trees.append({"column": nodes["column"], "cut": value, "zero": nodes["zero"] / scale, "one": nodes["one"] / scale,
                      "left": np.where(inner, np.searchsorted(nodes["id"], 2 * nodes["id"]), 0)})
    return trees, width


class _ForestParams(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed):
    numTrees = Param(Params._dummy(), "numTrees", "trees", typeConverter=TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels", typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins a column", typeConverter=TypeConverters.toInt)


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        rows = [(t, *[of[c].tolist() for c in ("column", "cut", "left", "zero", "one")]) for t, of in enumerate(self.instance.trees)]
        self.sparkSession.createDataFrame(rows, "tree int, column array<int>, cut array<double>, left array<int>, "
                                                "zero array<double>, one array<double>").write.parquet(f"{path}/trees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        model = super().load(path)
        rows = self.sparkSession.read.parquet(f"{path}/trees").collect()
        model.trees = [{c: np.array(r[c]) for c in ("column", "cut", "left", "zero", "one")} for r in sorted(rows, key=lambda r: r["tree"])]
        return model


class RowForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """A grown forest as a persistable stage; Arrow batches walk all trees, level by level."""

    numFeatures = Param(Params._dummy(), "numFeatures", "width of a row", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, featuresCol="features", maxDepth=0, numFeatures=0):
        super().__init__()
        self._setDefault(featuresCol="features", maxDepth=0, numFeatures=0)
        self._set(**self._input_kwargs)
        self.trees: list = []

    def write(self) -> _ForestWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> _ForestReader:
        return _ForestReader(cls)

    @property
    def totalNumNodes(self) -> int:
        return sum(len(t["column"]) for t in self.trees)

    @property
    def featureImportances(self) -> DenseVector:
        """Gini gain of each column, normalised a tree, averaged and normalised, as in Spark's ensembles."""
        total = np.zeros(self.getOrDefault("numFeatures"))
        for t in self.trees:
            n = t["zero"] + t["one"]
            loss = 2 * t["zero"] * t["one"] / np.where(n > 0, n, 1.0)  # gini times weight
            at = np.flatnonzero(t["column"] >= 0)
            left = t["left"][at]
            own = np.bincount(t["column"][at], loss[at] - loss[left] - loss[left + 1], len(total))
            total += own / own.sum() if own.sum() > 0 else 0.0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        depth = self.getOrDefault("maxDepth")
        known = [t for t in self.trees if t["zero"][0] + t["one"][0] > 0]
        sent = df.sparkSession.sparkContext.broadcast(
            [(t["column"].astype(np.int32), t["cut"], t["left"].astype(np.int32), t["one"] / (t["zero"] + t["one"])) for t in known])

        @F.pandas_udf(ArrayType(DoubleType()))
        def votes(xs: pd.Series) -> pd.Series:
            one = np.zeros(len(xs))
            if len(xs):
                x, at = np.stack(xs.to_numpy()), np.arange(len(xs))
                for column, cut, left, share in sent.value:
                    node = np.zeros(len(xs), dtype=np.int32)
                    for _ in range(depth):
                        c = column[node]
                        node = np.where(c < 0, node, left[node] + ~(x[at, c] <= cut[node]))
                    one += share[node]
            return pd.Series(list(np.column_stack([len(sent.value) - one, one])), dtype=object)

        raw = votes(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        share = F.transform("__votes", lambda v: v / F.lit(float(max(1, len(known)))))
        return (df.withColumn("__votes", raw).withColumn("rawPrediction", array_to_vector("__votes"))
                .withColumn("probability", array_to_vector(share))
                .withColumn("prediction", (F.col("__votes")[1] > F.col("__votes")[0]).cast("double")).drop("__votes"))


class RowForestClassifier(Estimator, _ForestParams):
    """Forest of gini trees for classes 0 and 1; rows weigh what `weightCol` says, or one."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", weightCol=None, numTrees=50, maxDepth=10, maxBins=BINS, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", numTrees=50, maxDepth=10, maxBins=BINS, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> RowForestModel:
        get = self.getOrDefault
        weight = F.col(get("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("label"),
                         weight.alias("weight"))
        trees, width = fit_rows(rows, get("numTrees"), get("maxDepth"), get("seed"), get("maxBins"))
        model = RowForestModel(featuresCol=get("featuresCol"), maxDepth=get("maxDepth"), numFeatures=width)
        model.trees = trees
        return model
