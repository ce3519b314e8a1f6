"""Decision trees whose splits are searched over all distinct values, without bins.

A level is grown for all open nodes at once. (node, column, value) cells carry the
class weights, combined before the shuffle; they are range-sorted, and prefix sums
of the partitions' totals, a small table, turn each partition's running sums into
those of the whole node. So every cut between two neighbouring values gets its
gini from one sorted pass, and no task holds a column. Only the best cut of each
node reaches the driver, at most 2^depth rows.

Cuts lie midway between neighbouring values; equal gains go to the earlier column,
then to the smaller cut. A node stays a leaf when it is pure, at `max_depth`, or
when no column has two values. NaN and null go to the right of every cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.session import checkpoint_dir

# Fixed value: depth of the study's trees.
MAX_DEPTH = 10


@dataclass
class Tree:
    """Nodes as parallel lists; column -1 marks a leaf."""

    column: list
    cut: list
    left: list
    right: list
    zero: list
    one: list
    gain: list

    def leaf_of(self, x: Column, depth: int) -> Column:
        """Number of the node that a row ends in; JVM-side, one lookup a level."""
        column, left, right = (F.array(*[F.lit(int(v)) for v in of]) for of in (self.column, self.left, self.right))
        cut = F.array(*[F.lit(float(v)) for v in self.cut])

        def step(node: Column, _: Column) -> Column:
            at = F.element_at(column, node + 1)
            value = F.element_at(x, F.greatest(at, F.lit(0)) + 1)
            return (F.when(at < 0, node).when(value <= F.element_at(cut, node + 1), F.element_at(left, node + 1))
                    .otherwise(F.element_at(right, node + 1)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), step)


def best_splits(cells: DataFrame) -> DataFrame:
    """(node, gain, column, cut) of each node from cells (node, column, value, zero, one); one row a node.

    gain is the sum over both sides of (zero^2 + one^2) / (zero + one); the largest has the least gini.
    """
    checkpoint_dir(cells.sparkSession)
    cells = (cells.repartitionByRange("node", "column", "value").withColumn("part", F.spark_partition_id()).checkpoint())
    group = ["node", "column"]
    parts = cells.groupBy(*group, "part").agg(F.sum("zero").alias("p0"), F.sum("one").alias("p1"), F.min("value").alias("least"))
    by_part = Window.partitionBy(*group).orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    parts = parts.select(*group, "part", *[F.coalesce(F.sum(p).over(before), F.lit(0.0)).alias(b) for p, b in
                                           (("p0", "b0"), ("p1", "b1"))],
                         F.sum("p0").over(whole).alias("t0"), F.sum("p1").over(whole).alias("t1"),
                         F.lead("least").over(by_part).alias("after"))
    inside = Window.partitionBy(*group, "part").orderBy("value")
    rows = cells.join(parts, [*group, "part"])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    l0, l1 = F.col("b0") + F.sum("zero").over(upto), F.col("b1") + F.sum("one").over(upto)
    rows = rows.select(*group, "value", F.coalesce(F.lead("value").over(inside), "after").alias("next"), l0.alias("l0"),
                       l1.alias("l1"), "t0", "t1").filter("next IS NOT NULL")
    r0, r1 = F.col("t0") - F.col("l0"), F.col("t1") - F.col("l1")

    def side(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a * a + b * b, a + b), F.lit(0.0))

    gain = side(F.col("l0"), F.col("l1")) + side(r0, r1)
    # half of each, so that large values do not overflow
    one = F.struct((-gain).alias("loss"), F.col("column"), (F.col("value") / 2 + F.col("next") / 2).alias("cut"))
    return rows.groupBy("node").agg(F.min(one).alias("b")).select("node", (-F.col("b.loss")).alias("gain"), "b.column", "b.cut")


def grow_tree(rows: DataFrame, max_depth: int = MAX_DEPTH) -> Tree:
    """A tree on rows (x array<double>, label 0/1, weight)."""
    tree = Tree([], [], [], [], [], [], [])

    def add(zero: float, one: float) -> int:
        for of, value in ((tree.column, -1), (tree.cut, 0.0), (tree.left, 0), (tree.right, 0), (tree.zero, zero),
                          (tree.one, one), (tree.gain, 0.0)):
            of.append(value)
        return len(tree.column) - 1

    zero, one = F.when(F.col("label") == 1, 0.0).otherwise(F.col("weight")), F.when(F.col("label") == 1, F.col("weight")).otherwise(0.0)
    total = rows.agg(F.sum(zero), F.sum(one)).first()
    add(float(total[0] or 0.0), float(total[1] or 0.0))
    open_ = [0]
    for depth in range(max_depth):
        open_ = [n for n in open_ if tree.zero[n] > 0 and tree.one[n] > 0]
        if not open_:
            break
        placed = rows.withColumn("node", tree.leaf_of(F.col("x"), depth)).filter(F.col("node").isin(open_))
        cells = (placed.select("node", zero.alias("zero"), one.alias("one"), F.posexplode("x").alias("column", "value"))
                 .filter(F.col("value").isNotNull() & ~F.isnan("value"))
                 .groupBy("node", "column", "value").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")))
        found = {r["node"]: r for r in best_splits(cells).collect()}  # one row an open node
        if not found:
            break
        for n, r in found.items():
            tree.column[n], tree.cut[n], tree.gain[n] = r["column"], r["cut"], r["gain"]
            tree.left[n], tree.right[n] = add(0.0, 0.0), add(0.0, 0.0)
        fresh = [c for n in found for c in (tree.left[n], tree.right[n])]
        at = rows.withColumn("node", tree.leaf_of(F.col("x"), depth + 1)).filter(F.col("node").isin(fresh))
        for r in at.groupBy("node").agg(F.sum(zero).alias("zero"), F.sum(one).alias("one")).collect():
            tree.zero[r["node"]], tree.one[r["node"]] = float(r["zero"]), float(r["one"])
        open_ = fresh
    return tree


class _TreeParams(HasFeaturesCol, HasLabelCol, HasWeightCol):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels", typeConverter=TypeConverters.toInt)


class ExactTreeModel(Model, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """A grown tree as a persistable stage."""

    columns = Param(Params._dummy(), "columns", "column of each node, -1 for a leaf", typeConverter=TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "cut of each node", typeConverter=TypeConverters.toListFloat)
    lefts = Param(Params._dummy(), "lefts", "left children", typeConverter=TypeConverters.toListInt)
    rights = Param(Params._dummy(), "rights", "right children", typeConverter=TypeConverters.toListInt)
    shares = Param(Params._dummy(), "shares", "share of class 1", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, featuresCol="features", maxDepth=MAX_DEPTH, columns=None, cuts=None, lefts=None, rights=None,
                 shares=None):
        super().__init__()
        self._setDefault(featuresCol="features", maxDepth=MAX_DEPTH, columns=[-1], cuts=[0.0], lefts=[0], rights=[0], shares=[0.0])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        tree = Tree(get("columns"), get("cuts"), get("lefts"), get("rights"), [], [], [])
        leaf = tree.leaf_of(vector_to_array(get("featuresCol")), get("maxDepth"))
        p = F.element_at(F.array(*[F.lit(float(s)) for s in get("shares")]), leaf + 1)
        return (df.withColumn("__share", p).withColumn("probability", array_to_vector(F.array(1 - F.col("__share"), F.col("__share"))))
                .withColumn("prediction", (F.col("__share") > 0.5).cast("double")).drop("__share"))


class ExactTreeClassifier(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Exact gini tree; rows weigh what `weightCol` says, or one."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", weightCol=None, maxDepth=MAX_DEPTH):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", maxDepth=MAX_DEPTH)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ExactTreeModel:
        get = self.getOrDefault
        weight = F.col(get("weightCol")).cast("double") if self.isSet("weightCol") else F.lit(1.0)
        checkpoint_dir(df.sparkSession)
        rows = df.select(vector_to_array(get("featuresCol")).alias("x"), F.col(get("labelCol")).cast("double").alias("label"),
                         weight.alias("weight")).checkpoint()  # read twice a level
        t = grow_tree(rows, get("maxDepth"))
        shares = [b / (a + b) if a + b > 0 else 0.0 for a, b in zip(t.zero, t.one)]
        return ExactTreeModel(featuresCol=get("featuresCol"), maxDepth=get("maxDepth"), columns=t.column, cuts=[float(c) for c in t.cut],
                              lefts=t.left, rights=t.right, shares=shares)
