"""Class rebalancing: SMOTE, Tomek links, class weights.

Neighbours come from ``operators.neighbours`` (exact, without all pairs). All
random choices are md5(seed | ...) so SMOTE builds the same synthetic rows on any
partitioning and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.functions.hashing import hash_hex, uniform
from cohortkit.operators.neighbours import as_double_array, knn
from cohortkit.operators.split import hashed_rank
from cohortkit.session import checkpoint_dir

# Fixed value: neighbours used by SMOTE.
SMOTE_K = 5


def smote_oversample(df: DataFrame, id_col: str, vec_col: str, label_col: str, minority=1,
                     k: int = SMOTE_K, seed: int = 42, target: int | None = None) -> DataFrame:
    """Add synthetic minority rows until the classes are level.

    Synthetic row i (0 <= i < n_major - n_minor) starts from the minority row
    of md5 rank (i mod n_minor) + 1, takes neighbour number
    (md5(seed|nn|i) mod k) + 1 of its k nearest minority rows and interpolates
    x + u * (neighbour - x) with u = uniform(seed|u|i). Synthetic ids are -(i+1).
    """
    counts = {r[0]: int(r[1]) for r in df.groupBy(label_col).count().collect()}  # two classes
    n_min = counts.get(minority, 0)
    n_maj = max([v for c, v in counts.items() if c != minority], default=0)
    n_syn = (target if target is not None else n_maj) - n_min
    if n_syn <= 0:
        return df.select(id_col, vec_col, label_col)
    if n_min <= k:
        raise ValueError(f"SMOTE needs more than k={k} minority rows, got {n_min}")
    mino = as_double_array(df.filter(F.col(label_col) == minority).select(id_col, vec_col), vec_col)
    checkpoint_dir(df.sparkSession)
    mino = mino.checkpoint()
    nn = knn(mino, id_col, vec_col, k).select(F.col("id").alias("base_id"), "nn_id", "nn_rank")
    ranked = hashed_rank(mino.withColumn("__h", hash_hex(seed, F.col(id_col))).withColumn("__g", F.lit(0)),
                         ["__g"], "__h", id_col, n_rows=n_min, n_groups=1, rank_col="__rk")
    base = ranked.select(F.col("__rk").alias("base_rank"), F.col(id_col).alias("base_id"),
                         F.col(vec_col).alias("x"))
    syn = df.sparkSession.range(n_syn).select(F.col("id").alias("i"))
    syn = syn.select("i", (F.pmod(F.col("i"), F.lit(n_min)) + 1).alias("base_rank"),
                     (F.pmod(F.conv(F.substring(hash_hex(seed, F.lit("nn"), F.col("i")), 1, 8), 16, 10)
                             .cast("long"), F.lit(k)) + 1).alias("nn_rank"),
                     uniform(seed, F.lit("u"), F.col("i")).alias("u"))
    nbr = mino.select(F.col(id_col).alias("nn_id"), F.col(vec_col).alias("y"))
    out = (syn.join(base, "base_rank").join(nn, ["base_id", "nn_rank"]).join(nbr, "nn_id")
           .select((-(F.col("i") + 1)).alias(id_col),
                   F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)).alias(vec_col),
                   F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col),
                   "i", "base_id", "nn_id", "u"))
    return out


def smote_resample(df: DataFrame, id_col: str, vec_col: str, label_col: str, minority=1,
                   k: int = SMOTE_K, seed: int = 42) -> DataFrame:
    """Original rows plus SMOTE rows (id, vector, label)."""
    orig = as_double_array(df.select(id_col, vec_col, label_col), vec_col)
    syn = smote_oversample(df, id_col, vec_col, label_col, minority, k, seed)
    return orig.unionByName(syn.select(id_col, vec_col, label_col))


def tomek_links(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Pairs (a, b), a < b, of opposite-class rows that are each other's nearest neighbour."""
    nn = knn(df, id_col, vec_col, 1).select("id", "nn_id")
    lab = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    x = nn.join(lab, "id")
    a, b = x.alias("a"), x.alias("b")
    return (a.join(b, (F.col("a.nn_id") == F.col("b.id")) & (F.col("b.nn_id") == F.col("a.id")))
            .filter((F.col("a.y") != F.col("b.y")) & (F.col("a.id") < F.col("b.id")))
            .select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")))


def remove_tomek_links(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Drop both members of every Tomek link."""
    links = tomek_links(df, id_col, vec_col, label_col)
    members = links.select(F.col("a_id").alias(id_col)).unionByName(links.select(F.col("b_id").alias(id_col)))
    return df.join(members, id_col, "left_anti")


def smote_tomek(df: DataFrame, id_col: str, vec_col: str, label_col: str, minority=1,
                k: int = SMOTE_K, seed: int = 42) -> DataFrame:
    """SMOTE to parity, then remove Tomek links from the resampled set."""
    checkpoint_dir(df.sparkSession)
    res = smote_resample(df, id_col, vec_col, label_col, minority, k, seed).checkpoint()
    return remove_tomek_links(res, id_col, vec_col, label_col)


def class_weight_balanced(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """weight = n / (n_classes * n_class) per row, via a broadcast of the class counts."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__nc"))
    everything = Window.partitionBy()  # over the class-count table: one row per class
    wt = counts.select(label_col, (F.sum("__nc").over(everything)
                                   / (F.count(F.lit(1)).over(everything) * F.col("__nc"))).alias(weight_col))
    # one row per class: a bounded broadcast
    wt = wt.withColumnRenamed(label_col, "__of")
    return df.join(F.broadcast(wt), df[f"`{label_col}`"].eqNullSafe(wt["__of"])).drop("__of")  # NULL is a class
