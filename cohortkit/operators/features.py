"""Numeric feature preparation: null-safe z-score, exact median imputation,
missing-value checks, feature-set selection and assembly.

Fitted state is tiny (two numbers per column), so a fitted scaler or imputer
is a ``SQLTransformer`` whose statement carries the constants: it runs
JVM-side inside whole-stage codegen and persists with the standard ML writer,
so it can sit in a ``PipelineModel`` next to the classifiers.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cohortkit.functions.columns import qcol
from cohortkit.session import checkpoint_dir


def _bq(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _num(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def fit_zscore(train: DataFrame, columns) -> SQLTransformer:
    """Fit (x - mean) / std on ``train``: population std, NULLs ignored and
    preserved, zero or undefined variance -> scale 1 (as the reference scaler)."""
    columns = list(columns)
    row = train.agg(*[F.avg(qcol(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
                    *[F.stddev_pop(qcol(c).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    exprs = []
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None:
            exprs.append(f"CAST(NULL AS DOUBLE) AS {_bq(c)}")
            continue
        scale = s if (s is not None and s > 0) else 1.0
        exprs.append(f"(CAST({_bq(c)} AS DOUBLE) - {_num(m)}) / {_num(scale)} AS {_bq(c)}")
    excl = ", ".join(_bq(c) for c in columns)
    return SQLTransformer(statement=f"SELECT * EXCEPT ({excl}), {', '.join(exprs)} FROM __THIS__")


# Above this many distinct values (estimated) the quantiles of a column are read
# off a range-sorted table of its values; below, one aggregate merges a counter
# per value. Both are exact and give the same numbers.
SORTED_QUANTILES_FROM = 1_000_000


def sorted_quantiles(df: DataFrame, columns, probs) -> dict:
    """{column: exact quantiles, interpolated between neighbours; None without a value}.

    (column, value) counts, combined before the shuffle, are range-sorted;
    prefix sums of the partitions' totals tell which partition holds a wanted
    position, and only those partitions are ranked. No task holds all values.
    """
    columns = list(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("col"), qcol(c).cast("double").alias("value"))
                      for i, c in enumerate(columns)])
    counts = (df.select(F.inline(pairs)).filter("value IS NOT NULL")
              .groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")))
    checkpoint_dir(df.sparkSession)
    counts = counts.repartitionByRange("col", "value").withColumn("part", F.spark_partition_id()).checkpoint()
    # one row per (column, partition)
    parts = counts.groupBy("col", "part").agg(F.sum("n").alias("held"))
    parts = parts.select("col", "part", "held", F.sum("held").over(Window.partitionBy("col")).alias("total"),
                         (F.sum("held").over(Window.partitionBy("col").orderBy("part")) - F.col("held")).alias("before"))
    place = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    places = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    parts = parts.withColumn("places", F.filter(places, lambda k: (k >= F.col("before"))
                                                & (k < F.col("before") + F.col("held")))).filter(F.size("places") > 0)
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("col", "part").orderBy("value"))
    ranked = counts.join(parts, ["col", "part"]).withColumn("upto", upto)
    hits = F.filter("places", lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))
    found = ranked.select("col", "total", "value", F.explode(hits).alias("at")).collect()  # two rows a quantile at most
    value = {(r["col"], r["at"]): r["value"] for r in found}
    total = {r["col"]: r["total"] for r in found}

    def quantile(i: int, p: float) -> float:
        x = (total[i] - 1) * p
        lo, hi = math.floor(x), math.ceil(x)
        a, b = value[i, lo], value[i, hi]
        return a if a == b else (hi - x) * a + (x - lo) * b

    return {c: [quantile(i, p) for p in probs] if i in total else None for i, c in enumerate(columns)}


def wide_columns(df: DataFrame, columns, limit: int = SORTED_QUANTILES_FROM) -> set:
    """Columns whose distinct count (HyperLogLog estimate, one job) exceeds ``limit``."""
    columns = list(columns)
    if not columns:
        return set()
    row = df.agg(*[F.approx_count_distinct(qcol(c), 0.05).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if row[f"d{i}"] > limit}


def exact_quantiles(df: DataFrame, columns, probs, wide=None) -> dict:
    """{column: exact interpolated quantiles, None without a value}.

    ``wide``: the columns to take from a range-sorted table; None asks
    ``wide_columns``. It changes the plan, never the result.
    """
    columns = list(columns)
    wide = wide_columns(df, columns) if wide is None else set(wide)
    narrow = [c for c in columns if c not in wide]
    out = sorted_quantiles(df, [c for c in columns if c in wide], probs) if len(narrow) < len(columns) else {}
    if narrow:
        ps = F.array(*[F.lit(float(p)) for p in probs])
        out |= dict(zip(narrow, df.agg(*[F.percentile(qcol(c).cast("double"), ps).alias(f"q{i}")
                                         for i, c in enumerate(narrow)]).first()))
    return out


def fit_median_imputer(train: DataFrame, columns, wide=None):
    """Fill NULLs with the training median (exact, interpolated between the two
    middle values); a column with no training value is dropped. Returns
    (transformer, kept columns). ``wide``: see ``exact_quantiles``.
    """
    columns = list(columns)
    medians = exact_quantiles(train, columns, [0.5], wide)
    keep, exprs = [], []
    for c in columns:
        if medians[c] is None:
            continue
        med = medians[c][0]
        keep.append(c)
        exprs.append(f"coalesce(CAST({_bq(c)} AS DOUBLE), {_num(med)}) AS {_bq(c)}")
    excl = ", ".join(_bq(c) for c in columns)
    sel = ", ".join(exprs) if exprs else ""
    stmt = f"SELECT * EXCEPT ({excl}){', ' + sel if sel else ''} FROM __THIS__"
    return SQLTransformer(statement=stmt), keep


def has_missing(df: DataFrame, columns) -> bool:
    """True when any listed column (scalar, or array element) holds a NULL."""
    checks = []
    for c in columns:
        dt = df.schema[c].dataType
        if isinstance(dt, ArrayType):
            checks.append(F.max(F.exists(qcol(c), lambda x: x.isNull()).cast("int")))
        else:
            checks.append(F.max(qcol(c).isNull().cast("int")))
    row = df.agg(F.greatest(*checks, F.lit(0)).alias("m")).first() if checks else None
    return bool(row and row["m"])


# The seven feature sets of the ablation study, in run order.
# a-x = structured columns, y = chief text, z = diagnosis text.
FEATURE_SETS = {
    "a-x": ("structured",),
    "y": ("chief",),
    "z": ("diagnosis",),
    "y-z": ("chief", "diagnosis"),
    "a-y": ("structured", "chief"),
    "a-x,z": ("structured", "diagnosis"),
    "a-z": ("structured", "chief", "diagnosis"),
}
TEXT_ONLY_SETS = ("y", "z", "y-z")
STRUCTURED_SETS = ("a-x", "a-y", "a-x,z", "a-z")


def feature_set_parts(name: str) -> tuple:
    """The blocks a feature set concatenates; unknown names are an error."""
    if name not in FEATURE_SETS:
        raise ValueError(f"unsupported feature set: {name!r}")
    return FEATURE_SETS[name]


def feature_set_columns(name: str, structured_cols, text_cols: dict) -> list:
    """Input columns for VectorAssembler, in block order."""
    cols = []
    for part in feature_set_parts(name):
        if part == "structured":
            cols += list(structured_cols)
        else:
            cols.append(text_cols[part])
    return cols


def assembler(input_cols, output: str = "features") -> VectorAssembler:
    """Column-wise concatenation of scalar and vector columns."""
    return VectorAssembler(inputCols=list(input_cols), outputCol=output, handleInvalid="error")


def assemble_features(blocks: dict, key: str, output: str = "features", input_order=None) -> DataFrame:
    """Join feature blocks stored as separate tables on ``key`` and assemble them.

    The reference aligns matrices by position; here every block carries the
    stable key and blocks meet in one equi-join; blocks written by
    ``sources.write_bucketed`` meet without a shuffle.
    """
    names = list(blocks)
    df = blocks[names[0]]
    for n in names[1:]:
        df = df.join(blocks[n], key)
    cols = input_order or [c for n in names for c in blocks[n].columns if c != key]
    return assembler(cols, output).transform(df)
