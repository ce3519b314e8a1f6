"""Exact, partition-independent stratified splits, folds and label encoding.

Randomness is md5(seed | key): the same rows land in the same split whatever
the partitioning, task retries or engine.

Distributed exact rank
----------------------
``row_number() over (partition by label)`` would put a whole class (possibly a
third of the table) into one task. Instead each row's hash picks one of 16^d
buckets; per-(class, bucket) counts are a small table whose prefix sums give
the rank offset of every bucket; the final row_number runs inside
(class, bucket) only, i.e. on ~n / 16^d rows per task. ``d`` grows with the
data so buckets stay around a million rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cohortkit.functions.columns import qcol
from cohortkit.functions.hashing import hash_hex
from cohortkit.session import stage_path

BROADCAST_PREFIX_ROWS = 2_000_000  # bound on the broadcast prefix table


def _digits_for(n_rows: int, target: int = 1_000_000) -> int:
    if n_rows <= 0:
        return 3
    return int(min(5, max(3, math.ceil(math.log(max(n_rows / target, 1.0), 16)) + 3)))


def hashed_rank(df: DataFrame, by: list, hex_col: str, tiebreak: str, n_rows: int | None = None,
                n_groups: int | None = None, rank_col: str = "rank") -> DataFrame:
    """1-based rank of each row by ``hex_col`` (a hex string) within ``by`` groups.

    Exact and equal to row_number() over (partition by ``by`` order by hex, tiebreak).
    """
    n_rows = n_rows if n_rows is not None else df.count()
    d = _digits_for(n_rows)
    b = F.conv(F.substring(F.col(hex_col), 1, d), 16, 10).cast("long")
    dfb = df.withColumn("__bucket", b)
    counts = dfb.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = counts.withColumn("__before", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).drop("__cnt")
    groups = n_groups if n_groups is not None else 1
    prefix = prefix.select(*[F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)],
                           F.col("__bucket").alias("__of"), "__before")
    if n_groups is not None and groups * 16 ** d <= BROADCAST_PREFIX_ROWS:
        prefix = F.broadcast(prefix)
    # null-safe: a NULL group is a group like any other
    on = dfb["__bucket"] == prefix["__of"]
    for i, c in enumerate(by):
        on = on & dfb[f"`{c}`"].eqNullSafe(prefix[f"__by{i}"])
    joined = dfb.join(prefix, on).drop("__of", *[f"__by{i}" for i in range(len(by))])
    inner = Window.partitionBy(*by, "__bucket").orderBy(hex_col, tiebreak)
    return (joined.withColumn(rank_col, F.col("__before") + F.row_number().over(inner))
            .drop("__bucket", "__before"))


def _largest_remainder(counts: dict, total_take: int) -> dict:
    """Per-class shares of ``total_take`` proportional to class counts: floors
    first, remaining units to the largest remainders (ties: class order)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (v * total_take) // n for k, v in counts.items()}
    rem = sorted(counts, key=lambda k: (-((counts[k] * total_take) % n), str(k)))
    left = total_take - sum(base.values())
    for k in rem[:left]:
        base[k] += 1
    return base


def _per_class(values: dict, label: str) -> Column:
    """values[label] as a column; a NULL label is a class of its own."""
    known = [x for c, v in values.items() if c is not None for x in (F.lit(c), F.lit(v))]
    of = F.create_map(*known)[qcol(label)] if known else F.lit(None)
    return F.when(qcol(label).isNull(), F.lit(values.get(None, 0))).otherwise(F.coalesce(of, F.lit(0))).cast("long")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class (a label-cardinality sized dict)."""
    return {r[0]: int(r[1]) for r in df.groupBy(qcol(label)).count().collect()}


def split_sizes(counts: dict, test_size: float = 1 / 3) -> tuple[dict, dict]:
    """(train counts, test counts) per class for an exact stratified split."""
    n = sum(counts.values())
    n_test = int(math.ceil(n * test_size))
    train = _largest_remainder(counts, n - n_test)
    return train, {c: counts[c] - train[c] for c in counts}


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 1 / 3, seed: int = 42,
                     split_col: str = "split", counts: dict | None = None) -> DataFrame:
    """Label-stratified train/test split with exact sizes.

    test = ceil(n * test_size); per-class train counts by largest remainder;
    within a class the lowest md5(seed|key) rows go to test. ``counts``: class
    counts when already known (saves a job).
    """
    counts = counts if counts is not None else class_counts(df, label)
    n = sum(counts.values())
    _, k_test = split_sizes(counts, test_size)
    hexed = df.withColumn("__h", hash_hex(seed, qcol(key)))
    ranked = hashed_rank(hexed, [label], "__h", key, n_rows=n, n_groups=len(counts), rank_col="__rk")
    is_test = F.col("__rk") <= _per_class(k_test, label)
    return ranked.withColumn(split_col, F.when(is_test, "test").otherwise("train")).drop("__h", "__rk")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int = 10, seed: int = 42,
                     fold_col: str = "fold", counts: dict | None = None) -> DataFrame:
    """k folds, balanced by class and size.

    Class c occupies positions [offset_c, offset_c + n_c) of the label-sorted
    order and position i belongs to fold i mod k; members of a class are
    shuffled by md5(seed|fold|key) before taking their positions. ``counts``:
    class counts of ``df`` when already known (saves a job).
    """
    counts = counts if counts is not None else class_counts(df, label)
    classes = sorted(counts, key=lambda c: (c is None, c))  # NULL labels last
    offset, acc = {}, 0
    for c in classes:
        offset[c] = acc
        acc += counts[c]
    hexed = df.withColumn("__h", hash_hex(seed, F.lit("fold"), qcol(key)))
    ranked = hashed_rank(hexed, [label], "__h", key, n_rows=acc, n_groups=len(classes), rank_col="__rk")
    return (ranked.withColumn(fold_col, F.pmod(_per_class(offset, label) + F.col("__rk") - 1, F.lit(k)).cast("int"))
            .drop("__h", "__rk"))


def separate_target(df: DataFrame, label: str):
    """(features, target) projections of one table."""
    return df.drop(label), df.select(label)


def union_distinct_labels(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Distinct labels over both splits."""
    return train.select(qcol(label).alias("label")).unionByName(test.select(qcol(label).alias("label"))).distinct()


def label_encoder(train: DataFrame, test: DataFrame, label: str, output: str = "label_code"):
    """Fit a sorted-label index (N=0, Y=1 for the sheet) on train U test labels."""
    both = union_distinct_labels(train, test, label).withColumnRenamed("label", label)
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(both)


def label_map(model) -> DataFrame:
    """(label, code) table of a fitted label encoder."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(model.labels)], "label string, code int")


def label_encode(df: DataFrame, model, output: str = "label_code") -> DataFrame:
    return model.transform(df).withColumn(output, F.col(output).cast("int"))


def temporal_split(df: DataFrame, ts: str, test_size: float = 1 / 3, split_col: str = "split") -> DataFrame:
    """Strict time split: the latest ``test_size`` share of rows is test.

    The cut is the exact order statistic of ``ts`` (two scans, no global
    sort): rows strictly before the cut are train, the rest test, so
    ties at the cut all go to test. Sizes count rows with a time; rows without
    one are train (nothing says that they are late). NaN is later than all else.
    """
    cut = order_statistic(df, ts, 1 - test_size, lambda n: n - int(math.ceil(n * test_size)) + 1)
    if cut is None:  # no row has a time, or no row is asked for
        return df.withColumn(split_col, F.lit("train"))
    return df.withColumn(split_col, F.when(_orderable(df, ts) >= F.lit(cut), "test").otherwise("train"))


def order_statistic(df: DataFrame, col: str, share: float, position, accuracy: int = 100_000):
    """Exact ``position(n)``-th smallest of the n non-null values, in two scans whatever their spread.

    The first scan counts the rows and brackets the position, which lies near ``share`` of
    them, by a quantile sketch. The second counts the rows below the bracket and
    groups those inside by value, some 4 / ``accuracy`` of all rows. The value is then
    found in that small table. Sketches round longs to doubles and may be off: a bracket that the
    counts refute is opened on that side and counted again, so the sketch never decides.
    """
    cur = df.select(_orderable(df, col).alias("__x")).filter(F.col("__x").isNotNull())
    whole = isinstance(cur.schema["__x"].dataType, IntegralType)
    ends = [max(0.0, share - 2 / accuracy), min(1.0, share + 2 / accuracy)]
    n, ends = cur.agg(F.count(F.lit(1)), F.percentile_approx(F.col("__x").cast("double"), ends, accuracy)).first()
    k = position(n)
    if k < 1 or k > n:
        return None
    low, high = ends
    if whole:  # room for the rounding to doubles
        low, high = (int(end) + way * (int(math.ulp(end)) + 1) for end, way in zip(ends, (-1, 1)))
        low, high = max(low, -2 ** 63), min(high, 2 ** 63 - 1)
    while True:
        inside = cur if high is None else cur.filter(F.col("__x") <= F.lit(high))
        value = F.col("__x") if low is None else F.when(F.col("__x") >= F.lit(low), F.col("__x"))
        path = stage_path(df.sparkSession, "order-statistic", uuid.uuid4().hex)
        inside.groupBy(value.alias("__x")).agg(F.count(F.lit(1)).alias("__n")).write.parquet(path)
        held = df.sparkSession.read.parquet(path)
        below, kept = held.agg(F.sum(F.when(F.col("__x").isNull(), F.col("__n"))),
                               F.sum(F.when(F.col("__x").isNotNull(), F.col("__n")))).first()
        below, kept = below or 0, kept or 0
        if below < k <= below + kept:
            return _kth_weighted(held.filter(F.col("__x").isNotNull()), k - below)
        low, high = (None, high) if k <= below else (low, None)


def _orderable(df: DataFrame, col: str) -> Column:
    """Numeric image of a column that preserves order: integers and timestamps (micros) as longs, the rest as doubles.

    Wall-clock timestamps (NTZ) are rebuilt as UTC instants from their fields,
    so the session time zone (and its DST gaps) cannot reorder them.
    """
    dt = df.schema[col].dataType.typeName()
    c = qcol(col)
    if dt == "timestamp_ntz":
        utc = F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                               F.date_part(F.lit("SECOND"), c), F.lit("UTC"))
        return F.unix_micros(utc)
    if dt == "timestamp":
        return F.unix_micros(c)
    return c.cast("long") if isinstance(df.schema[col].dataType, IntegralType) else c.cast("double")


def kth_smallest(df: DataFrame, col: str, k: int, bins: int = 4096, small: int = 10_000):
    """Exact k-th smallest non-null value (1-based) by histogram refinement; see ``_kth_weighted``."""
    x = _orderable(df, col)
    return _kth_weighted(df.select(x.alias("__x"), F.lit(1).alias("__n")).filter(F.col("__x").isNotNull()), k, bins, small)


def _kth_weighted(cur: DataFrame, k: int, bins: int = 4096, small: int = 10_000):
    """The value at position k of (__x, __n), each value standing there __n times.

    Each round is one aggregate of ``bins`` counters; only the bin holding the
    k-th value is refined, until it holds a single value or few rows, which are
    then ranked. Nothing but counts and one small bin reach the driver. Longs are
    cut by whole numbers, so that values beyond 2^53 keep their order. Infinities and
    NaN (later than all else) are counted by themselves.
    """
    if not isinstance(cur.schema["__x"].dataType, IntegralType):
        odd = [F.when(F.col("__x") == F.lit(float(name)), name) for name in ("-inf", "inf", "nan")]
        kind = F.coalesce(*odd, F.lit("finite"))
        total = {r["kind"]: r["n"] for r in cur.groupBy(kind.alias("kind")).agg(F.sum("__n").alias("n")).collect()}
        for name in ("-inf", "finite", "inf", "nan"):
            if 1 <= k <= total.get(name, 0):
                if name != "finite":
                    return float(name)
                break
            k -= total.get(name, 0)
        cur = cur.filter(kind == "finite")
    lo, hi, rows, total = cur.agg(F.min("__x"), F.max("__x"), F.count(F.lit(1)), F.sum("__n")).first()
    if not rows or k < 1 or k > total:
        return None
    while True:
        here = cur.filter((F.col("__x") >= F.lit(lo)) & (F.col("__x") <= F.lit(hi)))
        if lo == hi:
            return lo
        if rows <= small:
            for x, n in sorted(here.select("__x", "__n").collect()):  # at most `small` rows
                k -= n
                if k <= 0:
                    return x
        if isinstance(lo, int):
            width = (hi - lo) // bins + 1
            b = F.expr(f"(CAST(__x AS DECIMAL(20,0)) - ({lo})) DIV CAST({width} AS DECIMAL(20,0))").cast("int")
        else:
            half = 0.5 if math.isinf(hi - lo) else 1.0  # the spread of doubles can exceed the largest double
            width = (hi * half - lo * half) / bins or math.ulp(0.0)
            b = F.least(F.floor((F.col("__x") * half - lo * half) / width), F.lit(bins - 1)).cast("int")
        hist = sorted(here.groupBy(b.alias("b")).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("rows"),
                                                     F.min("__x").alias("lo"), F.max("__x").alias("hi")).collect())
        for row in hist:
            if row["n"] >= k:
                # keep by the expression that counted; bin edges recomputed from it may round otherwise
                lo, hi, rows, cur = row["lo"], row["hi"], row["rows"], here.filter(b == row["b"])
                break
            k -= row["n"]


def split_and_folds(df: DataFrame, label: str, key: str, test_size: float = 1 / 3, k: int = 10, seed: int = 42,
                    split_col: str = "split", fold_col: str = "fold", counts: dict | None = None) -> DataFrame:
    """Stratified split and stratified k folds of the training rows from ONE
    distributed rank (one shuffle of the table instead of two).

    Within a class, md5(seed|key) ranks 1..k_test are test (fold -1); the
    training members keep their md5 order, which is a uniform random
    permutation, and take fold (offset_c + rank - k_test - 1) mod k, so the
    split sizes and the per-class / per-fold sizes equal those of
    ``stratified_split`` followed by ``stratified_kfold``.
    """
    counts = counts if counts is not None else class_counts(df, label)
    train_n, test_n = split_sizes(counts, test_size)
    classes = sorted(counts, key=lambda c: (c is None, c))  # NULL labels last
    offset, acc = {}, 0
    for c in classes:
        offset[c] = acc
        acc += train_n[c]
    hexed = df.withColumn("__h", hash_hex(seed, qcol(key)))
    ranked = hashed_rank(hexed, [label], "__h", key, n_rows=sum(counts.values()), n_groups=len(counts),
                         rank_col="__rk")
    kt = _per_class(test_n, label)
    is_test = F.col("__rk") <= kt
    return ranked.select(
        *[c for c in ranked.columns if c not in ("__h", "__rk")],
        F.when(is_test, "test").otherwise("train").alias(split_col),
        F.when(is_test, F.lit(-1)).otherwise(
            F.pmod(_per_class(offset, label) + F.col("__rk") - kt - 1, F.lit(k))).cast("int").alias(fold_col))
