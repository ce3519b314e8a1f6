from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortkit.functions.hashing import hash_hex
from cohortkit.operators import split as S


def _cohort(spark, n_y=318, n_n=1568):
    rows = [(i, "Y") for i in range(n_y)] + [(n_y + i, "N") for i in range(n_n)]
    return spark.createDataFrame(rows, "row_id long, y string")


def test_split_golden_sizes(spark):
    out = S.stratified_split(_cohort(spark), "y", "row_id").groupBy("split", "y").count().collect()
    c = {(r.split, r.y): r["count"] for r in out}
    assert c == {("test", "N"): 523, ("test", "Y"): 106, ("train", "N"): 1045, ("train", "Y"): 212}


def test_kfold_golden_sizes(spark):
    rows = [(i, "Y") for i in range(212)] + [(1000 + i, "N") for i in range(1045)]
    df = spark.createDataFrame(rows, "row_id long, y string")
    folds = S.stratified_kfold(df, "y", "row_id", 10).collect()
    size = Counter(r.fold for r in folds)
    assert sorted(size.values()) == [125] * 3 + [126] * 7
    ny = Counter(r.fold for r in folds if r.y == "Y")
    nn = Counter(r.fold for r in folds if r.y == "N")
    assert sorted(ny.values()) == [21] * 8 + [22] * 2
    assert sorted(nn.values()) == [104] * 5 + [105] * 5


def test_partition_independence(spark):
    df = _cohort(spark, 50, 200)
    a = {r.row_id: r.split for r in S.stratified_split(df.repartition(1), "y", "row_id").collect()}
    b = {r.row_id: r.split for r in S.stratified_split(df.repartition(7), "y", "row_id").collect()}
    assert a == b


def test_hashed_rank_equals_row_number(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("g")).withColumn("h", hash_hex(7, F.col("id")))
    ranked = S.hashed_rank(df, ["g"], "h", "id")
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    assert ranked.select("id", "rank").exceptAll(ref.select("id", "rank")).count() == 0


def test_label_encoder_sorted(spark):
    df = spark.createDataFrame([("Y",), ("N",)], "y string")
    model = S.label_encoder(df, df, "y")
    assert list(model.labels) == ["N", "Y"]


def test_kth_smallest_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 3, 9, 7, 2]], "x double")
    assert [S.kth_smallest(df, "x", k, bins=2, small=2) for k in range(1, 8)] == [1, 2, 3, 3, 5, 7, 9]


def test_kth_smallest_of_longs_beyond_double(spark):
    values = [2**62 + i for i in range(9)] + [-2**63, 2**63 - 1, 0, None]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    want = sorted(v for v in values if v is not None)
    assert [S.kth_smallest(df, "x", k, bins=3, small=1) for k in range(1, 13)] == want
    split = S.temporal_split(df, "x", 0.25).filter("split = 'test'").collect()
    assert sorted(r.x for r in split) == want[-3:]


def test_temporal_split_ntz_independent_of_session_zone(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 3, 10, 1, 30) + dt.timedelta(minutes=20 * i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = {}
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            out[tz] = {r.id: r.split for r in S.temporal_split(df, "ts", 1 / 3).collect()}
        assert out["UTC"] == out["America/New_York"]
        assert [out["UTC"][i] for i in range(9)] == ["train"] * 6 + ["test"] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_split_and_folds_sizes_match_separate_ops(spark):
    df = _cohort(spark, 318, 1568)
    out = S.split_and_folds(df, "y", "row_id", 1 / 3, 10).collect()
    by = Counter((r.split, r.y) for r in out)
    assert by == {("test", "N"): 523, ("test", "Y"): 106, ("train", "N"): 1045, ("train", "Y"): 212}
    assert all(r.fold == -1 for r in out if r.split == "test")
    size = Counter(r.fold for r in out if r.split == "train")
    assert sorted(size.values()) == [125] * 3 + [126] * 7
    ny = Counter(r.fold for r in out if r.split == "train" and r.y == "Y")
    assert sorted(ny.values()) == [21] * 8 + [22] * 2
    # partition independent
    again = {r.row_id: (r.split, r.fold) for r in S.split_and_folds(df.repartition(5), "y", "row_id").collect()}
    assert again == {r.row_id: (r.split, r.fold) for r in out}
