import uuid

import pytest
from pyspark.ml.functions import vector_to_array

from cohortkit.operators import features as FE
from cohortkit.sources import read_bucketed, write_bucketed


def test_bucketed_blocks_meet_without_a_shuffle(spark):
    n, run = 500, uuid.uuid4().hex[:8]
    tables = {"a": spark.range(n).selectExpr("id as row_id", "id * 0.5D as x"),
              "b": spark.range(n).selectExpr("id as row_id", "id * 2.0D as y", "-id * 1.0D as z"),
              "c": spark.range(n).selectExpr("id as row_id", "id % 7 * 1.0D as w")}
    blocks = {}
    for name, df in tables.items():
        write_bucketed(df.repartition(5), f"t_{name}_{run}", "row_id", 6)
        blocks[name] = read_bucketed(spark, f"t_{name}_{run}", ["row_id"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = FE.assemble_features(blocks, "row_id")
        rows = {r.row_id: r.f for r in out.select("row_id", vector_to_array("features").alias("f")).collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        shuffled = FE.assemble_features(tables, "row_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") >= 2 and "Exchange" not in plan
    assert "Exchange" in shuffled
    assert rows == {i: [i * 0.5, i * 2.0, -1.0 * i, float(i % 7)] for i in range(n)}


def test_missing_block_or_column(spark):
    with pytest.raises(FileNotFoundError):
        read_bucketed(spark, "no_such_block")
    name = f"t_{uuid.uuid4().hex[:8]}"
    write_bucketed(spark.range(3).selectExpr("id as row_id"), name, "row_id", 2)
    with pytest.raises(FileNotFoundError):
        read_bucketed(spark, name, ["row_id", "x"])
