"""Sources and sinks: raw sheets, stage tables, labels, result tables.

Stage hand-off is Parquet keyed by a stable row id (the reference aligns
``.npy`` matrices by position), partitioned by split so that a reader of the
training rows prunes the test partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from cohortkit.operators.clean import read_na_tokens
from cohortkit.session import stage_path


def read_sheet(spark: SparkSession, path: str, columns=None, fmt: str = "csv", header: bool = True,
               tokens=None, multi_line: bool = True) -> DataFrame:
    """Read a raw sheet with every column as a string and map missing tokens to NULL.

    Excel workbooks are re-aimed as CSV/Parquet exports (no Excel source in
    the environment). ``columns`` fixes the schema so no inference pass runs.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", header).option("mode", "PERMISSIVE")
        # keep empty fields as empty strings so the token rule decides (like the sheet reader)
        reader = reader.option("nullValue", "\u0000").option("emptyValue", "")
        # a quoted cell may hold line breaks; such files cannot be split, so many
        # files (or multi_line=False for sheets without line breaks) give the parallelism
        reader = reader.option("multiLine", multi_line).option("escape", '"')
        if columns is not None:
            reader = reader.schema(StructType([StructField(c, StringType(), True) for c in columns]))
        df = reader.csv(path)
    else:
        df = reader.format(fmt).load(path)
        df = df.select(*[df[c].cast("string").alias(c) for c in df.columns])
    return read_na_tokens(df, tokens)


def write_feature_table(df: DataFrame, path: str, key: str = "row_id", split_col: str = "split") -> None:
    """Write a feature table partitioned by split, rows clustered by key."""
    out = df.repartition(split_col, key).sortWithinPartitions(key) if split_col in df.columns else df
    writer = out.write.mode("overwrite")
    if split_col in df.columns:
        writer = writer.partitionBy(split_col)
    writer.parquet(path)


def read_feature_table(spark: SparkSession, path: str, required=()) -> DataFrame:
    """Read a stage table; a missing table or column fails with a clear message."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(f"stage table missing: {path}") from e
        raise
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise FileNotFoundError(f"stage table {path} lacks columns {missing}")
    return df


def bucket_count(rows: int, rows_a_bucket: int = 1_000_000) -> int:
    """Buckets of the blocks of a study of so many rows; lower ``rows_a_bucket`` for wide vectors."""
    return max(1, -(-rows // rows_a_bucket))


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Write a feature block as a table bucketed and sorted by key, one file a bucket.

    Blocks of one study take the same number of buckets: joins of them on the key
    then read bucket against bucket, without a shuffle, as often as they are joined.
    The files lie below the shared stage folder, the catalog keeps the name and the buckets. A bucket is
    read by one task, so choose ``buckets`` by the widest block (see ``bucket_count``). A key
    that many rows share lands in one bucket: blocks hold one row a key.
    """
    path = stage_path(df.sparkSession, "blocks", f"{table}-{uuid.uuid4().hex}")
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def read_bucketed(spark: SparkSession, table: str, required=()) -> DataFrame:
    """Read a bucketed block; a missing table or column fails with a clear message."""
    if not spark.catalog.tableExists(table):
        raise FileNotFoundError(f"feature block missing: {table}")
    df = spark.table(table)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise FileNotFoundError(f"feature block {table} lacks columns {missing}")
    return df


def write_labels(labels: DataFrame, encoder, path: str) -> None:
    """Encoded labels (Parquet) plus the fitted label encoder (ML persistence)."""
    labels.write.mode("overwrite").parquet(f"{path}/labels")
    encoder.write().overwrite().save(f"{path}/encoder")


def write_result_tables(tables: dict, out_dir: str, fmt: str = "parquet") -> None:
    """One table per logical sheet (cv_results, test_results, best_model, ...)."""
    for name, df in tables.items():
        if isinstance(df, DataFrame):
            df.write.mode("overwrite").format(fmt).save(f"{out_dir}/{name}")


def write_csv_report(small: DataFrame, path: str) -> None:
    """A small result table as one CSV file with header (only for report-sized tables)."""
    small.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
