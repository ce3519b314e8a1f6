"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.session import checkpoint_dir

#: A join side is broadcast only when its counted rows stay within this bound.
BROADCAST_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table below the shared checkpoint folder and read it back.

    Cuts lineage in a form that every executor can read again after a loss, and
    gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cohortkit-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged join side for broadcast if its counted rows are within limit.

    Beyond the limit the side stays as it is: a sort-merge join whose skewed
    partitions adaptive execution can split (both sides are plain exchanges).
    """
    return F.broadcast(df) if df.count() <= limit else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def pieces(text: Column, separator: str) -> Column:
    """The non-empty texts between separators; a null has none.

    One pass: extracting all matches of the opposite pattern copies the rest of
    the text for every match.
    """
    return F.coalesce(F.array_remove(F.split(text, separator, -1), ""), F.array().cast("array<string>"))


def occurrences(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,end,value>>.

    Positions are code points, end exclusive. The pieces between matches and the
    matches themselves come from the same Java matcher, so their lengths add up
    to the positions. The second pass runs only on texts that have a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.split(text, pattern, -1), found,
                       lambda p, m: F.struct(p.alias("piece"), m.alias("value")))
    # the last piece follows the last match
    pairs = F.slice(pairs, F.lit(1), F.size(found))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(empty)


def sha256_of(parts: Column) -> Column:
    """Lowercase hex of the comma-joined strings."""
    return F.sha2(F.array_join(parts, ","), 256)
