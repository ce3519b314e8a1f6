"""Exact duplicates by progressive refinement.

Documents are grouped by the length of their normalised text, then by a hash of
its first characters, then by the full hash. Only rows whose group still has
two members go on, and the full hash is taken only of those: the surviving
(length, prefix hash) groups are a small table that a second scan checks rows
against. Texts never move through a shuffle.

Equal: identical after replacing each run of white space by one space. A null
text counts as empty. Rows with the same id are one document for keep_id; each
counts in group_size. A row without id stays only where no equal text has an id;
such rows all stay, as no id tells them apart (a caller who must keep one of them
passes a key of its own as id_col, of any type that has an order). Texts of any
length are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import BROADCAST_ROWS, sized, stage

PREFIX = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _light(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, normalised text, and the two cheap keys."""
    return (docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
            .withColumn("_len", F.length("_text"))
            .withColumn("_prefix", F.xxhash64(F.substring("_text", 1, PREFIX))))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(full_hash, keep_id, group_size) of every group of two or more equal texts, staged."""
    light = _light(docs, id_col, text_col)
    keys = light.groupBy("_len", "_prefix").count()
    # by length first, then by prefix inside the lengths that repeat
    lengths = keys.groupBy("_len").agg(F.sum("count").alias("n")).filter("n > 1")
    pairs = keys.filter("count > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix")
    pairs = stage(pairs, "dedup-survivors")
    survivors = light
    if pairs.count() <= broadcast_rows:
        survivors = light.join(F.broadcast(pairs), ["_len", "_prefix"], "left_semi")
    # else: hashing every row where it lies costs less than moving texts to their groups
    hashed = survivors.select("_id", "_len", "_prefix", F.sha2("_text", 256).alias("full_hash"))
    groups = (hashed.groupBy("full_hash").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
              .filter("group_size > 1"))
    return stage(groups, "dedup-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id (smallest id of the equal texts), group_size, kept, text_sha256."""
    groups = sized(exact_groups(docs, id_col, text_col))
    rows = docs.select(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    out = rows.join(groups.withColumnRenamed("full_hash", "text_sha256"), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return out.select(F.col(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      keep.eqNullSafe(F.col(id_col)).alias("kept"), "text_sha256")
