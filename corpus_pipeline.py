"""Corpus pipeline: quality, exact duplicates, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and returns a DataFrame; `run` writes each as Parquet below the shared
checkpoint folder and reads it back as the next one's documents. All stages but
the last return the columns of documents. Every stage decides row by row: where
an id repeats or is missing, rows get a number of their own for the stage, so that
no text is kept or dropped for another's sake.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm.common import read, sized, stage
from cohortkit.llm.decontaminate import decontaminate
from cohortkit.llm.exact_dedup import exact_dedup
from cohortkit.llm.mixing import mix
from cohortkit.llm.near_dedup import near_duplicates
from cohortkit.llm.quality import fit_cotraining, score_quality


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, a column that names each row): the id, or, where ids repeat or are missing, a written row number."""
    clashes = stage(docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "id-clashes")
    if clashes.isEmpty():
        return docs, "doc_id"
    key = "_row"
    while key in docs.columns:
        key += "_"
    # written, so that every later read sees the same numbers
    return stage(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def _without(docs: DataFrame, key: str, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """docs without the given rows; texts are shuffled only if the keys exceed the broadcast bound."""
    gone = stage(rows.select(F.col(key).alias("_gone")), name)
    return docs.join(sized(gone), docs[key] == gone["_gone"], "left_anti").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier (9) rejects go."""
    model = fit_cotraining(docs, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).filter("_quality.good").drop("_quality")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (8), the row with the smallest id stays; without ids, one of them."""
    keyed, key = _keyed(docs)
    if key == "doc_id":
        dropped = exact_dedup(keyed).filter(~F.col("kept"))
    else:  # the smallest id first, then the row number
        order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col(key).alias("row"))
        dropped = exact_dedup(keyed.select(order.alias("at"), "text"), id_col="at").filter(~F.col("kept"))
        dropped = dropped.select(F.col("at.row").alias(key))
    return _without(keyed, key, dropped, docs.columns, "exact-dropped")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (10) stays: five-word shingles, similarity 0.8."""
    keyed, key = _keyed(docs)
    dropped = near_duplicates(keyed, k=5, id_col=key).filter(~F.col("kept"))
    return _without(keyed, key, dropped, docs.columns, "near-dropped")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage (6) go."""
    keyed, key = _keyed(docs)
    found = decontaminate(keyed, read(spark, sf_dir, "benchmark"), id_col=key).filter("contaminated")
    return _without(keyed, key, found, docs.columns, "contaminated")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix (7) takes of every document that is left."""
    return mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix", mix_stage),
]

#: A fitted classifier and MinHash candidates have no SQL twin; tests/llm holds the kept rows of the last four stages
#: and of `run` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
