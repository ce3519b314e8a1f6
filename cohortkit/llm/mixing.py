"""Mixing sources to target weights.

Every document gets a hash-random key; inside each source the documents are
sorted by that key, token counts are summed as distributed prefix sums, and the
source is cut where its budget is met. A budget above the source's size takes
whole epochs first and cuts the remainder.

The prefix sums never put a source into one task: the leading 32 bits of the key
cut each source into ranges of equal share, range totals (a small table) give
each range its offset, and rows are ranked only inside (source, range). n
documents get sqrt(n) ranges, so that neither the ranges of a source nor the
rows of a range are more than about sqrt(n), even if one source holds them all.

Sizes are words; a null or empty text has size 0 and is never taken. A null
source is a source of its own. Rows that repeat an id are separate rows (equal
rows are interchangeable).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import pieces, stage

SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(pieces(text, SPACE)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight, each at most max_epochs times its size.

    Reshared excess ends where target = min(level x weight, cap) for one level.
    Sources in order of cap per weight fill up first, so the level follows from
    two running sums over the table of sources (one row each).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = (sizes.select("source", "source_size", (F.row_number().over(order) - 1).alias("n"))
           .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                       (F.col("n") % len(weights)).cast("int")))
           .withColumn("cap", F.col("source_size") * float(max_epochs)))
    everything = Window.partitionBy()
    fill = (Window.orderBy(F.col("cap") / F.col("weight"), "n")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per = (per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
           .withColumn("full", F.sum("cap").over(fill))
           .withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
           .withColumn("level", (F.col("total") - F.col("full") + F.col("cap")) / F.col("rest")))
    # the level of the first source that does not fill up; none: every source is full
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"),
                         F.struct("full", "n", "level"))).over(everything)["level"]
    return per.withColumn("at", level).select(
        "source", "source_size",
        F.when(F.col("at").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
        seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, size, source_size, target (of its source), taken (words, repeats counted).

    A document is taken whole. The one at the cut joins if the source then ends
    nearer its budget.
    """
    keyed = stage(docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key")),
        "mix-keys")
    n_ranges = max(1, math.ceil(math.sqrt(keyed.count())))
    lead = F.conv(F.substring("key", 1, 8), 16, 10).cast("double")
    keyed = keyed.withColumn("range", F.floor(lead * (n_ranges / 2**32)))  # rises with the key
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, max_epochs)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(F.col("source").alias("_source"), F.col("range").alias("_range"),
                            F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, offsets["_source"].eqNullSafe(targets["source"])).drop("source")
    inside = (Window.partitionBy("source", "range").orderBy("key", "_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = keyed.withColumn("upto", F.sum("size").over(inside))
    rows = ranked.join(offsets, (ranked["range"] == offsets["_range"])
                       & ranked["source"].eqNullSafe(offsets["_source"]))
    # epochs and remainder of the budget, in whole words
    budget = F.round("target").cast("long")
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0))
    rest = budget - F.col("epochs") * F.col("source_size")
    end = F.col("offset") + F.col("upto")
    begin = end - F.col("size")
    extra = (end <= rest) | ((begin < rest) & (end - rest < rest - begin))
    return rows.select(
        F.col("_id").alias(id_col), "size", "source_size", "target",
        (F.col("size") * (F.col("epochs") + F.when(extra, 1).otherwise(0))).cast("long").alias("taken"))
