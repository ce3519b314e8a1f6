"""URL filters by a sort-merge range join.

A host's canonical key is its labels in reverse order with a dot after each
(`www.example.net` -> `net.example.www.`). All hosts below a rule's host then
share the rule's key as a prefix: the rule is an interval of keys, and rule
intervals nest or are disjoint. Rules and urls are sorted together inside key
ranges; a sweep carries, for each depth, the last rule host passed. Those are
the stack of active nested rules; the ones whose interval still holds the key
are the rules that fit, and the deepest with a fitting path wins (then the
longest path, then block before allow).

Key ranges are cut at quantiles of a bounded sample of keys, and a range with
many urls (one hot host may hold a third of all rows) is split further by a
salt; the few rules that reach into a range are copied to each of its parts.
Cut points and salts decide only where rows are swept, never the result.

A null url or one without `://` has an empty host and path. A rule with a null
or empty host fits nothing. Urls without a rule get the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import ascii_lower

#: Keys looked at to cut ranges, and the most ranges cut.
SAMPLE_KEYS = 4096
MAX_RANGES = 128
ROWS_PER_PART = 500_000


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def _key_ranges(points: DataFrame, rows_per_part: int) -> tuple[list[str], list[int]]:
    """Lower bounds of the key ranges (the first is the empty string), and the parts of each."""
    keys = (points.groupBy("key").count().withColumn("h", F.xxhash64("key"))
            .orderBy("h", "key").limit(SAMPLE_KEYS).select("key").collect())  # a top-k, bounded
    keys = sorted(r["key"] for r in keys)
    step = max(1, -(-len(keys) // MAX_RANGES))
    cuts = ["", *keys[step::step]]
    sizes = {r["part"]: r["count"] for r in
             points.select(_range_of(F.col("key"), cuts).alias("part")).groupBy("part").count().collect()}
    return cuts, [max(1, -(-sizes.get(b, 0) // rows_per_part)) for b in range(len(cuts))]


def _range_of(key: Column, cuts: list[str]) -> Column:
    if len(cuts) == 1:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= key)) - 1


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """One row per input row: id, host, path, rule (host and path, or null) and verdict.

    rules: (host, path, verdict).
    """
    points = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    points = points.withColumn("key", host_key(F.col("host")))
    hosts = (rules.filter("host is not null and host != ''")
             .select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .withColumn("key", host_key(F.col("host")))
             .withColumn("depth", F.size(F.split("host", "[.]", -1)))
             .groupBy("key", "depth")
             .agg(F.sort_array(F.collect_set(F.struct(
                 (-F.length("path")).alias("shorter"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("kind"),
                 F.col("path"), F.col("verdict"), F.concat("host", "path").alias("rule")))).alias("paths")))
    depths = sorted(r["depth"] for r in hosts.select("depth").distinct().collect())  # at most the labels of a host
    cuts, parts = _key_ranges(points, rows_per_part)
    n_parts = F.element_at(F.array(*[F.lit(n) for n in parts]), F.col("part") + 1)

    # a rule reaches the ranges that its interval [key, key with the last dot raised) overlaps
    after = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    lows, highs = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(c) for c in [*cuts[1:], None]])
    reach = F.filter(F.sequence(F.lit(0), F.lit(len(cuts) - 1)),
                     lambda b: (F.get(lows, b) < after) & (F.get(highs, b).isNull() | (F.get(highs, b) > F.col("key"))))
    opened = (hosts.withColumn("part", F.explode(reach)).withColumn("salt", F.explode(F.sequence(F.lit(0), n_parts - 1)))
              .select("part", "salt", "key", F.lit(0).alias("turn"), "depth", "paths",
                      F.lit(None).cast(points.schema[id_col].dataType).alias("_id"),
                      F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")))
    swept = (points.withColumn("part", _range_of(F.col("key"), cuts))
             .withColumn("salt", F.pmod(F.xxhash64(F.col(id_col), F.col("path")), n_parts).cast("int"))
             .select("part", "salt", "key", F.lit(1).alias("turn"), F.lit(None).cast("int").alias("depth"),
                     F.lit(None).cast(hosts.schema["paths"].dataType).alias("paths"),
                     F.col(id_col).alias("_id"), "host", "path"))
    sweep = (Window.partitionBy("part", "salt").orderBy("key", "turn")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    top = lambda d: F.last(F.when((F.col("turn") == 0) & (F.col("depth") == d), F.struct("key", "paths")),
                           ignorenulls=True).over(sweep)
    both = opened.unionByName(swept).select("*", *[top(d).alias(f"at{d}") for d in depths]).filter("turn = 1")
    fitting = [F.when(F.startswith(F.col("key"), F.col(f"at{d}.key")),
                      F.get(F.filter(F.col(f"at{d}.paths"), lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
               for d in reversed(depths)]
    best = F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")
    return both.withColumn("best", best).select(
        F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
