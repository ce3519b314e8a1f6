"""Benchmark decontamination with a distributed positional inverted index.

Every benchmark item is cut into windows of `window` consecutive words (an item
of fewer words is one window). The terms of the windows are counted over all
documents, and each window keeps its rarest terms as anchors. The index stores
postings (term, document, position) of the anchors only. A posting minus its
anchor's offset is the place where the window would start, so intersecting the
anchors' lists is one shuffle by (document, window) and one sort by start:
equal starts are candidates for an exact phrase, starts within `slop` words
are proximity matches. Exact candidates are confirmed on the document's words.

Common words never enter the index unless a window has nothing rarer. A null or
empty text has no words; an item without words has no windows. Repeated item
rows are one item, rows that repeat a document id are read as one document's
texts (n_words adds up).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortkit.llm.common import ascii_lower, pieces, sized, stage

#: Words are letters and digits of ASCII and every character from U+0080; this is what stands between them.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return pieces(ascii_lower(text), BETWEEN)


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, wid, words): the windows of every item; wid is a hash, windows are compared by their words."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("all")).filter("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    return (w.select("item", "all", F.explode(starts).alias("at"))
            .select("item", F.expr(f"slice(all, at, {int(window)})").alias("words"))
            .distinct().withColumn("wid", F.xxhash64("words")))


def anchors(windows: DataFrame, docs: DataFrame, count: int) -> DataFrame:
    """(term, wid, rank, offset): the `count` rarest places of each window; rank 1 is the rarest."""
    places = (windows.select("wid", "words").distinct()
              .select("wid", "words", F.posexplode("words").alias("offset", "term")))
    vocabulary = sized(stage(places.select("term").distinct(), "bench-terms"))
    df = (docs.select(F.explode("words").alias("term")).join(vocabulary, "term", "left_semi")
          .groupBy("term").agg(F.count("*").alias("df")))
    rarest = Window.partitionBy("wid", "words").orderBy("df", "offset")
    return (places.join(df, "term", "left").fillna(0, ["df"])
            .withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= count)
            .select("term", "wid", "rank", "offset").distinct())


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index: (term, doc, pos) of the given terms."""
    rows = docs.select("doc", F.posexplode("words").alias("pos", "term"))
    return rows.join(terms, "term", "left_semi")


def find_phrases(docs: DataFrame, items: DataFrame, window: int = 10, n_anchors: int = 2, slop: int = 5,
                 id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(matches, near).

    matches: (doc, wid, words, start) of every exact occurrence of a window.
    near: (doc, wid, start, distance) where the anchors stand within slop words
    of their places in the window, without an exact start.
    """
    tokens = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("words"))
    windows = stage(item_windows(items, window, item_id_col, item_text_col), "bench-windows")
    places = stage(anchors(windows, tokens, n_anchors), "bench-anchors")
    index = postings(tokens, sized(stage(places.select("term").distinct(), "anchor-terms")))
    starts = (index.join(sized(places), "term")
              .select("doc", "wid", "rank", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0"))
    needed = windows.select("wid", F.least(F.size("words"), F.lit(n_anchors)).alias("need")).distinct()

    # nearest start of the second anchor on either side of each first-anchor start
    line = Window.partitionBy("doc", "wid").orderBy("start", F.col("rank").desc())
    second = F.when(F.col("rank") == n_anchors, F.col("start"))
    before = F.last(second, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(second, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("start") - before, after - F.col("start"))
    met = (starts.join(sized(stage(needed, "bench-needs")), "wid")
           .withColumn("gap", F.when(F.col("need") == 1, F.lit(0)).otherwise(gap))
           .filter((F.col("rank") == 1) & (F.col("gap") <= slop)))
    met = stage(met.select("doc", "wid", "start", F.col("gap").alias("distance")).distinct(), "bench-met")
    near = met.filter("distance > 0")

    hit = met.filter("distance = 0").select("doc", "wid", "start")
    by_doc = stage(hit.groupBy("doc").agg(F.collect_set(F.struct("wid", "start")).alias("places")), "bench-places")
    held = tokens.withColumnRenamed("doc", "_doc")
    held = held.join(sized(by_doc), held["_doc"].eqNullSafe(by_doc["doc"])).select("doc", F.col("words").alias("text"),
                                                                                  F.explode("places").alias("p"))
    # at most the longest window's words travel on from here
    found = held.select("doc", "p.wid", "p.start", F.expr(f"slice(text, p.start + 1, {int(window)})").alias("text"))
    wanted = sized(stage(windows.select("wid", "words").distinct(), "bench-words"))
    matches = (found.join(wanted, "wid").filter(F.slice("text", F.lit(1), F.size("words")) == F.col("words"))
               .select("doc", "wid", "words", "start"))
    return matches, near


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    A word inside any exact occurrence of a window is hit. n_near counts
    windows that only came near (see find_phrases).
    """
    matches, near = find_phrases(docs, items, window, id_col=id_col, text_col=text_col, item_id_col=item_id_col,
                                 item_text_col=item_text_col, **options)
    matches = stage(matches, "bench-matches")
    of = stage(item_windows(items, window, item_id_col, item_text_col), "bench-items")

    # words covered by intervals: each adds what lies beyond the furthest end so far
    spans = matches.select("doc", "start", (F.col("start") + F.size("words")).alias("end")).distinct()
    reach = F.max("end").over(Window.partitionBy("doc").orderBy("start", "end")
                              .rowsBetween(Window.unboundedPreceding, -1))
    covered = (spans.withColumn("reach", F.coalesce(reach, F.lit(0)))
               .withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach")))
               .groupBy("doc").agg(F.sum("new").alias("n_hit")))
    hit_items = (matches.select("doc", "wid", "words").distinct().join(sized(of), ["wid", "words"])
                 .groupBy("doc").agg(F.collect_set(F.col("item").cast("string")).alias("items")))
    nearly = near.groupBy("doc").agg(F.count_distinct("wid").alias("n_near"))
    found = covered.join(hit_items, covered["doc"].eqNullSafe(hit_items["doc"])).select(covered["doc"], "n_hit", "items")
    found = found.withColumnRenamed("doc", "_hit")
    nearly = nearly.withColumnRenamed("doc", "_near")
    count = docs.select(F.col(id_col).alias("_id"), F.size(words(F.col(text_col))).alias("n"))
    count = count.groupBy("_id").agg(F.sum("n").alias("n_words"))
    out = count.join(found, count["_id"].eqNullSafe(found["_hit"]), "left")
    out = out.join(nearly, out["_id"].eqNullSafe(nearly["_near"]), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_of), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
