"""Personal data: pattern spans, and information-theoretic sanitisation of their documents.

Pattern spans (email, ip, card, phone) are the protected entities. The terms of
a document are its words and numbers outside these spans, wherever they stand. A
term t discloses an entity c as far as

    PMI(c, t) / IC(c) = log(N n_ct / (n_c n_t)) / log(N / n_c) = 1 + log p(c|t) / IC(c)

nears 1 (n: documents with the entity, the term, both). Every pair is rated,
however rare: the share of the term's documents that hold the entity is
estimated as

    p(c|t) = (n_ct + smooth n_c / N) / (n_t + smooth)

so a pair seen once counts for less than one seen often. As n_ct is at most n_c,
a term of more than (n_c + smooth p) / p^(1 - disclosure) - smooth documents,
p = n_c / N, cannot reach `disclosure`; its pairs need no count. At `disclosure`
or more every occurrence of the term gets a span, in all documents: `remove` if
the term never stands without the entity, else `generalise`.

Lone digits and lower-case words of one or two letters are no terms. A run of
letters without separators (Chinese, Japanese) is one term.

Null and empty texts have no spans. Rows that repeat an id are scanned each and
are one document in the statistics; rows without id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import occurrences, pieces, sha256_of, sized, stage

#: Kinds in the order of the digest. Possessive quantifiers and look-behinds keep
#: the leftmost matches and avoid re-reading a long run from each of its characters.
PATTERNS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM, BETWEEN = r"[\p{L}\p{M}\p{N}]+", r"[^\p{L}\p{M}\p{N}]+"
NO_TERM = r"^(\p{Ll}{1,2}|\p{N})$"
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Doubling every second digit from the right, the digit sum is a multiple of 10."""
    back = F.transform(F.sequence(F.lit(0), F.length(digits) - 1),
                       lambda i: F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int") * (1 + i % 2))
    total = F.aggregate(back, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        parts = F.transform(F.split(value, "[.]"), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.when(size.between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


def pattern_spans(text: Column) -> Column:
    """array<struct<kind, rank, start, end, value>> by kind as listed, then start."""
    def of(kind: str, rank: int, pattern: str) -> Column:
        hits = F.filter(occurrences(text, pattern), lambda m: _valid(kind, m["value"]))
        return F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"),
                                                    m["start"].alias("start"), m["end"].alias("end"),
                                                    m["value"].alias("value")))
    return F.flatten(F.array(*[of(k, n, p) for n, (k, p) in enumerate(PATTERNS)])).cast(SPAN)


def _masked(text: Column, base: Column) -> Column:
    """The text with its pattern spans blanked out; every other character keeps its place."""
    def step(acc, s):
        begin, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), end - begin))).alias("out"))

    spans = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    blank = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
                        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(base) > 0, blank).otherwise(text)


def _is_term(word: Column) -> Column:
    return (F.length(word) > 2) | ~word.rlike(NO_TERM)


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.filter(pieces(text, BETWEEN), _is_term), F.lower))


def _entities(base: Column) -> Column:
    return F.array_distinct(F.transform(base, lambda s: F.concat_ws(
        "|", s["kind"], F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"])))))


def _places(text: Column, gone: Column, soft: Column) -> Column:
    """Spans of the given terms, in order; the accumulator grows by these only."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pairs = F.slice(F.zip_with(F.split(text, TERM, -1), found, lambda p, m: F.struct(p.alias("piece"), m.alias("value"))),
                    F.lit(1), F.size(found))

    def step(acc, x):
        begin = acc["at"] + F.length(x["piece"])
        end, term = begin + F.length(x["value"]), F.lower(x["value"])
        kind = F.when(F.array_contains(gone, term), "remove").otherwise("generalise")
        one = F.struct(kind.alias("kind"), F.lit(len(PATTERNS)).alias("rank"), begin.alias("start"), end.alias("end"),
                       term.alias("value"))
        hit = _is_term(x["value"]) & (F.array_contains(gone, term) | F.array_contains(soft, term))
        return F.struct(end.alias("at"), F.when(hit, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def _risk(n_ct: Column, n_c: Column, n_t: Column, total: int, smooth: float) -> Column:
    prior = n_c / F.lit(float(total))
    return F.when(prior < 1, 1 - F.try_divide(F.log((n_ct + smooth * prior) / (n_t + smooth)), F.log(prior)))


def rate_pairs(scanned: DataFrame, texts: DataFrame, disclosure: float, smooth: float) -> tuple[DataFrame, DataFrame]:
    """(entity, term, n_c, n_t, n_ct, risk) of the pairs that disclose, and (_doc, term, n_t) that can, both staged."""
    ids = scanned.groupBy("_doc").agg(F.count("*").alias("n"))
    total, most = ids.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    repeated = stage(ids.filter("n > 1").select(F.col("_doc").alias("_again")), "pii-repeated") if most > 1 else None

    def rows(df, how):
        return df.join(sized(repeated), df["_doc"] == repeated["_again"], how)

    def once(df):  # a document counts once, whatever the number of its rows
        return df if repeated is None else rows(df, "left_anti").unionByName(rows(df, "left_semi").distinct())

    # documents with a term: a count over all raw texts, less those that hold the term only inside a span
    single, marked = (texts, scanned) if repeated is None else (rows(texts, "left_anti"), rows(scanned, "left_anti"))
    words = (single.select(F.explode(_terms(F.col("_text"))).alias("term"), F.lit(1).alias("n"))
             .unionByName(marked.select(F.explode("inside").alias("term"), F.lit(-1).alias("n"))))
    if repeated is not None:
        again = rows(texts, "left_semi")
        again = again.select("_doc", F.explode(_terms(_masked(F.col("_text"), pattern_spans(F.col("_text"))))).alias("term"))
        words = words.unionByName(again.distinct().select("term", F.lit(1).alias("n")))
    seen = words.groupBy("term").agg(F.sum("n").alias("n_t"))

    held = once(scanned.select("_doc", F.explode("entities").alias("entity")))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_c"))
    prior = F.col("n_c") / F.lit(float(total))
    # a little room, so that rounding decides in the risk alone
    entities = entities.withColumn("most", ((F.col("n_c") + smooth * prior) / F.pow(prior, F.lit(1 - disclosure)) - smooth)
                                   * (1 + 1e-9))
    entities = stage(entities, "pii-entities")
    widest = entities.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    near = once(scanned.select("_doc", F.explode("terms").alias("term"))).join(seen.filter(F.col("n_t") <= widest), "term")
    near = stage(near.select("_doc", "term", "n_t"), "pii-terms")

    pairs = (near.join(held.join(sized(entities), "entity"), "_doc").filter(F.col("n_t") <= F.col("most"))
             .groupBy("entity", "term").agg(F.max("n_c").alias("n_c"), F.max("n_t").alias("n_t"), F.count("*").alias("n_ct"))
             .withColumn("risk", _risk(F.col("n_ct"), F.col("n_c"), F.col("n_t"), total, smooth)))
    return stage(pairs.filter(F.col("risk") >= disclosure), "pii-pairs"), near


def find_personal_data(docs: DataFrame, disclosure: float = 0.9, smooth: float = 0.5,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base (pattern spans) and terms (disclosing terms), arrays of spans."""
    text, base = F.col("_text"), F.col("base")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    texts = texts.withColumn("_doc", F.coalesce(F.concat(F.lit("id "), F.col("_id").cast("string")),
                                                F.concat(F.lit("text "), F.md5(text.cast("binary")))))
    # terms are kept for rows with an entity only
    some, none = F.size(base) > 0, F.array().cast("array<string>")
    scanned = (texts.withColumn("base", pattern_spans(text))
               .withColumn("terms", F.when(some, _terms(_masked(text, base))).otherwise(none))
               .withColumn("inside", F.when(some, F.array_except(_terms(text), "terms")).otherwise(none)))
    scanned = stage(scanned.select("_id", "_doc", "base", _entities(base).alias("entities"), "terms", "inside"), "pii-spans")

    pairs, near = rate_pairs(scanned, texts, disclosure, smooth)
    # a term that must go for one entity goes
    rated = pairs.groupBy("term").agg(F.max(F.when(F.col("n_ct") == F.col("n_t"), "remove").otherwise("generalise")).alias("kind"),
                                      F.max("n_t").alias("n_t"))
    beside = near.groupBy("term").agg(F.count("*").alias("n_in"))
    rated = stage(rated.join(beside, "term").select("term", "kind", (F.col("n_t") > F.col("n_in")).alias("elsewhere")), "pii-risks")
    # documents with an entity are known by term; the others are read only for the terms that they can hold
    found = near.select("_doc", "term").join(sized(rated), "term").select("_doc", "term", "kind")
    elsewhere = stage(rated.filter("elsewhere").select("term", "kind"), "pii-elsewhere")
    others = texts.select("_doc", F.explode(_terms(text)).alias("term")).join(sized(elsewhere), "term")
    found = found.unionByName(others.select("_doc", "term", "kind")).groupBy("_doc").agg(
        F.collect_set(F.when(F.col("kind") == "remove", F.col("term"))).alias("gone"),
        F.collect_set(F.when(F.col("kind") != "remove", F.col("term"))).alias("soft"))
    found = sized(stage(found.withColumnRenamed("_doc", "_hit"), "pii-found"))
    hit = F.col("_doc") == F.col("_hit")
    placed = (texts.join(found, hit).withColumn("base", pattern_spans(text)).withColumn("_text", _masked(text, base))
              .select("_id", "base", _places(text, F.col("gone"), F.col("soft")).alias("terms")))
    rest = scanned.join(found, hit, "left_anti").select("_id", "base", F.array().cast(SPAN).alias("terms"))
    return placed.unionByName(rest).withColumnRenamed("_id", id_col)


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): spans replaced by [KIND], a generalised term by its first letter and length class."""
    spans = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["kind"] == "generalise", F.concat(F.substring(s["value"], 1, 1), F.lit("*")))
        .when(s["kind"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("by"))))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"])
        over = s["start"] < acc["at"]  # overlaps what was replaced already
        return F.struct(F.when(over, acc["at"]).otherwise(s["end"]).alias("at"),
                        F.when(over, acc["out"]).otherwise(put).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    spans_of = found.select(F.col(id_col).alias("_id"), "base", "terms")
    return docs.join(spans_of, F.col(id_col).eqNullSafe(F.col("_id"))).select(id_col, clean.alias("text"))


def personal_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    show = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, *[count(k).alias(f"n_{k}") for k, _ in PATTERNS],
                        sha256_of(show(F.col("base"))).alias("base_sha256"),
                        F.array_join(show(F.concat("base", "terms")), ",").alias("spans"))
