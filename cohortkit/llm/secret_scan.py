"""Secret scan over a trigram inverted index.

Each rule's regex gives a Boolean trigram query: an OR of clauses, each an AND
of trigrams that every match must contain (letters in lower case). The index
holds (trigram, document) postings of the trigrams that some rule asks for.
Postings are intersected per clause by one grouped count, and a rule's regex
runs only on the documents its query leaves. A rule without mandatory trigrams
(such as a bare character-class run) scans every text.

Nulls and empty texts have no spans. Rows that repeat a document id are each
scanned; their postings are merged, which only adds candidates. A null id is a
key like any other.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex_parser
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import occurrences, sha256_of, sized, stage

GAP = "\0"
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """pattern: valid for Java and Python; a match counts if group `group` has min_len characters."""

    kind: str
    pattern: str
    min_len: int = 0
    group: int = 0


#: The three base kinds, in the order of the digest. `{16,}` and `{14,}` fold the
#: length rule into maximal runs; the assignment rule filters after matching.
BASE_RULES = (
    Rule("assign",
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/-]{20,})"),
)
RULES = BASE_RULES + MORE_RULES


def _strings(nodes) -> list[str]:
    """The literal texts a pattern can match, with GAP where anything may stand."""
    out = [""]
    for kind, arg in nodes:
        if kind is op.LITERAL:
            part = [chr(arg).lower()]
        elif kind is op.IN and len(arg) <= 6 and all(k is op.LITERAL for k, _ in arg):
            part = sorted({chr(c).lower() for _, c in arg})
        elif kind is op.SUBPATTERN:
            part = _strings(arg[-1])
        elif kind is op.BRANCH:
            part = sorted({s for branch in arg[1] for s in _strings(branch)})
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = _strings(sub)
            if low == 0:
                part = ["", *inner] if high == 1 else [GAP]
            else:
                part = inner if low == high == 1 else [s + GAP for s in inner]
        elif kind is op.AT:
            part = [""]
        else:
            part = [GAP]
        joined = [a + b for a in out for b in part]
        out = joined if len(joined) <= MAX_ALTERNATIVES else [a + GAP for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams; empty if some match may have none."""
    clauses = {frozenset(seg[i:i + 3] for seg in s.split(GAP) for i in range(len(seg) - 2))
               for s in _strings(regex_parser.parse(pattern))}
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Postings (trigram, doc) of the wanted trigrams: one row for each that a text contains."""
    low = docs.select(F.col(id_col).alias("doc"), F.lower(F.col(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return low.select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc, rules): the rules whose trigram query the document's postings satisfy."""
    terms = [(t, f"{r.kind}/{k}", len(c), r.kind) for r in rules for k, c in enumerate(trigram_query(r.pattern))
             for t in sorted(c)]
    query = index.sparkSession.createDataFrame(terms, "trigram string, clause string, need int, kind string")
    hits = index.join(F.broadcast(query), "trigram").distinct()  # bounded by the rules given
    return (hits.groupBy("doc", "clause", "kind").agg(F.count("*").alias("n"), F.first("need").alias("need"))
            .filter("n = need").groupBy("doc").agg(F.collect_set("kind").alias("rules")))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans array<struct<start,rank,end,kind>> in order of start, then rule."""
    full = [r for r in rules if not trigram_query(r.pattern)]
    indexed = [r for r in rules if trigram_query(r.pattern)]
    base = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if indexed:
        wanted = {t for r in indexed for c in trigram_query(r.pattern) for t in c}
        index = trigram_index(base, sorted(wanted), id_col, "_text")
        found = stage(candidates(index, indexed), "secret-candidates").withColumnRenamed("rules", "_rules")
        base = base.join(sized(found), base[id_col].eqNullSafe(found["doc"]), "left").drop("doc")
    else:
        base = base.withColumn("_rules", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def spans(rule: Rule, rank: int) -> Column:
        hits = occurrences(F.col("_text"), rule.pattern)
        if rule.min_len:
            hits = F.filter(hits, lambda m: F.length(F.regexp_extract(m["value"], rule.pattern, rule.group))
                            >= rule.min_len)
        hits = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                    m["end"].alias("end"), F.lit(rule.kind).alias("kind")))
        return hits if rule in full else F.when(F.array_contains("_rules", rule.kind), hits).otherwise(empty)

    return base.select(id_col, F.array_sort(F.flatten(F.array(
        *[spans(r, k) for k, r in enumerate(rules)]))).alias("spans"))


def secret_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their hash, and all spans as text."""
    show = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return scanned.select(
        id_col, *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        sha256_of(show(base)).alias("base_sha256"), F.array_join(show(F.col("spans")), ",").alias("spans"))
