"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortkit.llm import near_dedup
from cohortkit.llm.decontaminate import decontaminate, find_phrases
from cohortkit.llm.exact_dedup import exact_dedup
from cohortkit.llm.langid import fit_languages, predict_language
from cohortkit.llm.mixing import mix
from cohortkit.llm.pii import find_personal_data, personal_digest, sanitise
from cohortkit.llm.quality import fit_cotraining, score_quality
from cohortkit.llm.secret_scan import RULES, scan_secrets, secret_digest, trigram_query
from cohortkit.llm.toxicity import fit_chain, score_toxicity
from cohortkit.llm.url_filter import judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, start int, spans string"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))
ROWS = [
    (1, "a b c d e f g h i j k l", "en", "s1"), (2, "a b  c\td e f g h i j k l", "en", "s1"), (3, None, None, None),
    (4, "", "en", "s2"), (5, " \n ", None, "s2"), (6, "Tok token = \"abcdefghijkl9\" mail x.y@ex.org", "de", None),
    (7, LONG, "fr", "s3"), (7, LONG, "fr", "s3"), (None, "null id 12 34", "en", "s1"), (8, "é", "fr", "s3"),
    (9, "api_key: short, ip 1.2.3.4.5.6.7.8 and 999.1.1.1, card 4111 1111 1111 1111, call +1 (234) 555-6789.", "en", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, len(t) if t else None, True, 1, 1, "x") for i, t, g, s in ROWS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_trigram_queries():
    found = {r.kind: trigram_query(r.pattern) for r in RULES}
    assert found["hex"] == []  # no mandatory trigram: scans fully
    assert found["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in found["assign"]


def test_secrets(docs, none):
    found = by_id(secret_digest(scan_secrets(docs)))
    assert len(found) == len({r[0] for r in ROWS})
    assert found[6]["spans"] == "assign:4:26" and found[6]["n_assign"] == 1
    assert found[6]["base_sha256"] == hashlib.sha256(b"assign:4:26").hexdigest()
    assert found[9]["spans"] == "" and found[3]["spans"] == "" and found[9]["n_assign"] == 0
    assert secret_digest(scan_secrets(none)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("b.net", "/x/", "allow"), ("b.net", "/x/y/", "block"),
                                   ("a.b.net", "/", "allow"), (None, "/", "block"), ("", "/", "block")],
                                  "host string, path string, verdict string")
    urls = ["http://A.B.net/x/y/z?q", "http://q.b.net/x/", "http://q.b.net/x/y/1", "http://bb.net/x/", "http://net",
            None, "no scheme", "://", "http://b.net/x/#f", "ftp://é.net/", "http://q.b.net/x/"]
    pages = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)],
                                  "page_id long, url string, key string, rule string")
    for per_part in (1, 1000):  # one row in a part, or all
        got = by_id(judge_urls(pages, rules, rows_per_part=per_part), "page_id")
        assert [got[i]["rule"] for i in range(len(urls))] == [
            "a.b.net/", "b.net/x/", "b.net/x/y/", "net/", None, None, None, None, "b.net/x/", "net/", "b.net/x/"]
        assert got[5] == {"page_id": 5, "host": "", "path": "", "rule": None, "verdict": "allow"}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_spans(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(p or 0) <= 255 for p in v.split(".")) if kind == "ip" else True,
                "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text or "") if ok(k, m[0]))


def test_personal_data(spark, docs, none):
    tricky = ["a@b.com_x@y.com", "aa@bb..cc@dd.ee", "1.2.3.4.5.6.7.8 01.002.0255.4 256.1.1.1", "4111-1111-1111-1111 4111111111111112",
              "+1 (606) 555-7814 1.2.3.4 +49 30 123456789012345", "x@y.z é@é.de ü4111111111111111", "@ @a.b a@b", "+12 34"]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    got = by_id(personal_digest(find_personal_data(both)))
    for i, t in [(r[0], r[1]) for r in ROWS] + [(100 + i, t) for i, t in enumerate(tricky)]:
        assert got[i]["spans"] == brute_spans(t), t
    assert personal_digest(find_personal_data(none)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"patient Zorbax wrote to zed{0}@mail.org about weather today") for i in range(6)]
    rows += [(10 + i, "nothing but weather today and patient people about") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = find_personal_data(docs)
    terms = {(s["value"], s["kind"]) for r in found.collect() for s in r["terms"]}
    assert ("zorbax", "remove") in terms and "weather" not in {t for t, _ in terms}
    assert by_id(sanitise(docs, found))[0]["text"].startswith("patient   to [EMAIL]")


def test_disclosing_term_of_a_rare_entity(spark):
    """An address of one document gets its terms; so does one that stands in two."""
    rows = [(i, "nothing but weather today and people about") for i in range(60)]
    rows += [(100, "Quibbel wrote to sole@mail.org about weather"), (101, "weather Trommik pair@mail.org"),
             (102, "weather Trommik pair@mail.org")]
    found = by_id(find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    terms = {i: {(s["value"], s["kind"]) for s in r["terms"]} for i, r in found.items()}
    assert ("quibbel", "remove") in terms[100] and "weather" not in {t for t, _ in terms[100]}
    assert terms[101] == terms[102] == {("trommik", "remove")}
    assert not any(terms[i] for i in range(60))


def brute_terms(rows, disclosure=0.9, smooth=0.5):
    """Spans of disclosing terms of every row, in plain Python (ids are unique or null)."""
    spans, tokens = [], []
    for _, t in rows:
        t = t or ""
        found = [tuple(x.split(":")) for x in brute_spans(t).split(",") if x]
        spans.append({(k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower())
                      for k, a, b in found for v in [t[int(a):int(b)]]})
        for _, a, b in found:
            t = t[:int(a)] + " " * (int(b) - int(a)) + t[int(b):]
        tokens.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)
                       if len(m[0]) > 2 or not (m[0].isalpha() and m[0].islower() or m[0] in "0123456789")])
    sets, kinds = [{w for _, _, w in ts} for ts in tokens], {}
    for c in set().union(*spans):
        inside = [s for e, s in zip(spans, sets) if c in e]
        p = len(inside) / len(rows)
        for w in set().union(*inside):
            n_t, n_ct = sum(w in s for s in sets), sum(w in s for s in inside)
            if p < 1 and 1 - math.log((n_ct + smooth * p) / (n_t + smooth)) / math.log(p) >= disclosure:
                kinds[w] = max(kinds.get(w, ""), "remove" if n_ct == n_t else "generalise")
    return [[(kinds[w], a, b) for a, b, w in ts if w in kinds] for ts in tokens]


def test_disclosing_terms_of_whole_documents(spark):
    """A name far from the address, short, CJK and numbered terms, and a term's places in other documents."""
    far = " weather about people" * 12
    names = ["Quibbel", "Bo Li", "王小明", "ward K7 bed 4711", "Trommik", "Jörg ﬁn x2"]
    rows = [(i, f"{n}{far} zed{i}@mail.org\n{n} again, +1 (234) 555-67{i:02d} {i}") for i, n in enumerate(names)]
    rows += [(20 + i, f"Zorbax{far} zorb@mail.org mail {'weather ' * i}Zorbax") for i in range(8)]
    rows += [(40, f"no address but Zorbax and zed{far}"), (41, None), (42, ""), (None, "Nobody nul@mail.org"),
             (None, "people nul2@mail.org")]
    rows += [(50 + i, "nothing but weather again and people about") for i in range(200)]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_terms(rows)
    texts = {i: w for (i, _), w in zip(rows, want) if i is not None}
    assert len(got) == len(rows)
    assert {r["doc_id"]: [tuple(s)[:1] + tuple(s)[2:4] for s in r["terms"]] for r in got if r["doc_id"] is not None} == texts
    terms = {i: {(s["value"], s["kind"]) for s in r["terms"]} for r in got for i in [r["doc_id"]]}
    assert {("bo", "remove"), ("li", "remove")} <= terms[1] and ("王小明", "remove") in terms[2]
    assert {("k7", "remove"), ("4711", "remove")} <= terms[3] and terms[40] >= {("zorbax", "generalise")}
    assert len(texts[0]) == 2 and [k for k, *_ in texts[20]].count("generalise") == 2  # both places, 250 characters apart


def test_disclosing_terms_of_repeated_ids(spark):
    """Rows of an id are one document of the statistics; each row's own places are marked."""
    rows = [(1, "Quibbel one@mail.org"), (1, "weather Quibbel"), (1, "weather Quibbel")]
    rows += [(10 + i, "nothing but weather today and people") for i in range(80)]
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 1").collect()
    assert sorted([(s["kind"], s["start"], s["end"]) for s in r["terms"]] for r in got) == [
        [("remove", 0, 7)], [("remove", 8, 15)], [("remove", 8, 15)]]


def test_exact(docs, none):
    got = by_id(exact_dedup(docs))
    assert got[2]["keep_id"] == 1 and not got[2]["kept"] and got[1]["kept"] and got[1]["group_size"] == 2
    assert got[4]["keep_id"] == 3 and got[5]["keep_id"] == 5  # null equals empty; blank is one space
    assert got[7]["group_size"] == 2 and got[None]["kept"]
    assert exact_dedup(none).count() == 0


def test_mix(spark, docs, none):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)
    assert mix(none).count() == 0
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    per = mix(many).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 7 for r in per) and len(per) >= 2


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "A b c d e f g h i j"), (2, "null id"), (3, None), (4, ""), (2, "null id"), (5, "zz a b")],
                                  "item_id long, text string")
    got = by_id(decontaminate(docs, items))
    assert got[1]["n_hit"] == 10 and got[2]["n_hit"] == 10 and got[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest()
    assert got[None]["n_hit"] == 2 and got[3]["n_words"] == 0 and not got[3]["contaminated"]
    assert decontaminate(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs, items.limit(0)).collect())
    _, near = find_phrases(spark.createDataFrame([(1, "rare extra one two three")], "doc_id long, text string"),
                           spark.createDataFrame([(1, "rare one two three")], "item_id long, text string"), n_anchors=2)
    assert [tuple(r)[2:] for r in near.collect()] == [(0, 1)]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 4])
def test_near(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    import random
    rnd = random.Random(3)
    rows = []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(40)]
        for c in range(9):
            w = list(words)
            for _ in range(c % 5):
                w[rnd.randrange(40)] = f"x{rnd.randrange(999)}"
            rows.append((base * 9 + c, " ".join(w)))
    label, sizes = brute_components(rows, 2, 80)
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2))
    assert {i: r["component_id"] for i, r in got.items()} == label
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    if block == 1024:
        got = by_id(near_dedup.near_duplicates(docs, k=2))
        assert got[2]["component_id"] == 1 and got[3]["n_shingles"] == 0 and got[None]["component_id"] is None
        assert near_dedup.near_duplicates(none, k=2).count() == 0


def test_models_on_odd_input(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (99, 0, 0), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    cats = {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    for d in (docs, none):
        for y in (labels, labels.limit(0)):
            assert score_toxicity(d, fit_chain(d, y, cats)).count() == d.count()
            assert score_quality(d, fit_cotraining(d, y)).select("_quality.*").count() == d.count()
        assert predict_language(d, fit_languages(d, F.lit(True))).count() == d.count()
    lang = by_id(predict_language(docs, fit_languages(docs, F.lit(True))))
    assert lang[3]["lang_pred"] == "und" and lang[4]["score"] == 0


def test_pipeline_stages(spark, docs, none):
    for name, function in corpus_pipeline.STAGES:
        got = function(spark, docs, "/root/testdata/sf0.001")
        if name != "mix":
            assert got.columns == docs.columns
            assert {r[0] for r in got.select("doc_id").collect()} <= {r[0] for r in ROWS}
        assert function(spark, none, "/root/testdata/sf0.001").count() == 0
    exact = corpus_pipeline.exact_stage(spark, docs, "").groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in exact} == {1: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, None: 1}


def test_held_out_accuracy(spark):
    """Language on rows kept out of the training; quality and toxicity against all labels."""
    from cohortkit.llm import queries
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = queries.op5_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.filter("lang = lang_pred").count() >= 0.95 * lang.count()
    good = queries.op9_quality(spark, sf).join(labels, "doc_id")
    assert good.filter("good = (quality = 1)").count() >= 0.97 * good.count()
    toxic = queries.op3_toxicity(spark, sf).join(labels, "doc_id")
    assert toxic.filter("is_toxic = (toxic = 1)").count() >= 0.95 * toxic.count()
