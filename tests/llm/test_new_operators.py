"""Substring dedup, source audit and bit-plane clustering against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import clustering, source_audit, substring_dedup
from cohortkit.llm.clustering import cluster_vectors, pack_planes, plane_dots
from cohortkit.llm.source_audit import audit_sources, count_shard
from cohortkit.llm.substring_dedup import remove_repeats

DOCS = "doc_id long, text string, lang string, source string, slice int, bucket int, h string, kept int, n int, term int"


def frame(spark, rows):
    """Rows (id, text[, lang, source]) with columns whose names the operators use inside."""
    full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5) for r in full], DOCS)


# --- substring dedup ---------------------------------------------------------------


def brute_removed(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    starts = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a:a + window])
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1 if i is not None else 0):
            if starts[tuple(w[a:a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out, key=str)


def repeats(rnd):
    voc = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(voc) for _ in range(n)]
    passage, other = text(70), text(53)
    rows = [(i, " ".join(text(rnd.randrange(0, 90)))) for i in range(30)]
    rows += [(40 + i, " ".join(text(rnd.randrange(20)) + passage[i % 5:] + text(rnd.randrange(20)))) for i in range(40)]
    rows += [(90 + i, " \t ".join(other[: 48 + i])) for i in range(6)]  # 48 to 53 words of one passage
    rows += [(200, " ".join(["same"] * 120)), (201, " ".join(["same"] * 60)), (5, " ".join(passage)), (5, " ".join(passage)),
             (300, None), (301, ""), (302, " \n\v "), (None, " ".join(passage)), (None, None), (-3, " ".join(other)),
             (303, "é ü " + " ".join(passage[:49]) + "  "), (304, " ".join(passage + other + passage))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,rows_a_slice,piece", [(50, 256, 4 * 2**20), (50, 3, 300), (7, 16, 1000)])
def test_substrings(spark, monkeypatch, tmp_path, window, rows_a_slice, piece):
    monkeypatch.setattr(substring_dedup, "SLICE_ROWS", rows_a_slice)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(substring_dedup, "BUCKET", 4000)  # several buckets
    rows = repeats(random.Random(window))
    docs = frame(spark, rows)
    want = brute_removed(rows, window)
    got = remove_repeats(docs, window, output="sha256")
    assert sorted((tuple(r) for r in got.drop("spans").collect()), key=str) == want
    docs.repartition(3).write.parquet(str(tmp_path / "d"))  # the same from files, and as texts
    read = remove_repeats(spark.read.parquet(str(tmp_path / "d")), window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in read),
                  key=str) == want
    for r in read:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == r.n_words - len(r.kept_text.split())
        assert all(s.end - s.start >= window for s in r.spans)


def test_substrings_of_nothing_and_of_long_texts(spark):
    assert remove_repeats(frame(spark, []), output="sha256").count() == 0
    assert remove_repeats(frame(spark, [(1, None), (None, "")])).count() == 2
    long = " ".join(f"word{i % 9973}" for i in range(20_000))
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [(2, long), (1, long), (3, "x" * 200_000)])).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 20_000 and got[2].kept_text == "" and got[3].n_words == 1


# --- source audit ------------------------------------------------------------------


def brute_audit(rows, min_docs=10, top=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((g or ""), (s or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low)))
            for _, t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        total = Counter(t for d in mine for t in d[2])

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("terms,sources,shard", [(4096, 128, 16 * 2**20), (3, 2, 200)])
def test_audit(spark, monkeypatch, terms, sources, shard):
    monkeypatch.setattr(source_audit, "TERMS", terms)
    monkeypatch.setattr(source_audit, "SOURCES", sources)
    monkeypatch.setattr(source_audit, "SHARD", shard)
    rnd = random.Random(4)
    voc = ["the", "The", "a", "straße", "ÉTÉ", "été", "x" * 70, "x" * 70 + "y", "abcdefgh", "abcdefghi", "don't", "4four", "王"]
    rows = [(i % 50, " ".join(rnd.choice(voc) for _ in range(rnd.randrange(12))), rnd.choice(["en", "de", None, ""]),
             rnd.choice(["s1", "s2", "s3", "é", None, "s10"])) for i in range(400)]
    rows += [(1, None, "en", "quiet"), (None, "", "fr", "s1"), (2, "rare words only", "fr", "s2"), (3, "one", "it", "s1")]
    assert sorted(tuple(r) for r in audit_sources(frame(spark, rows)).collect()) == brute_audit(rows)


def test_audit_of_nothing(spark):
    assert audit_sources(frame(spark, [])).count() == 0
    assert audit_sources(frame(spark, [(1, None, None, None)])).count() == 0  # one source, no terms


@pytest.mark.parametrize("leaf", [1, 64, 1 << 16])
def test_pointer_sort(monkeypatch, leaf):
    monkeypatch.setattr(source_audit, "LEAF", max(leaf, 256))
    rnd = random.Random(leaf)
    voc = ["a", "ab", "abcdefgh", "abcdefghi", "z" * 64, "z" * 64 + "a", "z" * 65, "é" * 40, "q" * 3000]
    texts = [" ".join(rnd.choice(voc) for _ in range(rnd.randrange(30))) for _ in range(200)] + ["", None]
    data = source_audit._FOLD[np.frombuffer(" ".join(t or "" for t in texts).encode(), np.uint8)]
    start, end = source_audit.word_pointers(data, np.array([0, len(data)]))
    order, head = source_audit.sort_pointers(data, start, end)
    words = [data[s:e].tobytes() for s, e in zip(start, end)]
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert [words[i] for i, h in zip(order, head) if h] == sorted(set(words))
    shard = count_shard(["l"] * len(texts), ["s"] * len(texts), pa.array([t or "" for t in texts]))
    n = Counter(w for t in texts for w in (t or "").split())
    df = Counter(w for t in texts for w in set((t or "").split()))
    assert {t.decode(): (a, b) for t, a, b in zip(*(shard.column(c).to_pylist() for c in ("term", "n", "df"))) if t} == {
        w: (n[w], df[w]) for w in n}


# --- clustering --------------------------------------------------------------------


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        at = [place(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at) if a == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    at = [place(v) for _, v in kept]
    d = [far(v, centres[a]) for (_, v), a in zip(kept, at)]
    each = Counter()
    for a, x in zip(at, d):
        each[a] += x
    return sorted(((i, a, x, each[a], sum(d), hashlib.sha256(",".join(map(str, centres[a])).encode()).hexdigest())
                   for (i, _), a, x in zip(kept, at, d)), key=str)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, cluster int, distance int, v int")


def test_planes_give_exact_dots():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 28):
        u = rng.integers(0, 2**bits, (50, 64))
        planes = pack_planes(u, bits)
        assert (plane_dots(planes, planes[7]) == u @ u[7]).all()


@pytest.mark.parametrize("kind", ["double", "float"])
def test_clusters(spark, kind, monkeypatch):
    monkeypatch.setattr(clustering, "CHUNK", 17)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 64))
    x = (centre[rng.integers(0, 5, 120)] + rng.normal(size=(120, 64)) * 0.4).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, x[0].tolist()), (500, x[0].tolist()), (3, x[9].tolist()), (None, x[4].tolist()), (600, [0.5] * 64),
             (601, [-0.0001] * 64)]
    odd = [(700, None), (701, []), (702, [1.0] * 63), (703, [1.0] * 65), (704, [None] + [1.0] * 63),
           (705, [float("nan")] + [1.0] * 63), (706, [float("inf")] + [1.0] * 63)]
    got, centres = cluster_vectors(vectors(spark, rows + odd, kind).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(rows)
    assert len(centres) == 8


def test_few_equal_large_and_no_vectors(spark):
    few = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [100_000.0] * 64), (4, [-100_000.0] + [0.0] * 63)]
    got, centres = cluster_vectors(vectors(spark, few))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(few) and len(centres) == 4
    beyond, _ = cluster_vectors(vectors(spark, [*few, (9, [1e30] * 64)]))
    by_id = {r.vec_id: r for r in beyond.collect()}
    assert by_id[9].cluster is None and by_id[9].distance is None and by_id[1].cluster is not None
    for rows in ([], [(1, None)], [(1, [1.0])]):
        none, centres = cluster_vectors(vectors(spark, rows))
        assert none.count() == 0 and centres == []
    only, _ = cluster_vectors(vectors(spark, [(9, [1e30] * 64)]))
    assert only.filter(F.col("cluster").isNull()).count() == 1
