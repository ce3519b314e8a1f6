"""Kept rows of every stage, and of a whole run, against plain Python."""

import random
import re

import pytest

import corpus_pipeline as P
from cohortkit.llm.quality import fit_cotraining, score_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def exact_rows(rows):
    best = {}
    for at, (i, t) in enumerate(rows):
        key = SPACE.sub(" ", t or "")
        best[key] = min(best.get(key, (True, 0, 0)), (i is None, i or 0, at)) if key in best else (i is None, i or 0, at)
    return sorted((rows[at] for _, _, at in best.values()), key=str)


def near_groups(rows, k=5):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def leaks(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    w = low(text)
    for item in map(low, items):
        n = min(10, len(item))
        grams = {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else set()
        if any(tuple(w[i:i + n]) in grams for i in range(len(w) - n + 1)):
            return True
    return False


@pytest.mark.parametrize("odd", [False, True])
def test_exact_stage(spark, odd):
    rows = [(3, "A text"), (5, "A  text"), (7, "B text"), (8, None), (9, ""), (10, "C")]
    if odd:  # an id of several rows, rows without id
        rows += [(7, "A text"), (7, "B text"), (None, "D"), (None, "D"), (None, "A text"), (1, "D ")]
    assert texts(P.exact_stage(spark, frame(spark, rows), "")) == exact_rows(rows)


@pytest.mark.parametrize("odd", [False, True])
def test_near_stage(spark, odd):
    rnd = random.Random(5)
    rows = []
    for base in range(5):
        words = prose(rnd, 60).split()
        for c in range(5):
            w = list(words)
            for _ in range(c):
                w[rnd.randrange(60)] = "changed"
            rows.append((base * 10 + c, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "one")]
    if odd:
        rows += [(0, "another text under a known id"), (None, rows[0][1]), (None, "alone and without id")]
    got = texts(P.near_stage(spark, frame(spark, rows), ""))
    label = near_groups(rows)
    kept = [label[rows.index(r)] for r in got]
    assert sorted(kept) == sorted(set(label))  # one row of every group
    if not odd:
        assert got == sorted(((i, t) for n, (i, t) in enumerate(rows) if label[n] == n), key=str)


def test_benchmark_stage(spark, tmp_path):
    rnd = random.Random(6)
    items = [(1, prose(rnd, 14)), (2, "short Item here"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    words = items[0][1].split()
    rows = [(1, prose(rnd, 30)), (2, "x " + " ".join(words[2:12]).upper() + " y"), (3, " ".join(words[:9])), (4, None),
            (5, "a SHORT item HERE"), (None, "z " + items[0][1]), (None, prose(rnd, 20)), (1, items[0][1]), (6, "")]
    want = sorted(((i, t) for i, t in rows if not leaks(t, [t for _, t in items])), key=str)
    assert texts(P.benchmark_stage(spark, frame(spark, rows), str(tmp_path))) == want
    assert (None, rows[6][1]) in want and (1, rows[0][1]) in want and len(want) == 5


def test_run(spark, tmp_path, monkeypatch):
    """With a classifier that keeps all (no labels), a run is the four other stages in plain Python."""
    rnd = random.Random(7)
    item = prose(rnd, 12)
    rows = [(i, prose(rnd, 25)) for i in range(20)]
    rows += [(30, rows[3][1]), (31, "  ".join(rows[4][1].split(" "))), (32, "lead " + item), (33, rows[5][1] + " end"),
             (34, " ".join(f"w{i}" for i in range(20_000))), (35, None), (36, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = exact_rows(rows)
    label = near_groups(left[:0] or [r for r in left if r[0] != 34])
    near = [r for r in left if r[0] != 34]
    near = [r for n, r in enumerate(near) if r[0] == min(q[0] for m, q in enumerate(near) if label[m] == label[n])]
    want = sorted([i for i, t in near if not leaks(t, [item])] + [34])
    got = P.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == want
    sizes = {r["doc_id"]: r["size"] for r in got.collect()}
    assert sizes[34] == 20_000 and all(sizes[i] == len((t or "").split()) for i, t in rows if i in sizes)


def labelled(rnd, n):
    rows, labels = [], []
    for i in range(n):
        good = int(rnd.random() < 0.5)
        text = prose(rnd, 40).capitalize() + "." if good else "!!! BUY | NOW | " * 12
        rows.append((i, text))
        labels.append((i, good))
    return rows, labels


def test_repeated_ids_stay_bounded_on_the_driver(spark, monkeypatch):
    """10000 unlabelled rows of one id, and 3000 of a labelled one."""
    import pandas as pd
    rnd = random.Random(2)
    rows, labels = labelled(rnd, 60)
    rows += [(999, f"many rows {i}") for i in range(10_000)] + [(0, f"copies {i}") for i in range(3_000)]
    seen = []
    whole = pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *a, **k: (seen.append(len(self)), whole(self, *a, **k))[1])
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit_cotraining(docs, known, max_train=50)
    assert seen and max(seen) <= 50
    again = fit_cotraining(docs.repartition(7), known, max_train=50)  # one row an id, whatever the order
    assert abs(model.both - again.both).max() < 1e-6
    assert score_quality(docs, model).count() == len(rows)


def brute_cotraining(x_text, x_meta, good, pool_text, pool_meta, rounds, per_round, sure):
    """The exchange of pseudo-labels on standardised views, in plain NumPy."""
    import numpy as np
    from cohortkit.llm.linear import fit_logistic
    known, pool, told = (x_text, x_meta), (pool_text, pool_meta), [{}, {}]

    def fit(v):
        extra = [pool[v][i] for i in told[v]]
        return fit_logistic(np.vstack([known[v], *[e[None] for e in extra]]), np.append(good, list(told[v].values())))
    models = [fit(0), fit(1)]
    for _ in range(rounds):
        for v in (0, 1):
            z = pool[v] @ models[v][:-1] + models[v][-1]
            free = [i for i in range(len(z)) if i not in told[1 - v]]
            up = sorted((i for i in free if z[i] >= sure), key=lambda i: -z[i])
            down = sorted((i for i in free if -z[i] >= sure), key=lambda i: z[i])
            take = min(per_round, len(up), len(down))
            told[1 - v].update({i: 1.0 for i in up[:take]} | {i: 0.0 for i in down[:take]})
        models = [fit(0), fit(1)]
    return models


def test_exchange_against_plain_numpy(spark):
    import math

    import numpy as np
    from cohortkit.llm import quality as Q
    rnd = random.Random(9)
    rows, labels = labelled(rnd, 50)
    whole, labels = labels, labels[:24]
    docs = frame(spark, rows)
    views = np.array([Q._text_view(t) + Q._meta_view(t, len(t), "en", "s") for _, t in rows], np.float32).astype(float)
    mean, scale = views.mean(axis=0), np.maximum(views.std(axis=0, ddof=1), 1e-6)
    z = (views - mean) / scale
    k, turn = Q.TEXT_FEATURES, np.arange(1, 25)
    train, calibrate = turn % 4 != 0, turn % 4 == 0
    good = np.array([g for _, g in labels], float)
    models = brute_cotraining(z[:24, :k][train], z[:24, k:][train], good[train], z[24:, :k], z[24:, k:], 2, 3,
                              math.log(Q.SURE / (1 - Q.SURE)))
    got = fit_cotraining(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rounds=2, per_round=3)
    from cohortkit.llm.linear import fit_logistic
    for v, (part, mine) in enumerate(((slice(0, k), got.text), (slice(k, None), got.meta))):
        margin = z[:24, part][calibrate] @ models[v][:-1] + models[v][-1]
        a, b = fit_logistic(margin[:, None], good[calibrate], ridge=0.01)
        assert np.abs(np.append(models[v][:-1] * a, models[v][-1] * a + b) - mine).max() < 1e-3, v
    truth = spark.createDataFrame(whole, "doc_id long, quality int")
    assert score_quality(docs, got).join(truth, "doc_id").filter("_quality.good != (quality = 1)").count() == 0
