"""Proximity matches of op6 against plain Python."""

import random
import re
from collections import Counter

from cohortkit.llm.decontaminate import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def brute_near(docs, items, window, slop):
    count = Counter(w for _, t in docs for w in words(t))
    windows = {tuple(w[i:i + window]) for _, t in items for w in [words(t)] if w
               for i in range(max(len(w) - window, 0) + 1)}
    out = {}
    for doc, text in docs:
        held, n = words(text), 0
        for win in windows:
            if len(win) < 2:
                continue
            first, second = sorted(range(len(win)), key=lambda o: (count[win[o]], o))[:2]
            at = [[p - o for p, w in enumerate(held) if w == win[o] and p >= o] for o in (first, second)]
            n += any(0 < min(abs(a - b) for b in at[1]) <= slop for a in at[0] if at[1])
        out[doc] = n
    return out


def test_near_windows_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 6, 9])))) for i in range(12)] + [(99, None), (98, "")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 200])))) for i in range(30)]
    for i in range(12):  # an item with a word put in the middle, one with a word gone, one as it is
        part = items[i][1].split()
        half = len(part) // 2
        docs += [(100 + 3 * i, " ".join(part[:half] + ["extra"] + part[half:])),
                 (101 + 3 * i, " ".join(part[:half] + part[half + 1:])), (102 + 3 * i, " ".join(part))]
    docs += [(900, None), (901, "")]
    got = {r["doc_id"]: r["n_near"] for r in decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"), window=6).collect()}
    want = brute_near(docs, items, 6, 5)
    assert got == want and sum(want.values()) > 20
