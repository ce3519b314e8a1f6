"""Quality classifier by co-training.

Two views of a document: the text (what its words and characters are like) and
the page metadata (declared language, source and length, and the layout of its
lines). A logistic model per view starts from labelled rows. In every round
both views score all unlabelled rows of the corpus; each hands the rows it is
most sure of, as many good as bad up to `per_round`, to the other view, which
trains on them too. Labelled rows kept out of the training calibrate the two
views' log-odds, and one model over both gives the probability of good quality.
All documents are scored where they lie.

At most `max_train` labelled ids, drawn by hash, are trained on; one row of an
id that repeats stands for it, the first by a hash of its content. Means and
scales, and the rows that views exchange, come from all documents. A null text
reads as empty; null metadata is a value of its own. Conflicting labels of one id
count by majority. With labels of one kind only, or none, every document is kept.
Very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import stage
from cohortkit.llm.linear import fit_logistic

MAX_TRAIN = 10_000
ROUNDS, PER_ROUND, SURE = 5, 400, 0.95
#: One view's log-odds count up to this, so that an odd layout alone rejects nothing.
MOST_ODDS = 6.0
TEXT_FEATURES, LANG_SLOTS, SOURCE_SLOTS = 13, 8, 16
META_FEATURES = 6 + LANG_SLOTS + SOURCE_SLOTS
_UPPER, _DIGIT, _SYMBOL = re.compile(r"[A-ZÀ-Þ]"), re.compile(r"\d"), re.compile(r"[^\w\s.,;:'\"()-]")


def _text_view(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), max(1, len(text))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    top = counts.most_common(1)[0][1] if n else 0
    count = lambda pattern: sum(1 for _ in pattern.finditer(text))
    symbols, entropy = count(_SYMBOL), -sum(c / n * math.log(c / n) for c in counts.values()) if n else 0.0
    return [math.log1p(n), len(counts) / max(1, n), pairs / max(1, n - 1), top / max(1, n), entropy,
            sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1), sum(map(len, words)) / max(1, n),
            count(_UPPER) / chars, count(_DIGIT) / chars, symbols / chars,
            text.count("!") / chars, text.count("|") / max(1, n), float(n < 5)]


def _meta_view(text: str, n_chars, lang, source) -> list[float]:
    lines = text.split("\n")
    lang_slot, source_slot = [0.0] * LANG_SLOTS, [0.0] * SOURCE_SLOTS
    lang_slot[zlib.crc32(str(lang).encode()) % LANG_SLOTS] = 1.0
    source_slot[zlib.crc32(str(source).encode()) % SOURCE_SLOTS] = 1.0
    longest = max(map(len, lines))
    given = float(n_chars) if n_chars is not None and n_chars == n_chars else float(len(text))
    return [math.log1p(max(0.0, given)), math.log1p(len(lines)), math.log1p(len(text) / len(lines)), math.log1p(longest),
            sum(x.endswith((".", "!", "?", ":")) for x in lines) / len(lines), len(set(lines)) / len(lines),
            *lang_slot, *source_slot]


def features(text: Column, n_chars: Column, lang: Column, source: Column) -> Column:
    """Both views as one array<float>."""
    @F.pandas_udf("array<float>")
    def views(texts: pd.Series, chars: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([np.array(_text_view(t or "") + _meta_view(t or "", c, g, s), np.float32)
                          for t, c, g, s in zip(texts, chars, langs, sources)], dtype=object)
    return views(text, n_chars, lang, source)


def _log_odds(views: Column, weights: np.ndarray, first: int, mean: np.ndarray, scale: np.ndarray) -> Column:
    """Log-odds of the model of one view, whose features begin at `first`."""
    part = slice(first, first + len(weights) - 1)
    w = weights[:-1] / scale[part]
    b = float(weights[-1] - (w * mean[part]).sum())
    terms = F.zip_with(F.slice(views, first + 1, len(w)), F.array(*[F.lit(float(v)) for v in w]), lambda x, y: x * y)
    return F.aggregate(terms, F.lit(b), lambda acc, t: acc + t)


@dataclass(frozen=True)
class CoTrained:
    """Standardisation, the two view models, and the combination of their log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    both: np.ndarray

    def _dot(self, views: Column, weights: np.ndarray, first: int) -> Column:
        z = _log_odds(views, weights, first, self.mean, self.scale)
        return F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), z))

    def score(self, views: Column) -> Column:
        """struct<p_text, p_meta, score>: calibrated probabilities of good quality of either view and of both."""
        z_text = self._dot(views, self.text, 0)
        z_meta = self._dot(views, self.meta, TEXT_FEATURES)
        odds = lambda z: 1 / (1 + F.exp(-z))
        both = F.lit(float(self.both[0])) * z_text + F.lit(float(self.both[1])) * z_meta + F.lit(float(self.both[2]))
        return F.struct(odds(z_text).alias("p_text"), odds(z_meta).alias("p_meta"), odds(both).alias("score"))



def fit_cotraining(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, rounds: int = ROUNDS,
                   per_round: int = PER_ROUND, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality") -> CoTrained:
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
             .groupBy("id").agg(F.avg("y").alias("y")))
    view = features(F.col(text_col), F.col("n_chars"), F.col("lang"), F.col("source"))
    rows = stage(docs.select(F.col(id_col).alias("id"), view.alias("views")), "quality-views")
    # one row an id, so that at most max_train rows reach the driver
    some = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(max_train))
    chosen = (rows.join(some, "id").groupBy("id").agg(F.min_by("views", F.struct(F.xxhash64("views"), "views")).alias("views"),
                                                      F.first("y").alias("y")).toPandas().sort_values("id", kind="stable"))
    width = TEXT_FEATURES + META_FEATURES
    x = np.array(chosen["views"].tolist(), float).reshape(len(chosen), width)
    good = (chosen["y"].to_numpy(float) >= 0.5).astype(float)
    if len(set(good)) < 2:
        always = np.zeros(TEXT_FEATURES + 1), np.zeros(META_FEATURES + 1)
        return CoTrained(np.zeros(width), np.ones(width), *always, np.array([0.0, 0.0, MOST_ODDS]))
    moments = rows.select(Summarizer.metrics("mean", "std").summary(array_to_vector("views")).alias("s")).first()["s"]
    mean, scale = moments["mean"].toArray(), np.maximum(moments["std"].toArray(), 1e-6)
    x = (x - mean) / scale
    turn = np.arange(1, len(x) + 1)
    train, calibrate = turn % 4 != 0, turn % 4 == 0
    spans = (slice(0, TEXT_FEATURES), slice(TEXT_FEATURES, width))
    parts = [x[:, s] for s in spans]
    # unlabelled rows, and what either view has been told of them: {row: (features, label)}
    pool = rows.join(known.select("id"), "id", "left_anti").withColumn("row", F.xxhash64("id", "views"))
    told: list[dict] = [{}, {}]

    def fit(v: int) -> np.ndarray:
        extra = np.array([f[spans[v]] for f, _ in told[v].values()], float).reshape(-1, parts[v].shape[1])
        return fit_logistic(np.vstack([parts[v][train], (extra - mean[spans[v]]) / scale[spans[v]]]),
                            np.append(good[train], [label for _, label in told[v].values()]))

    models = [fit(0), fit(1)]
    sure = math.log(SURE / (1 - SURE))
    for _ in range(rounds):
        # the surest rows of every view and side, enough to pass over those told before: one scan
        asks = []
        for v in (0, 1):
            z = _log_odds(F.col("views"), models[v], spans[v].start, mean, scale)
            for sign in (1, -1):
                asks.append(pool.select(F.lit(v).alias("view"), F.lit(sign).alias("sign"), (z * sign).alias("z"), "row", "views")
                            .filter(F.col("z") >= sure).orderBy(F.desc("z"), "row").limit(per_round + len(told[1 - v])))
        found = asks[0].union(asks[1]).union(asks[2]).union(asks[3]).collect()
        for v in (0, 1):
            new = {sign: [r for r in sorted((r for r in found if r["view"] == v and r["sign"] == sign),
                                            key=lambda r: (-r["z"], r["row"])) if r["row"] not in told[1 - v]]
                   for sign in (1, -1)}
            new = {sign: list({r["row"]: r for r in of}.values()) for sign, of in new.items()}  # equal rows once
            take = min(per_round, len(new[1]), len(new[-1]))
            for sign, label in ((1, 1.0), (-1, 0.0)):
                told[1 - v].update({r["row"]: (np.array(r["views"], float), label) for r in new[sign][:take]})
        models = [fit(0), fit(1)]
    # each view's log-odds are calibrated on rows that neither view trained on, then combined
    scaled = []
    for v in (0, 1):
        z = parts[v][calibrate] @ models[v][:-1] + models[v][-1]
        a, b = fit_logistic(z[:, None], good[calibrate], ridge=0.01)
        scaled.append(np.append(models[v][:-1] * a, models[v][-1] * a + b))
    z = np.column_stack([parts[v][calibrate] @ scaled[v][:-1] + scaled[v][-1] for v in (0, 1)]).clip(-MOST_ODDS, MOST_ODDS)
    return CoTrained(mean, scale, *scaled, fit_logistic(z, good[calibrate], ridge=0.01))


def score_quality(docs: DataFrame, model: CoTrained, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with the columns p_text, p_meta, score and good (score at or above the threshold) in a struct `_quality`."""
    view = features(F.col(text_col), F.col("n_chars"), F.col("lang"), F.col("source"))
    scored = docs.withColumn("_views", view).withColumn("_quality", model.score(F.col("_views"))).drop("_views")
    return scored.withColumn("_quality", F.col("_quality").withField("good", F.col("_quality.score") >= threshold))
