"""Toxicity by classifier chains.

The categories are predicted one after the other by logistic models. Each model
reads the term features and the probabilities of all earlier categories; in
training those are out-of-fold predictions, so a later model sees earlier
probabilities as uncertain as they are on new text.

Features are the presence of words and word beginnings (4 and 5 letters); all that
the labels of a category bear out (score test) are kept, however many, as sparse
rows. The models are fitted on at most `max_train` labelled ids, drawn by hash; one
row of an id that repeats stands for it, the first by a hash of its text. Every
whole text is scored.

A null or empty text has no features and gets the base rates. Labels that are
null or belong to no document are not used; conflicting labels of one id count
by majority. With no labels nothing is toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.linear import SparseRows, fit_sparse_logistic, sigmoid

MAX_TRAIN = 12_000
BUCKETS = 1 << 20
MIN_SCORE = 4.5
MIN_DOCS = 5
FOLDS = 3
RIDGE = 0.1
#: A worker forgets what it knows of words beyond this many.
MEMO = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def term_buckets(word: str) -> list[int]:
    return [zlib.crc32(f"{len(t) if t != word else 0}:{t}".encode("utf-8", "replace")) % BUCKETS
            for t in {word, *(word[:k] for k in (4, 5) if len(word) > k)}]


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    columns: dict[int, int]
    weights: tuple[np.ndarray, ...]

    def score(self, texts: pd.Series) -> np.ndarray:
        """Probabilities of all categories, one row per text."""
        rows, columns = [], []
        memo: dict[str, tuple[int, ...]] = {}
        for r, text in enumerate(texts):
            for word in set(_WORD.findall(text.lower())) if text else ():
                hit = memo.get(word)
                if hit is None:
                    if len(memo) >= MEMO:
                        memo.clear()
                    hit = memo[word] = tuple(self.columns[b] for b in term_buckets(word) if b in self.columns)
                rows += [r] * len(hit)
                columns += hit
        # a bucket of two words of a text counts once
        pairs = np.unique(np.array([rows, columns], np.int64).reshape(2, -1), axis=1)
        x = SparseRows(len(texts), len(self.columns), *pairs)
        for w in self.weights:
            x = x.with_column(sigmoid(x.dot(w)))
        return x.dense


def _sample(docs: DataFrame, labels: DataFrame, names: Sequence[str], max_train: int, id_col: str, text_col: str):
    """(features of each row as a flat array and its bounds, targets) of the labelled sample, on the driver."""
    some = (labels.groupBy("_id").agg(*[F.avg(n).alias(n) for n in names]).dropna()
            .orderBy(F.xxhash64("_id"), "_id").limit(max_train))

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({b for w in set(_WORD.findall(t.lower())) for b in term_buckets(w)}) if t else [])

    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(some), "_id")  # at most max_train ids, one row each
            .groupBy("_id").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"),
                                *[F.first(n).alias(n) for n in names])
            .select("_id", buckets("_text").alias("terms"), *names).toArrow().sort_by("_id"))
    terms = rows.column("terms").combine_chunks()
    flat = terms.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(terms.offsets.to_numpy(zero_copy_only=False))
    return flat, sizes, np.column_stack([np.asarray(rows.column(n)) >= 0.5 for n in names]).astype(float)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_train: int = MAX_TRAIN,
              id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """categories: name -> 0/1 column over labels, in chain order."""
    names = tuple(categories)
    known = labels.select(F.col(id_col).alias("_id"), *[c.cast("double").alias(n) for n, c in categories.items()])
    flat, sizes, y = _sample(docs, known.dropna(), names, max_train, id_col, text_col)
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    chosen: set[int] = set()
    docs_with = np.bincount(flat, minlength=BUCKETS).astype(float)
    for k in range(len(names)):
        rate = y[:, k].mean() if n else 0.0
        with_both = np.bincount(flat, weights=y[row, k], minlength=BUCKETS)
        spread = np.sqrt(np.maximum(docs_with * rate * (1 - rate), 1e-12))
        z = np.where(docs_with >= MIN_DOCS, (with_both - docs_with * rate) / spread, 0)
        chosen |= set(np.flatnonzero(np.abs(z) >= MIN_SCORE).tolist())
    columns = {b: i for i, b in enumerate(sorted(chosen))}
    place = np.full(BUCKETS, -1)
    place[list(columns)] = list(columns.values())
    on = place[flat] >= 0
    x = SparseRows(n, len(columns), row[on], place[flat][on])

    weights, fold = [], np.arange(n) % FOLDS
    for k in range(len(names)):
        held = np.zeros(n)
        weights.append(fit_sparse_logistic(x, y[:, k], RIDGE))
        for f in range(FOLDS):  # each from the weights of all rows, which are near its own
            if (fold == f).any() and (fold != f).any():
                apart = fit_sparse_logistic(x.part(fold != f), y[fold != f, k], RIDGE, start=weights[-1])
                held[fold == f] = sigmoid(x.part(fold == f).dot(apart))
        x = x.with_column(held)
    return Chain(names, columns, tuple(weights))


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5, target: str = "toxic",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, p_<category> of every category, and the decision on the target."""
    schema = ", ".join(f"p_{n} double" for n in chain.names)

    @F.pandas_udf(schema)
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(chain.score(texts), columns=[f"p_{n}" for n in chain.names])

    return (docs.select(F.col(id_col), probabilities(F.col(text_col)).alias("_p")).select(id_col, "_p.*")
            .withColumn(f"is_{target}", F.col(f"p_{target}") >= threshold))
