"""Language identification with a string kernel.

k(x, y) counts the character n-grams (n = 1..4, hashed) that both texts contain,
over the geometric mean of their numbers: a blended-spectrum presence kernel.
Landmark texts span a Nystroem space in which one ridge regression per language
(targets 1 and -1) is solved. Its dual weights fold into one matrix over
n-grams, so that a batch of texts is scored by one matrix product.

Training rows are drawn per language by hash of the id, at most `per_lang` of
each; of those `landmarks` are spread evenly. Language, source and id are never
inputs. A text that is null or has no letter is `und` with score 0; without
training rows every text is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_LANG, LANDMARKS = 256, 256
ORDERS, BITS = 4, 16
RIDGE = 0.1
ROWS_PER_PRODUCT = 32
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str) -> np.ndarray:
    """Hash buckets of all n-grams; what is not a letter reads as a blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c = np.where((c < 128) & ((c < 97) | (c > 122)), np.uint64(32), c)
    h, out = np.zeros(len(c), np.uint64), []
    for n in range(ORDERS):
        if len(c) <= n:
            break
        h = (h[:len(c) - n] + c[n:] + np.uint64(n)) * _MIX
        out.append(((h ^ (h >> np.uint64(31))) >> np.uint64(64 - BITS - 8)) & np.uint64((1 << BITS) - 1))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def presence(texts) -> np.ndarray:
    """Rows of unit length, one for each text."""
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for r, text in enumerate(texts):
        x[r, ngrams(text)] = 1
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    weights: np.ndarray

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        rows = [r for r, t in enumerate(texts) if t is not None and self.langs and _LETTER.search(t)]
        for i in range(0, len(rows), ROWS_PER_PRODUCT):
            part = rows[i:i + ROWS_PER_PRODUCT]
            f = presence([texts.iloc[r] for r in part]) @ self.weights
            for r, best, top in zip(part, f.argmax(axis=1), f.max(axis=1)):
                lang[r], score[r] = self.langs[best], min(1.0, max(0.0, (float(top) + 1) / 2))
        return pd.DataFrame({"lang_pred": lang, "score": score})


def fit_languages(docs: DataFrame, trainable: Column, per_lang: int = PER_LANG, landmarks: int = LANDMARKS,
                  id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most per_lang rows of each language among the trainable rows."""
    rows = docs.filter(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    h = F.xxhash64(F.col(id_col))
    # the row of least hash in each of per_lang hash classes: a grouped minimum, combined before the shuffle
    picked = (rows.groupBy(F.col(lang_col).alias("_lang"), F.pmod(h, F.lit(per_lang)).alias("_class"))
              .agg(F.min_by(F.col(id_col), F.struct(h, F.col(id_col))).alias("_id")).select("_id", "_lang"))
    ids = sorted({r["_id"] for r in picked.collect() if r["_id"] is not None})  # per_lang x languages at most
    if not ids:
        return LanguageModel((), np.empty((1 << BITS, 0), np.float32))
    some = rows.sparkSession.createDataFrame([(i,) for i in ids], f"_id {docs.schema[id_col].dataType.simpleString()}")
    found = (rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
             .join(F.broadcast(some), "_id").dropDuplicates(["_id"]).toPandas())
    found = found[found["_text"].map(lambda t: bool(_LETTER.search(t)))].sort_values("_id").reset_index(drop=True)
    langs = tuple(sorted(set(found["_lang"])))
    if not langs:
        return LanguageModel((), np.empty((1 << BITS, 0), np.float32))
    marks = presence(list(found["_text"].iloc[np.unique(np.linspace(0, len(found) - 1, landmarks).astype(int))]))
    gram = np.zeros((len(marks), len(marks)))
    answer = np.zeros((len(marks), len(langs)))
    for i in range(0, len(found), ROWS_PER_PRODUCT):
        part = found.iloc[i:i + ROWS_PER_PRODUCT]
        k = (presence(list(part["_text"])) @ marks.T).astype(float)
        y = np.where(part["_lang"].to_numpy()[:, None] == np.array(langs, object)[None, :], 1.0, -1.0)
        gram += k.T @ k
        answer += k.T @ y
    inner = (marks @ marks.T).astype(float)
    dual = np.linalg.solve(gram + RIDGE * inner + 1e-6 * np.eye(len(marks)), answer)
    return LanguageModel(langs, (marks.T @ dual).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
                     *more: Column) -> DataFrame:
    """One row per input row: id, any further columns asked for, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # n-gram buckets x languages

    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        return held.value.predict(texts)

    return docs.select(F.col(id_col), *more, language(F.col(text_col)).alias("_p")).select("*", "_p.*").drop("_p")
