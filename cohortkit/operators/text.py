"""Text -> fixed-width vector.

Default encoder: Unicode-aware tokens of the whole text -> HashingTF(width)
-> IDF fitted on training rows. All JVM-side ML stages, so it persists in a
PipelineModel and scales with the table. NULL text gives the zero vector.

A pluggable encoder (for example an ONNX sentence model) runs through
``mapInPandas``: Arrow batches, the model loaded once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

# Text vector width of the study.
TEXT_WIDTH = 768
TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def hashing_text_encoder(text_col: str, output_col: str, width: int = TEXT_WIDTH) -> Pipeline:
    """Unfitted encoder pipeline for one text column."""
    tmp = f"__{output_col}"
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, coalesce(`{text_col}`, '') AS `{tmp}_t` FROM __THIS__"),
        RegexTokenizer(inputCol=f"{tmp}_t", outputCol=f"{tmp}_tok", pattern=TOKEN_PATTERN, toLowercase=True),
        HashingTF(inputCol=f"{tmp}_tok", outputCol=f"{tmp}_tf", numFeatures=width),
        IDF(inputCol=f"{tmp}_tf", outputCol=output_col),
        SQLTransformer(statement=f"SELECT * EXCEPT (`{tmp}_t`, `{tmp}_tok`, `{tmp}_tf`) FROM __THIS__"),
    ])


def fit_text_encoder(train: DataFrame, text_col: str, output_col: str, width: int = TEXT_WIDTH) -> PipelineModel:
    return hashing_text_encoder(text_col, output_col, width).fit(train)


def embed_text(df: DataFrame, text_col: str, output_col: str, model: PipelineModel | None = None,
               width: int = TEXT_WIDTH) -> DataFrame:
    """Embed ``text_col`` (fits the default encoder on ``df`` when no model is given)."""
    model = model or fit_text_encoder(df, text_col, output_col, width)
    return model.transform(df)


def embed_with_batch_encoder(df: DataFrame, text_col: str, output_col: str,
                             load_encoder: Callable[[], Callable[[list], np.ndarray]], width: int) -> DataFrame:
    """Embed with a user encoder ``load_encoder() -> encode(list[str]) -> (n, width)``.

    The loader runs once per Python worker; batches arrive through Arrow. NULL
    text maps to the zero vector without calling the encoder.
    """
    out_schema = StructType(df.schema.fields + [StructField(output_col, ArrayType(FloatType()), False)])
    cache = {}

    def run(batches):
        if "enc" not in cache:
            cache["enc"] = load_encoder()
        enc = cache["enc"]
        for pdf in batches:
            texts = pdf[text_col]
            vecs = np.zeros((len(pdf), width), dtype=np.float32)
            mask = texts.notna().to_numpy()
            if mask.any():
                vecs[mask] = np.asarray(enc(texts[mask].tolist()), dtype=np.float32)
            pdf[output_col] = pd.Series(list(vecs))
            yield pdf

    return df.mapInPandas(run, out_schema)

