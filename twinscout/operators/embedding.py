"""Titles to vectors through an encoder the caller supplies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Titles per encoder call.
BATCH = 128

_RESULT = T.StructType(
    [
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("error", T.StringType()),
    ]
)


def embed_batches(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]],
    width: int,
    title: str = "title",
    batch_size: int = BATCH,
) -> DataFrame:
    """Add ``vector`` and ``embed_error`` for every row's title.

    ``make_encoder`` runs once per Python worker and returns a function from an array of
    texts to a matrix of ``width`` columns.  A failing batch gives null vectors and the
    error text; its rows stay.
    """

    def make_predict():
        encode = make_encoder()

        def predict(texts: np.ndarray) -> dict[str, np.ndarray]:
            try:
                vectors = np.asarray(encode(texts), dtype=np.float32).reshape(len(texts), width)
                errors = [""] * len(texts)
            except Exception as error:  # noqa: BLE001 - any encoder failure is reported
                vectors = np.zeros((len(texts), width), dtype=np.float32)
                errors = [f"{type(error).__name__}: {error}"] * len(texts)
            return {"vector": vectors, "error": np.array(errors, dtype=object)}

        return predict

    encoder = predict_batch_udf(make_predict, return_type=_RESULT, batch_size=batch_size)
    encoded = df.withColumn("_encoded", encoder(F.coalesce(title, F.lit(""))))
    failed: Column = F.col("_encoded.error") != ""
    return (
        encoded.withColumn("vector", F.when(~failed, F.col("_encoded.vector")))
        .withColumn("embed_error", F.when(failed, F.col("_encoded.error")))
        .drop("_encoded")
    )


def letter_counts() -> Callable[[np.ndarray], np.ndarray]:
    """A small encoder for trials and tests: how often each letter a-z occurs."""

    def encode(texts: np.ndarray) -> np.ndarray:
        rows = [[text.count(chr(97 + i)) for i in range(26)] for text in texts]
        return np.array(rows, dtype=np.float32)

    return encode
