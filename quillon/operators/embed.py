"""Token embeddings: each distinct token is embedded once, then joined back.

The embedder is a plain function from texts to vectors, so that a pretrained
model can take its place. The one built in needs no files: hashed character
grams, each with a fixed random direction, averaged and scaled to length 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64, low: int = 2, high: int = 4) -> Embedder:
    def vector(gram: str) -> np.ndarray:
        seed = int.from_bytes(blake2b(gram.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).normal(size=dim)

    def embed(texts: list[str]) -> np.ndarray:
        known: dict[str, np.ndarray] = {}
        out = np.zeros((len(texts), dim), np.float32)
        for k, text in enumerate(texts):
            grams = [f"<{text}>"[i : i + n] for n in range(low, high + 1) for i in range(len(text) + 3 - n)] or [text]
            total = sum(known.setdefault(g, vector(g)) if g not in known else known[g] for g in grams)
            out[k] = total / max(np.linalg.norm(total), 1e-12)
        return out

    return embed


def embed_column(text: Column, embedder: Embedder, batch: int = 512) -> Column:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for lo in range(0, len(texts), batch) for v in embedder(texts[lo : lo + batch])]
            yield pd.Series(vectors, dtype=object)

    return run(text)


def embed_tokens(tokens: DataFrame, column: str = "value", embedder: Embedder | None = None) -> DataFrame:
    """tokens with their embedding. Distinct tokens are embedded once; Spark picks the join by the table's size."""
    ship(tokens.sparkSession)
    once = tokens.select(F.col(column).alias("__token")).distinct().withColumn("embedding", embed_column(F.col("__token"), embedder or hashing_embedder()))
    return tokens.join(once, F.col(column).eqNullSafe(F.col("__token")), "left").drop("__token")


def static_classifier(train: DataFrame, text: str, label: str = "label", embedder: Embedder | None = None, dim: int = 64, hidden: int = 32, max_iter: int = 100) -> tuple[PipelineModel, Column]:
    """A small perceptron on frozen embeddings, and the expression of the vectors it reads (as column features)."""
    ship(train.sparkSession)
    features = array_to_vector(embed_column(F.col(text), embedder or hashing_embedder(dim)))
    stage = MultilayerPerceptronClassifier(layers=[dim, hidden, 2], labelCol=label, featuresCol="features", maxIter=max_iter, seed=7)
    return Pipeline(stages=[stage]).fit(train.withColumn("features", features)), features
