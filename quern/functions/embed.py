"""Embedders: turn texts into vectors, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|\d+")


class Embedder(Protocol):
    """What the indexing plans need of a model."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic vectors of hashed words, for use without a model: equal words, near vectors."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"hashing-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for n, text in enumerate(texts):
            for token in _TOKEN.findall(text):
                h = zlib.crc32(token.lower().encode())
                out[n, h % self.dimensions] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, embedder: Embedder, key: str, text: str) -> DataFrame:
    """``key, embedding, model, dimensions`` for every row; one call of the model per Arrow batch."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = embedder.embed(batch[text].fillna("").tolist())
            yield pd.DataFrame({key: batch[key], "embedding": list(vectors), "model": embedder.name, "dimensions": embedder.dimensions})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>, model string, dimensions int")
