"""Stored forms of vectors: JSON text and little-endian float32 bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector_to_json(vector: Column) -> Column:
    return F.to_json(vector)


def vector_from_json(text: Column) -> Column:
    """The vector a JSON array holds; null for malformed text and for arrays with nulls."""
    parsed = F.from_json(text, "array<float>")
    return F.when(~F.exists(parsed, lambda x: x.isNull()), parsed)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vector_from_bytes(blobs: pd.Series) -> pd.Series:
    """The vector of float32 bytes; null where the length is no multiple of four."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4") if b is not None and len(b) % 4 == 0 else None)


@F.pandas_udf(T.BinaryType())
def vector_to_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes() if v is not None else None)
