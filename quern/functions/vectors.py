"""Vector arithmetic as SQL expressions over ``array<float|double>`` columns; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot", "manhattan")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _same(a: Column, b: Column, value: Column, otherwise: float = 0.0) -> Column:
    """``value`` where both vectors have the same, non-zero length, else ``otherwise``."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value).otherwise(F.lit(otherwise))


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of unequal length."""
    return _same(a, b, _fold(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_fold(F.transform(_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unequal lengths and for zero vectors."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; 0 for unequal lengths."""
    return _same(a, b, F.sqrt(_fold(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of absolute differences; 0 for unequal lengths."""
    return _same(a, b, _fold(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y))))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(_double(v), lambda x: x / length)).otherwise(_double(v))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance of a metric: 1 - cosine, Euclidean, negative inner product or Manhattan."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "dot":
        return -dot(a, b)
    if metric == "manhattan":
        return manhattan(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def distance_to_score(d: Column, metric: str = "cosine", convention: str = "metric") -> Column:
    """Score of a distance: 1 - d (cosine), -d (dot) or 1 / (1 + d); ``inverse`` asks for the last always."""
    if convention == "inverse" or metric in ("euclidean", "manhattan"):
        return 1 / (1 + d)
    return -d if metric == "dot" else 1 - d


SQL_FUNCTIONS = {
    "vec_dot": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_l2": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vec_l1": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)",
}


def register_sql(spark) -> list[str]:
    """Make the metrics available to SQL as temporary functions that Catalyst inlines."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    return list(SQL_FUNCTIONS)
