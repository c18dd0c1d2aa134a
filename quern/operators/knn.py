"""Exact nearest-neighbour search: with one query vector in the JVM, with a set of queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions import vectors as V


def knn(vectors: DataFrame, query: DataFrame | list[float], id_col: str, vector_col: str, k: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """``id, distance, score``: the ``k`` nearest rows to a vector, or to the one row of a DataFrame (column ``q``).

    Distances are rounded to 6 digits and ties go to the smaller id, so the order is total. A list
    becomes a literal of the scan, a DataFrame is one row and broadcast; either plan ends in
    TakeOrderedAndProject, no full sort. A filter is applied before the search. Null vectors are
    skipped; ``k`` below 1 and an empty query give no rows.
    """
    rows = (vectors if where is None else vectors.filter(where)).filter(F.col(vector_col).isNotNull())
    if isinstance(query, DataFrame):
        rows = rows.crossJoin(F.broadcast(query.select(F.col("q").alias("__q"))))  # one row
    else:
        rows = rows.withColumn("__q", F.lit([float(x) for x in query])) if query else rows.limit(0).withColumn("__q", F.col(vector_col))
    scored = rows.select(F.col(id_col).alias("id"), F.round(V.distance(F.col(vector_col), F.col("__q"), metric), 6).alias("distance"))
    return scored.orderBy("distance", "id").limit(max(k, 0)).select("id", "distance", F.round(V.distance_to_score(F.col("distance"), metric), 6).alias("score"))


def query_vector(vectors: DataFrame, id_col: str, vector_col: str, value) -> list[float]:
    """The vector of one row, fetched to be the literal of a search; empty if there is none."""
    row = vectors.filter((F.col(id_col) == F.lit(value)) & F.col(vector_col).isNotNull()).select(vector_col).first()
    return [float(x) for x in row[0]] if row else []


def distances(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every query (rows) to every base vector (columns), as ``functions.vectors.distance``."""
    if metric == "cosine":
        scale = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(base, axis=1)[None, :]
        return 1 - np.divide(queries @ base.T, scale, out=np.zeros((len(queries), len(base))), where=scale > 0)
    if metric == "dot":
        return -(queries @ base.T)
    if metric == "euclidean":
        return np.stack([np.sqrt(((base - q) ** 2).sum(1)) for q in queries])
    if metric == "manhattan":
        return np.stack([np.abs(base - q).sum(1) for q in queries])
    raise ValueError(f"metric must be one of {V.METRICS}")


def _packed(df: DataFrame, id_col: str, vector_col: str, prefix: str, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of the same length as one row each."""
    kind = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["v"].value_lengths())
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                for n in range(0, len(at), rows):
                    own = batch.take(pa.array(at[n : n + rows]))
                    matrix = np.asarray(own["v"].flatten(), np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([own["i"].to_pylist()], pa.list_(batch.schema.field("i").type)), pa.array([int(size)], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], names=[f"{prefix}ids", f"{prefix}size", f"{prefix}vectors"])

    given = df.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).filter("i is not null and v is not null")
    return given.mapInArrow(pack, f"{prefix}ids array<{kind}>, {prefix}size int, {prefix}vectors binary")


def knn_many(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10, metric: str = "cosine", where: Column | None = None, block: int = 2_048) -> DataFrame:
    """``query, id, distance, score``: the ``k`` nearest rows of every row of ``queries`` (``id_col, vector_col``).

    Both sides are packed into blocks; every pair of blocks is one product of matrices whose best
    ``k`` per query leave the task, so nothing grows with queries times rows. Distances are rounded to 6
    digits, ties go to the smaller id. Vectors of another length than the query's are not near it;
    null and empty vectors and null ids are skipped. A row is near itself if it is on both sides.
    """
    base = _packed(vectors if where is None else vectors.filter(where), id_col, vector_col, "b", block)
    asked = _packed(queries, id_col, vector_col, "q", block)
    kind = vectors.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size = row["qsize"]
                q, b = (np.frombuffer(row[c], np.float64).reshape(-1, size) for c in ("qvectors", "bvectors"))
                far = np.round(distances(q, b, metric), 6)
                ids = np.array(row["bids"], object if isinstance(row["bids"][0], str) else None)
                order = np.argsort(ids, kind="stable")
                far = far[:, order]
                first = np.argsort(far, axis=1, kind="stable")[:, : max(k, 0)]
                asked_by = np.repeat(np.arange(len(q)), first.shape[1])
                kinds = batch.schema.field("bids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(row["qids"], kinds).take(pa.array(asked_by)), pa.array(row["bids"], kinds).take(pa.array(order[first.ravel()])), pa.array(far[asked_by, first.ravel()] + 0.0)], names=["query", "id", "distance"])

    # blocks of a stated query set against blocks of all rows
    pairs = base.crossJoin(asked).filter("qsize = bsize").select("qids", "qsize", "qvectors", "bids", "bvectors")
    found = pairs.mapInArrow(compare, f"query {kind}, id {kind}, distance double")
    w = W.partitionBy("query").orderBy("distance", "id")
    best = found.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")
    return best.withColumn("score", F.round(V.distance_to_score(F.col("distance"), metric), 6))
