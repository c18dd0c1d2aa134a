"""Combining ranked lists: reciprocal rank fusion, weighted sums, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def with_rank(hits: DataFrame, source: str, score: str = "score", tie: str = "id") -> DataFrame:
    """One source's hits as a ranked list: ``id, source, score, rank`` (a bounded list of hits)."""
    w = W.orderBy(F.col(score).desc(), tie)
    return hits.select("id", F.lit(source).alias("source"), F.col(score).cast("double").alias("score"), F.row_number().over(w).alias("rank"))


def rrf(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``id, rrf_score, score, sources, n_sources`` from ``id, source, score, rank``.

    The sum of weight / (60 + rank); sources without a weight, or with weight 0, count as 1. The
    score is the best of an item; sources are kept with repetitions, in order. A map-side
    aggregated group-by on the item.
    """
    weight: Column = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(value) or 1.0)).otherwise(weight)
    grouped = lists.groupBy("id").agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 8).alias("rrf_score"), F.max("score").alias("score"), F.sort_array(F.collect_list("source")).alias("sources"))
    return grouped.withColumn("n_sources", F.size("sources"))


def top_fused(fused: DataFrame, n: int = 0, min_score: float = 0.0, min_sources: int = 1) -> DataFrame:
    """Filter fused results and keep the best ``n`` (all if 0), ties by score, sources and id."""
    kept = fused.filter((F.col("rrf_score") >= min_score) & (F.col("n_sources") >= min_sources))
    ordered = kept.orderBy(F.col("rrf_score").desc(), F.col("score").desc(), F.col("n_sources").desc(), "id")
    return ordered.limit(n) if n > 0 else kept


def hybrid_merge(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 0.6, semantic_weight: float = 0.4, keys: tuple[str, ...] = ("path", "start_line", "end_line")) -> DataFrame:
    """``keys, score, source``: weighted sum of keyword (flat) and semantic hits at the same place.

    Weights that are not positive fall back to 0.6 and 0.4.
    """
    kw = keyword_weight if keyword_weight > 0 else 0.6
    sw = semantic_weight if semantic_weight > 0 else 0.4
    both = keyword.select(*keys, F.lit(float(kw)).alias("s"), F.lit("keyword").alias("src")).unionByName(semantic.select(*keys, (F.lit(float(sw)) * F.col("score")).alias("s"), F.lit("semantic").alias("src")))
    merged = both.groupBy(*keys).agg(F.round(F.sum("s"), 6).alias("score"), F.sort_array(F.collect_set("src")).alias("srcs"))
    return merged.select(*keys, "score", F.when(F.size("srcs") > 1, "both").otherwise(F.col("srcs")[0]).alias("source"))


def rerank(candidates: DataFrame, scores: DataFrame, top_k: int, threshold: float = 0.0) -> DataFrame:
    """``id, place, rrf_score, reranked`` after rescoring the first ``top_k`` of ``id, place, rrf_score``.

    ``scores`` holds ``id, rerank_score`` of the candidates that have content. Rescored candidates
    come first by new score and are dropped below the threshold, then those of the head without
    content, then the tail, both in their old order. Candidates are a bounded list of hits.
    """
    head = F.col("place") <= top_k
    joined = candidates.join(scores, "id", "left")
    bucket = F.when(head & F.col("rerank_score").isNotNull(), 0).when(head, 1).otherwise(2)
    marked = joined.withColumn("bucket", bucket).filter((F.col("bucket") > 0) | (F.col("rerank_score") >= threshold))
    order = W.orderBy("bucket", F.when(F.col("bucket") == 0, -F.col("rerank_score")), "place", "id")
    return marked.select("id", F.row_number().over(order).alias("place"), F.when(F.col("bucket") == 0, F.col("rerank_score")).otherwise(F.col("rrf_score")).alias("rrf_score"), (F.col("bucket") == 0).alias("reranked"))
