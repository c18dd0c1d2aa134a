"""Scoring of answers against expected files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import contains_path, extract_paths


def score_answers(cases: DataFrame, results: DataFrame) -> DataFrame:
    """``test_case_id, mode, recall, precision, f1`` of every result.

    Expected are the files (found if any mentioned path contains it or is contained in it, without
    case) and the symbols (found if the output contains them). Precision is taken as recall where
    anything was found; failed runs score 0, as do cases without expectations.
    """
    expected = cases.select(F.col("id").alias("test_case_id"), F.coalesce("ground_truth.files", F.array().cast("array<string>")).alias("files"), F.coalesce("ground_truth.symbols", F.array().cast("array<string>")).alias("symbols"))
    joined = results.join(expected, "test_case_id").withColumn("paths", extract_paths(F.coalesce("output", F.lit(""))))
    found = F.size(F.filter("files", lambda f: contains_path(F.col("paths"), f))) + F.size(F.filter("symbols", lambda s: F.contains(F.coalesce(F.col("output"), F.lit("")), s)))
    total = F.size("files") + F.size("symbols")
    recall = F.when(F.col("success") & (total > 0), found / total).otherwise(F.lit(0.0))
    return joined.select("test_case_id", "mode", F.round(recall, 6).alias("recall"), F.round(recall, 6).alias("precision"), F.round(recall, 6).alias("f1"))


def summarize(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Per mode: runs, success rate, mean latency, tokens and cost, accuracy over answers that found
    anything, and over all."""
    joined = results.join(scores, ["test_case_id", "mode"])
    return joined.groupBy("mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"),
        F.round(F.avg("tokens_used"), 6).alias("avg_tokens"),
        F.round(F.sum("cost"), 6).alias("total_cost"),
        F.round(F.coalesce(F.avg(F.when((F.col("f1") > 0) | (F.col("recall") > 0), F.col("f1"))), F.lit(0.0)), 6).alias("accuracy"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
    )


def compare_modes(scores: DataFrame) -> DataFrame:
    """One row per case with the f1 of both modes and their difference."""
    wide = scores.groupBy("test_case_id").pivot("mode", ["with_tools", "without_tools"]).agg(F.first("f1"))
    return wide.select("test_case_id", F.coalesce("with_tools", F.lit(0.0)).alias("with_tools"), F.coalesce("without_tools", F.lit(0.0)).alias("without_tools")).withColumn("gain", F.round(F.col("with_tools") - F.col("without_tools"), 6))
