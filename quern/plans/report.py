"""Reports of evaluation runs: saved, loaded and printed."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame

from quern.operators.evaluation import compare_modes, score_answers, summarize
from quern.sources.records import write_json


def evaluate(cases: DataFrame, results: DataFrame) -> dict:
    """Scores, comparison and summary of the results of all cases as plain records.

    Cases of an evaluation are few (people write them); the report is a document, not a table.
    """
    scores = score_answers(cases, results).cache()
    try:
        records = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]
        summary = records(summarize(results, scores), "mode")
        return {"summary": summary, "results": records(scores, "test_case_id", "mode"), "comparison": records(compare_modes(scores), "test_case_id"), "changes": _changes(summary)}
    finally:
        scores.unpersist()


def reduction(base: float, new: float) -> float:
    """By how many percent ``new`` is below ``base``; 0 for a base of 0."""
    return (base - new) / base * 100 if base else 0.0


def _changes(summary: list[dict]) -> dict:
    by = {r["mode"]: r for r in summary}
    if not {"with_tools", "without_tools"} <= set(by):
        return {}
    a, b = by["without_tools"], by["with_tools"]
    return {k: round(reduction(a[k] or 0, b[k] or 0), 3) for k in ("avg_duration_ms", "avg_tokens", "total_cost")} | {"accuracy": round(100 * (b["accuracy"] - a["accuracy"]), 3)}


def save(report: dict, folder: str) -> str:
    path = str(Path(folder) / time.strftime("report-%Y-%m-%d-%H%M%S.json", time.gmtime()))
    write_json(path, report)
    return path


def load(path: str) -> dict:
    return json.loads(Path(path).read_text())


def text(report: dict) -> str:
    """The summary as aligned lines."""
    lines = []
    for row in report["summary"]:
        lines.append(f"{row['mode']}: {row['runs']} runs, success {100 * row['success_rate']:.1f} %, accuracy {100 * row['accuracy']:.1f} %, {row['avg_duration_ms'] / 1000:.1f} s, {row['avg_tokens']:.0f} tokens, cost {row['total_cost']:.4f}")
    lines += [f"{k}: {v:+.1f} %" for k, v in report["changes"].items()]
    return "\n".join(lines)
