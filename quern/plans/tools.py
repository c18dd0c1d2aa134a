"""The query tools by name: argument checks, defaults, and answers as rows.

Each tool takes a session, a data directory or an index, and its arguments; errors of use raise
``ToolError``, a missing index answers ``{"available": False, "error": ...}``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import line_slice
from quern.operators import fusion
from quern.operators.search import find_symbol, search_keyword
from quern.plans.indexer import Indexer
from quern.sources.tree import scan_tree


class ToolError(ValueError):
    """Wrong arguments of a tool."""


def _need(value: str | None, name: str) -> str:
    if not value:
        raise ToolError(f"{name} is required")
    return value


def _files(index: Indexer) -> DataFrame:
    return scan_tree(index.spark, index.root, with_content=True)


def keyword(index: Indexer, query: str = "", top_k: int = 20) -> list[dict]:
    return [r.asDict() for r in search_keyword(_files(index), _need(query, "query"), "path", "content", top_k).collect()]


def get_file(index: Indexer, path: str = "", start_line: int = 0, end_line: int = 0) -> dict:
    rows = _files(index).filter(F.col("path") == _need(path, "path")).select(line_slice(F.col("content"), start_line, end_line).alias("content")).collect()
    if not rows or rows[0]["content"] is None:
        raise ToolError("no such file" if not rows else "start is beyond the end of the file")
    return {"path": path, "content": rows[0]["content"]}


def _symbols(index: Indexer) -> DataFrame | None:
    places = index.locations.read()
    return None if places is None else places.filter("node_name <> ''").select(F.col("node_name").alias("name"), F.col("node_type").alias("kind"), "path", F.col("start_line").alias("line"), "language", F.xxhash64("path", "start_line", "node_name").alias("id"))


def symbol(index: Indexer, name: str = "", kind: str | None = None, limit: int = 50) -> list[dict] | dict:
    table = _symbols(index)
    if table is None:
        return {"available": False, "error": "no index"}
    return [r.asDict() for r in find_symbol(table, _need(name, "name"), kind, limit).collect()]


def definitions(index: Indexer, path: str = "") -> list[dict] | dict:
    table = _symbols(index)
    if table is None:
        return {"available": False, "error": "no index"}
    return [r.asDict() for r in table.filter(F.col("path") == _need(path, "path")).orderBy("line").collect()]


def semantic(index: Indexer, query: str = "", limit: int = 10) -> list[dict] | dict:
    found = index.search(_need(query, "query"), limit)
    return {"available": False, "error": "no index"} if found is None else [r.asDict() for r in found.collect()]


def hybrid(index: Indexer, query: str = "", limit: int = 20) -> list[dict]:
    """Keyword, vector and symbol hits fused by weighted reciprocal rank; a failing signal is left out."""
    _need(query, "query")
    lists = []
    hits = search_keyword(_files(index), query, "path", "content", limit).select(F.concat_ws(":", "path", "line").alias("id"), "score")
    lists.append(fusion.with_rank(hits, "keyword"))
    near = index.search(query, limit)
    if near is not None:
        lists.append(fusion.with_rank(near.select(F.concat_ws(":", "path", "start_line", "end_line").alias("id"), "score"), "semantic"))
        table = find_symbol(_symbols(index), query, limit=max(1, limit // 2))
        lists.append(fusion.with_rank(table.select(F.concat_ws(":", "path", "line", "name").alias("id"), (10.0 - F.col("match_rank")).alias("score")), "symbol"))
    union = lists[0]
    for part in lists[1:]:
        union = union.unionByName(part)
    fused = fusion.top_fused(fusion.rrf(union, {"keyword": 0.3, "semantic": 0.5, "symbol": 0.2}), limit)
    return [r.asDict() for r in fused.collect()]


TOOLS: dict[str, Callable] = {"search_keyword": keyword, "get_file": get_file, "find_symbol": symbol, "list_defs_in_file": definitions, "search_semantic": semantic, "hybrid_search": hybrid, "hybrid_search_v2": hybrid}
