"""Directory trees as tables: files with content hashes, read in parallel."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.languages import is_code_file
from quern.sources.ignore import default_ignored, ignored_by

#: Signs that Spark's readers would take for patterns in a path.
_PATTERN_SIGNS = re.compile(r"([\\{}\[\]*?])")


def _files(spark: SparkSession, root: str, patterns: list[str] | None, extra: tuple[str, ...], include_hidden: bool, code_only: bool, paths: list[str] | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    base = root.rstrip("/") + "/"
    if paths is None:
        files = reader.option("recursiveFileLookup", "true").load(root)
    else:
        files = reader.load([_PATTERN_SIGNS.sub(r"\\\1", base + p) for p in paths])
    kept = files.withColumn("rel", F.substr(F.col("path"), F.locate(base, F.col("path")) + F.lit(len(base))))
    kept = kept.filter(~default_ignored(F.col("rel"), extra, include_hidden))
    if patterns:
        kept = kept.filter(~ignored_by(F.col("rel"), patterns))
    return kept.filter(is_code_file(F.col("rel"))) if code_only else kept


def _state(root: str) -> list:
    return [F.lit(root.rstrip("/")).alias("repo_root"), F.col("rel").alias("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.unix_millis("modificationTime").alias("mtime_ms")]


def list_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, extra: tuple[str, ...] = (), include_hidden: bool = False, code_only: bool = False) -> DataFrame:
    """``repo_root, path, size, mtime, mtime_ms`` of the files below ``root``; no content is read."""
    return _files(spark, root, patterns, extra, include_hidden, code_only, None).select(*_state(root))


def scan_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, extra: tuple[str, ...] = (), include_hidden: bool = False, code_only: bool = False, with_content: bool = False, paths: list[str] | None = None) -> DataFrame:
    """``repo_root, path, size, mtime, mtime_ms, hash[, content]`` of the files below ``root``, or of ``paths`` there.

    Ignored files are filtered by their path before any content is read; without ``with_content``
    only the hash leaves the scan. ``mtime`` is in unix seconds. Content is text decoded as UTF-8.
    Symbolic links are read like the files they lead to, as Spark's file listing gives them.
    """
    kept = _files(spark, root, patterns, extra, include_hidden, code_only, paths)
    return kept.select(*_state(root), F.sha2("content", 256).alias("hash"), *([F.decode("content", "UTF-8").alias("content")] if with_content else []))
