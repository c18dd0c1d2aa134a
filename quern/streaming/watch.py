"""Watching for changes: debounced sessions, routing, and incremental runs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery


def debounce(events: DataFrame, project: str, ts: str, gap: str) -> DataFrame:
    """``project, session_start, fire_at, events``: a trailing-edge debounce as session windows.

    Every event of a project within ``gap`` of the last one extends the session; it fires once, when
    the project has been quiet for ``gap``. Works on batches and, with a watermark, on streams.
    """
    grouped = events.groupBy(F.col(project).alias("project"), F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select("project", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("fire_at"), "events")


def route(events: DataFrame, projects: DataFrame, path: str) -> DataFrame:
    """``events`` with the ``project`` (first in registry order) whose directory holds the path.

    Instead of a theta join, the ancestors of each path are unrolled and joined by equality with
    the watched project paths (``project_path, ordinal``).
    """
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keyed = events.withColumn("__id", F.monotonically_increasing_id())
    hits = keyed.select("__id", F.explode(F.when(F.size(parts) > 1, ancestors)).alias("project_path")).join(projects.select("project_path", "ordinal"), "project_path")
    best = hits.groupBy("__id").agg(F.min_by("project_path", "ordinal").alias("project"))
    return keyed.join(best, "__id", "left").drop("__id")


def watch_limit(directories: DataFrame, project: str, directory: str, limit: int = 1000) -> DataFrame:
    """At most ``limit`` directories per project, in their order: a limit on watches."""
    w = W.partitionBy(project).orderBy(directory)
    return directories.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit).drop("__n")


def debounced_stream(events: DataFrame, project: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """The same sessions on a stream; rows later than ``late`` behind the newest are dropped."""
    return debounce(events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late), project, ts, gap)


def start_worker(sessions: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the indexing worker: ``run(batch, batch_id)`` for every micro-batch of due projects.

    ``run`` must be idempotent per ``batch_id``: after a failure the same batch is handed over again.
    """
    writer = sessions.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
