"""Which records a run has to process: the diff of two versions of a table of file states.

``known_manifest`` reduces an append-only index log to the state that successful runs committed,
``newest_manifest`` reduces scan logs to the newest scan. ``files_to_process`` makes both versions
of one table: files of states that are the same are in both manifests, changed and missing states
have deletion vectors, new ones are in added files. The diff of the manifests gives the record
deltas, and the sink saves the version it has processed in the commit of its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.functions.identity import whole_seconds
from quern.runtime import scratch_folder
from quern.sources.versioned import VersionedTable, net_changes, process


def latest_run_states(runs: DataFrame) -> DataFrame:
    """One row per run: ``run_id, repo_root, started_at, status`` of its row with the largest logged_at."""
    last = F.max_by(F.struct("repo_root", "started_at", "status"), F.struct(F.col("logged_at"), F.coalesce(F.col("finished_at"), F.lit(-1)), F.col("status")))
    return runs.filter("run_id is not null").groupBy("run_id").agg(last.alias("r")).select("run_id", "r.*")


def run_intervals(states: DataFrame) -> DataFrame:
    """The time in which each run is the newest started one of its repository: [started_at, ended_before)."""
    starts = states.filter("repo_root is not null and started_at is not null").groupBy("repo_root", "started_at").agg(F.max_by("status", "run_id").alias("status"))
    w = W.partitionBy("repo_root").orderBy("started_at")
    return starts.withColumn("ended_before", F.lead("started_at").over(w))


def known_manifest(files: DataFrame, runs: DataFrame, bucket_seconds: int = 7 * 86_400) -> DataFrame:
    """``repo_root, path, mtime, size``: of each file its newest row that a run of state ``ok`` wrote.

    A row belongs to the run of its repository with the largest started_at not after indexed_at.
    That as-of join runs on (repo_root, week): intervals are unrolled over the weeks they span, so
    a repository with a third of all rows is spread over its weeks instead of one task. Rows
    before the first run, and rows with null keys or indexed_at, have no state.
    """
    files = files.filter("repo_root is not null and path is not null and indexed_at is not null")
    bucket = lambda c: F.floor(c / bucket_seconds)
    last = files.agg(F.max("indexed_at").alias("__last"))
    spans = (
        run_intervals(latest_run_states(runs))
        .filter("status = 'ok'")
        .crossJoin(F.broadcast(last))  # one row
        .withColumn("__until", F.coalesce(F.col("ended_before") - 1, F.greatest("__last", "started_at")))
        .select("repo_root", "started_at", "__until", F.explode(F.sequence(bucket(F.col("started_at")), bucket(F.col("__until")))).alias("__bucket"))
    )
    rows = files.select("repo_root", "path", "indexed_at", whole_seconds(F.col("mtime")).alias("mtime"), "size", bucket(F.col("indexed_at")).alias("__bucket"))
    kept = rows.join(spans, ["repo_root", "__bucket"]).filter("indexed_at between started_at and __until")
    newest = F.max_by(F.struct("mtime", "size"), F.struct("indexed_at", "mtime", "size")).alias("s")
    return kept.groupBy("repo_root", "path").agg(newest).select("repo_root", "path", "s.mtime", "s.size")


def newest_manifest(scans: DataFrame) -> DataFrame:
    """``repo_root, path, mtime, size`` of the newest scan of each repository.

    A path seen more than once in a scan counts with its largest seen_at. Paths are first reduced
    to one row each; the newest scan of a repository is then found from those per-path maxima by
    a map-side aggregated group-by, so no repository passes through one task with all its rows.
    """
    scans = scans.filter("repo_root is not null and path is not null and scan_id is not null")
    newest = F.max_by(F.struct("mtime", "size"), F.struct("scan_id", "seen_at", "mtime", "size")).alias("s")
    paths = scans.select("repo_root", "path", "scan_id", "seen_at", whole_seconds(F.col("mtime")).alias("mtime"), "size").groupBy("repo_root", "path").agg(newest, F.max("scan_id").alias("__scan"))
    last = scans.groupBy("repo_root").agg(F.max("scan_id").alias("__scan"))
    return paths.join(last, ["repo_root", "__scan"]).select("repo_root", "path", "s.mtime", "s.size")


def files_to_process(files: DataFrame, runs: DataFrame, scans: DataFrame) -> DataFrame:
    """``repo_root, path, change`` of every file the next run must process.

    Depends only on committed state: rows that failed or running runs wrote are not known, so a
    repeated run gives the same rows until one of state ``ok`` has committed them. Repositories
    without any scan are left alone. Empty inputs give no rows (no scans) or all scanned paths as
    ``added`` (no files or runs). Both tables are written below the shared folder.
    """
    spark, keys = scans.sparkSession, ["repo_root", "path"]
    folder = scratch_folder(spark, "states")
    states, due = VersionedTable(spark, f"{folder}/states"), VersionedTable(spark, f"{folder}/due")
    scanned = scans.filter("repo_root is not null and scan_id is not null").select("repo_root").distinct()
    known = known_manifest(files, runs).join(scanned, "repo_root", "left_semi")
    due.mark({"processed:states": states.append(known)})  # what runs of state ok have processed
    states.replace(newest_manifest(scans).select(*known.columns), keys)
    process(states, due, lambda delta: net_changes(delta, keys), "states")
    found = due.read()
    return spark.createDataFrame([], "repo_root string, path string, change string") if found is None else found
