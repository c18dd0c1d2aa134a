"""Queries on references between tables (problem 3) and on what the next run must process (problem 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.identity import canonical_hash, canonical_path, month_of
from quern.operators.increments import files_to_process
from quern.operators.references import orphan_references, orphan_report
from quern.runtime import read_table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_table, ref_key, ref_target, period`` of all references that lead nowhere."""
    locations = read_table(spark, sf_dir, "chunk_locations").select("id", canonical_hash(F.col("content_hash")).alias("hash"), "created_at")
    cache = read_table(spark, sf_dir, "embedding_cache").select("content_hash", canonical_hash(F.col("content_hash")).alias("hash"), "created_at")
    root = F.col("repo_root")
    place = F.when(root != "", F.regexp_replace(root, r"/+$", "")).alias("root"), canonical_path(F.col("path"), root).alias("place")
    symbols = read_table(spark, sf_dir, "symbols").select("id", *place, "indexed_at")
    files = read_table(spark, sf_dir, "files").select(*place)
    cached = cache.groupBy("content_hash", "hash").agg(F.min("created_at").alias("created_at"))
    found = [
        orphan_references(locations, cache, ["hash"]).select(F.lit("chunk_locations").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), F.col("hash").alias("ref_target"), month_of(F.col("created_at")).alias("period")),
        orphan_references(symbols, files, ["root", "place"]).select(F.lit("symbols").alias("ref_table"), F.col("id").cast("string").alias("ref_key"), F.concat_ws("/", "root", "place").alias("ref_target"), month_of(F.col("indexed_at")).alias("period")),
        orphan_references(cached, locations, ["hash"]).select(F.lit("embedding_cache").alias("ref_table"), F.col("content_hash").alias("ref_key"), F.col("hash").alias("ref_target"), month_of(F.col("created_at")).alias("period")),
    ]
    return reduce(DataFrame.unionByName, found)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_key")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_to_process(*(read_table(spark, sf_dir, t) for t in ("files", "index_runs", "disk_scans")))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("repo_root", "change").agg(F.count(F.lit(1)).alias("files"))


_HASH = r"nullif(regexp_replace(regexp_replace(lower(regexp_replace({0}, '\s+', '', 'g')), '^([a-z][a-z0-9_-]*:|0x)', ''), '^0+([0-9a-f]+)$', '\1'), '')"
_PLACE = r"nullif(array_to_string(list_filter(string_split(replace({0}, '\', '/'), '/'), lambda x: x <> '' and x <> '.'), '/'), '')"
_MONTH = "coalesce(strftime(to_timestamp({0}) at time zone 'UTC', '%Y-%m'), 'unknown')"
_ROOT = "nullif(regexp_replace(repo_root, '/+$', ''), '')"

_ORPHANS = f"""
with locations as (select id, {_HASH.format("content_hash")} as hash, created_at from chunk_locations),
cached as (select content_hash, {_HASH.format("content_hash")} as hash, min(created_at) as created_at from embedding_cache group by 1, 2),
places as (select distinct {_ROOT} as root, {_PLACE.format("path")} as place from files),
syms as (select id, {_ROOT} as root, {_PLACE.format("path")} as place, indexed_at from symbols),
orphans as (
  select 'chunk_locations' as ref_table, id::varchar as ref_key, hash as ref_target, {_MONTH.format("created_at")} as period from locations l
  where hash is not null and not exists (select 1 from cached c where c.hash = l.hash)
  union all
  select 'symbols', id::varchar, root || '/' || place, {_MONTH.format("indexed_at")} from syms s
  where root is not null and place is not null and not exists (select 1 from places p where p.root = s.root and p.place = s.place)
  union all
  select 'embedding_cache', content_hash, hash, {_MONTH.format("created_at")} from cached c
  where hash is not null and not exists (select 1 from locations l where l.hash = c.hash)
)
"""

_SECONDS = "case when abs({0}) >= 100000000000 then {0} // 1000 else {0} end"
_CHANGES = f"""
with states as (select run_id, arg_max(repo_root, logged_at) as repo_root, arg_max(started_at, logged_at) as started_at, arg_max(status, logged_at) as status from index_runs group by 1),
written as (select f.*, (select arg_max(s.status, s.started_at) from states s where s.repo_root = f.repo_root and s.started_at <= f.indexed_at) as status from files f),
known as (select repo_root, path, arg_max({_SECONDS.format("mtime")}, indexed_at) as mtime, arg_max(size, indexed_at) as size from written where status = 'ok' group by 1, 2),
newest as (select repo_root, max(scan_id) as scan_id from disk_scans group by 1),
seen as (select repo_root, path, arg_max({_SECONDS.format("mtime")}, seen_at) as mtime, arg_max(size, seen_at) as size from disk_scans join newest using (repo_root, scan_id) group by 1, 2),
changes as (
  select s.repo_root, s.path, 'added' as change from seen s where not exists (select 1 from known k where k.repo_root = s.repo_root and k.path = s.path)
  union all
  select s.repo_root, s.path, 'modified' from seen s join known k using (repo_root, path) where s.mtime <> k.mtime or s.size <> k.size
  union all
  select k.repo_root, k.path, 'deleted' from known k join newest n using (repo_root) where not exists (select 1 from seen s where s.repo_root = k.repo_root and s.path = k.path)
)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p5_found": p5_found, "p5_counts": p5_counts}

SQL = {
    "p3_found": _ORPHANS + "select ref_table, ref_key from orphans",
    "p3_report": _ORPHANS + "select ref_table, period, count(*) as orphans, count(distinct ref_target) as distinct_targets from orphans group by 1, 2",
    "p5_found": _CHANGES + "select repo_root, path, change from changes",
    "p5_counts": _CHANGES + "select repo_root, change, count(*) as files from changes group by 1, 2",
}
