"""Queries on stores: upserts, cache, locations, migration, Merkle trees, streaming, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.identity import canonical_hash
from quern.functions.languages import canonical_language
from quern.operators import evaluation, merkle, store
from quern.operators.increments import known_manifest, newest_manifest
from quern.queries.integrity import _CHANGES, _HASH
from quern.runtime import read_table
from quern.streaming import watch

NOW, REPO = 1_760_000_000, "/work/repos/monolith"


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


def _file_state(spark, sf_dir):
    """The newest state row of every file."""
    best = F.max_by(F.struct("mtime", "size", "indexed_at"), F.struct("indexed_at", "mtime", "size"))
    return _t(spark, sf_dir, "files").groupBy("repo_root", "path").agg(best.alias("s")).select("repo_root", "path", "s.*")


def _scanned(spark, sf_dir):
    return newest_manifest(_t(spark, sf_dir, "disk_scans")).withColumn("indexed_at", F.lit(NOW).cast("bigint"))


def upsert_replace(spark, sf_dir):
    return store.upsert_replace(_file_state(spark, sf_dir), _scanned(spark, sf_dir), ["repo_root", "path"])


def upsert_update_cols(spark, sf_dir):
    return store.upsert_columns(_file_state(spark, sf_dir), _scanned(spark, sf_dir), ["repo_root", "path"], ["mtime", "size"])


_FIRST = ("created_at", "access_count", "last_accessed")


def _cache(spark, sf_dir):
    """The first row of every hash."""
    return store.keep_last(_t(spark, sf_dir, "embedding_cache"), ["content_hash"], [F.col(c) for c in _FIRST])


def cache_put_merge(spark, sf_dir):
    entries = _t(spark, sf_dir, "embedding_cache").select("content_hash", "embedding", "model", "dimensions")
    fresh = _t(spark, sf_dir, "chunks").filter("content_hash is not null").select("content_hash", F.lit(None).cast("array<float>").alias("embedding"), F.lit("new").alias("model"), F.lit(8).alias("dimensions")).distinct()
    return store.cache_put(_cache(spark, sf_dir), entries.unionByName(fresh), NOW).select("content_hash", "model", "dimensions", "created_at", "access_count", "last_accessed")


def _asked(spark, sf_dir):
    return _t(spark, sf_dir, "chunk_locations").select(canonical_hash(F.col("content_hash")).alias("key")).filter("key is not null").distinct()


def cache_get_batch(spark, sf_dir):
    rows = _cache(spark, sf_dir).withColumn("key", canonical_hash(F.col("content_hash")))
    return rows.filter("embedding is not null").join(_asked(spark, sf_dir), "key", "left_semi").select("content_hash", "model", "dimensions")


def cache_has_batch(spark, sf_dir):
    known = _t(spark, sf_dir, "embedding_cache").select(canonical_hash(F.col("content_hash")).alias("key")).distinct().withColumn("known", F.lit(True))
    return _asked(spark, sf_dir).join(known, "key", "left").select("key", F.coalesce("known", F.lit(False)).alias("known"))


def cache_evict_lru(spark, sf_dir):
    return store.evict_lru(_cache(spark, sf_dir), 200).select("content_hash", "last_accessed")


def cache_evict_model(spark, sf_dir):
    return _t(spark, sf_dir, "embedding_cache").filter("model <> 'lark-code-48'").groupBy("model").agg(F.count(F.lit(1)).alias("kept"))


def cache_access_rollup(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_access"))


def cache_stats(spark, sf_dir):
    return store.table_stats(
        _t(spark, sf_dir, "embedding_cache"), entries=F.count(F.lit(1)), hashes=F.countDistinct("content_hash"), avg_access=F.round(F.avg("access_count"), 6), min_access=F.min("access_count"),
        max_access=F.max("access_count"), total_access=F.sum("access_count"), oldest=F.min("created_at"), newest=F.max("created_at"),
    )


def embed_cache_split(spark, sf_dir):
    split = store.embed_split(_t(spark, sf_dir, "chunks").select("chunk_id", "content", "content_hash"), _t(spark, sf_dir, "embedding_cache"))
    return split.groupBy("action").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("content_hash").alias("hashes"))


def incremental_changed_files(spark, sf_dir):
    hashed = lambda t: _t(spark, sf_dir, t).select("repo_root", "path", canonical_hash(F.col("content_hash")).alias("h")).filter("h is not null")
    return store.changed_files(hashed("chunk_locations"), hashed("chunks"), ["repo_root", "path"], "h")


def orphaned_hashes(spark, sf_dir):
    cached = _t(spark, sf_dir, "embedding_cache").select(canonical_hash(F.col("content_hash")).alias("key")).filter("key is not null").distinct()
    return cached.join(_asked(spark, sf_dir), "key", "left_anti")


def _synced(spark, sf_dir):
    return store.sync(_t(spark, sf_dir, "embedding_cache"), _t(spark, sf_dir, "chunks"), "content_hash")


def vec_sync_missing(spark, sf_dir):
    return _synced(spark, sf_dir)[0]


def vec_sync_stale(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


_PLACE = ["repo_root", "path", "start_line", "end_line"]


def migrate_skip_existing(spark, sf_dir):
    source, target = (_t(spark, sf_dir, t).select(*_PLACE).distinct() for t in ("chunks", "chunk_locations"))
    marked = source.join(target.withColumn("there", F.lit(1)), _PLACE, "left")
    return marked.groupBy("repo_root").agg(F.count(F.lit(1)).alias("total"), F.count("there").alias("skipped"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("migrated"))


def migration_validate(spark, sf_dir):
    """Hashes with two rows: whether dimensions and the first ten values agree within 1e-4."""
    from pyspark.sql import Window as W

    w = W.partitionBy("content_hash").orderBy(*[F.col(c) for c in _FIRST])
    numbered = _t(spark, sf_dir, "embedding_cache").filter("embedding is not null").withColumn("n", F.row_number().over(w))
    a = numbered.filter("n = 1").select("content_hash", F.col("embedding").alias("a"), F.col("dimensions").alias("da"))
    b = numbered.filter("n = 2").select("content_hash", F.col("embedding").alias("b"), F.col("dimensions").alias("db"))
    close = F.forall(F.zip_with(F.slice("a", 1, 10), F.slice("b", 1, 10), lambda x, y: F.abs(x.cast("double") - y.cast("double")) <= 1e-4), lambda x: F.coalesce(x, F.lit(False)))
    return a.join(b, "content_hash").select("content_hash", ((F.col("da") == F.col("db")) & close).alias("valid"))


def embeddings_by_repo(spark, sf_dir):
    places = _t(spark, sf_dir, "chunk_locations").filter(F.col("repo_root") == REPO).select("id", "path", "start_line", canonical_hash(F.col("content_hash")).alias("key"))
    rows = _cache(spark, sf_dir).select(canonical_hash(F.col("content_hash")).alias("key"), "content_hash", "model")
    return places.join(rows, "key").select("id", "path", "start_line", "content_hash", "model").orderBy("path", "start_line", "id")


def cross_repo_scan(spark, sf_dir):
    locations = _t(spark, sf_dir, "chunk_locations")
    first = locations.agg(F.min("repo_root").alias("m"))
    return locations.crossJoin(F.broadcast(first)).filter((F.col("repo_root") == REPO) | (F.col("repo_root") == F.col("m"))).select("id", "repo_root", "path", "start_line").orderBy("repo_root", "path", "start_line", "id")


def locations_by_hash(spark, sf_dir):
    """The locations of the hash that has the most."""
    keyed = _t(spark, sf_dir, "chunk_locations").withColumn("key", canonical_hash(F.col("content_hash"))).filter("key is not null")
    top = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key").limit(1)
    return keyed.join(F.broadcast(top), "key").select("key", "id", "repo_root", "path", "start_line")


def distinct_hashes(spark, sf_dir):
    return _t(spark, sf_dir, "chunk_locations").filter("content_hash <> ''").select("repo_root", "content_hash").distinct()


def list_paths(spark, sf_dir):
    return _t(spark, sf_dir, "chunk_locations").select("repo_root", "path").distinct()


def location_stats(spark, sf_dir):
    return _t(spark, sf_dir, "chunk_locations").groupBy("repo_root").agg(F.count(F.lit(1)).alias("locations"), F.countDistinct("content_hash").alias("hashes"), F.countDistinct("path").alias("files"))


def stats_by_node_type(spark, sf_dir):
    return _t(spark, sf_dir, "chunk_locations").groupBy(F.coalesce("node_type", F.lit("unknown")).alias("node_type")).agg(F.count(F.lit(1)).alias("n"))


def stats_by_language(spark, sf_dir):
    return _t(spark, sf_dir, "chunk_locations").groupBy(canonical_language(F.col("language")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def embedding_stats(spark, sf_dir):
    return _t(spark, sf_dir, "embedding_cache").groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("content_hash").alias("hashes"), F.max("last_accessed").alias("last_accessed"))


def migration_eta(spark, sf_dir):
    n = F.count("embedding")
    return _t(spark, sf_dir, "embedding_cache").agg(n.alias("vectors"), F.greatest(F.lit(1), F.floor(n / 1000)).cast("bigint").alias("seconds"))


def _leaves(df):
    return df.select("repo_root", "path", F.sha2(F.concat_ws(":", "size", "mtime"), 256).alias("hash"), "size")


def _new_tree(spark, sf_dir):
    return _leaves(newest_manifest(_t(spark, sf_dir, "disk_scans")))


def _old_tree(spark, sf_dir):
    return _leaves(known_manifest(_t(spark, sf_dir, "files"), _t(spark, sf_dir, "index_runs")))


def merkle_dir_hash(spark, sf_dir):
    return merkle.tree_nodes(_new_tree(spark, sf_dir)).filter("is_dir").select("repo_root", "path", "hash", "files")


def merkle_diff(spark, sf_dir):
    leaf = lambda df: df.withColumn("is_dir", F.lit(False))
    return merkle.diff_trees(leaf(_old_tree(spark, sf_dir)), leaf(_new_tree(spark, sf_dir))).select("repo_root", "path", "change")


def merkle_diff_dirs(spark, sf_dir):
    old, new = (merkle.tree_nodes(t(spark, sf_dir)).filter("is_dir") for t in (_old_tree, _new_tree))
    return merkle.diff_trees(old, new).select("repo_root", "path", "change")


def tree_rollup(spark, sf_dir):
    return merkle.rollup(_new_tree(spark, sf_dir))


def debounce_sessions(spark, sf_dir):
    return watch.debounce(_t(spark, sf_dir, "events"), "user_id", "ts", "12 hours")


def watch_route(spark, sf_dir):
    """The watched project of every location: repositories, and service directories of the monolith."""
    locations = _t(spark, sf_dir, "chunk_locations").select("id", F.concat_ws("/", "repo_root", "path").alias("full"))
    from pyspark.sql import Window as W

    projects = _t(spark, sf_dir, "chunk_locations").select(F.col("repo_root").alias("project_path")).distinct()
    projects = projects.withColumn("ordinal", F.row_number().over(W.orderBy("project_path")))  # registry of projects
    return watch.route(locations, projects, "full").select("id", "project")


def watch_limit(spark, sf_dir):
    dirs = _t(spark, sf_dir, "chunk_locations").select("repo_root", merkle.parent_of(F.col("path")).alias("dir")).filter("dir <> ''").distinct()
    return watch.watch_limit(dirs, "repo_root", "dir", 20)


def _results(spark, sf_dir):
    """Answers of two modes made from the cases: with tools the expected files, without the prompt."""
    cases = _t(spark, sf_dir, "eval_cases")
    files = F.array_join(F.coalesce("ground_truth.files", F.array().cast("array<string>")), " and ")
    base = cases.select(F.col("id").alias("test_case_id"), "prompt", files.alias("files"), F.size(F.coalesce("ground_truth.symbols", F.array().cast("array<string>"))).alias("s"))
    make = lambda mode, output, factor: base.select("test_case_id", F.lit(mode).alias("mode"), (F.col("s") < 3).alias("success"), output.alias("output"), (F.length("prompt") * factor).alias("duration_ms"), (F.length(output) + F.length("prompt")).alias("tokens_used"), (F.length("prompt") / 1000.0).alias("cost"))
    return cases, make("with_tools", F.concat(F.lit("see "), F.col("files")), 2).unionByName(make("without_tools", F.col("prompt"), 3))


def eval_f1(spark, sf_dir):
    return evaluation.score_answers(*_results(spark, sf_dir))


def eval_compare(spark, sf_dir):
    return evaluation.compare_modes(eval_f1(spark, sf_dir))


def eval_summary(spark, sf_dir):
    cases, results = _results(spark, sf_dir)
    return evaluation.summarize(results, evaluation.score_answers(cases, results))


def parse_log_name(spark, sf_dir):
    """Time, case and mode of log names ``YYYY-MM-DD-HHMMSS-<case>-<mode>.log``; other names are skipped."""
    name = F.concat(F.lit("2025-03-04-05060"), F.length("prompt") % 10, F.lit("-"), F.col("id"), F.lit("-"), F.when(F.col("difficulty").isNull(), "draft").otherwise("with_tools"), F.lit(".log"))
    pattern = r"^(\d{4}-\d{2}-\d{2}-\d{6})-(.+)-(with_tools|without_tools)\.log$"
    part = lambda n: F.regexp_extract("name", pattern, n)
    return _t(spark, sf_dir, "eval_cases").select(name.alias("name")).filter(F.col("name").rlike(pattern)).select("name", F.to_timestamp(part(1), "yyyy-MM-dd-HHmmss").cast("timestamp_ntz").alias("at"), part(2).alias("test_case_id"), part(3).alias("mode"))


QUERIES = {
    f.__name__: f
    for f in (upsert_replace, upsert_update_cols, cache_put_merge, cache_get_batch, cache_has_batch, cache_evict_lru, cache_evict_model, cache_access_rollup, cache_stats, embed_cache_split, incremental_changed_files, orphaned_hashes, vec_sync_missing, vec_sync_stale, migrate_skip_existing, migration_validate, embeddings_by_repo, cross_repo_scan, locations_by_hash, distinct_hashes, list_paths, location_stats, stats_by_node_type, stats_by_language, embedding_stats, migration_eta, merkle_dir_hash, merkle_diff, merkle_diff_dirs, tree_rollup, debounce_sessions, watch_route, watch_limit, eval_f1, eval_compare, eval_summary, parse_log_name)
}

_KEY = _HASH.format("content_hash")
_STATE = _CHANGES + f""", state as (select repo_root, path, s.mtime as mtime, s.size as size, s.indexed_at as indexed_at from (select repo_root, path, max({{'indexed_at': indexed_at, 'mtime': mtime, 'size': size}}) as s from files group by 1, 2)),
scanned as (select repo_root, path, mtime, size, {NOW}::bigint as indexed_at from seen)"""
_CACHED = "cached as (select * from (select *, row_number() over (partition by content_hash order by created_at, access_count, last_accessed) as n from embedding_cache) where n = 1)"
_ASKED = f"asked as (select distinct {_KEY} as key from chunk_locations where {_KEY} is not null)"
_DEPTH = 12


def _tree(name: str, source: str) -> str:
    """CTEs of the directories of a tree, level by level from the deepest."""
    parent = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
    parts = [f"{name}_leaf as (select repo_root, path, sha256(size || ':' || mtime) as hash, size, 1::bigint as files, len(string_split(path, '/')) as depth from {source})"]
    for d in range(_DEPTH, 0, -1):
        child = f"select repo_root, path, hash, files from {name}_leaf where depth = {d}" + (f" union all select repo_root, path, hash, files from {name}_{d}" if d < _DEPTH else "")
        parts.append(f"{name}_{d - 1} as (select repo_root, {parent} as path, sha256(string_agg(hash, '' order by path)) as hash, sum(files)::bigint as files from ({child}) group by 1, 2)")
    parts.append(f"{name}_dirs as (" + " union all ".join(f"select * from {name}_{d}" for d in range(_DEPTH)) + ")")
    return ", ".join(parts)


def _diff(old: str, new: str) -> str:
    return f"select coalesce(o.repo_root, n.repo_root) as repo_root, coalesce(o.path, n.path) as path, case when o.hash is null then 'added' when n.hash is null then 'deleted' else 'modified' end as change from {old} o full join {new} n on o.repo_root = n.repo_root and o.path = n.path where o.hash is distinct from n.hash"


_RESULTS = r"""cases as (select id as test_case_id, prompt, coalesce(ground_truth.files, []) as files, coalesce(ground_truth.symbols, []) as symbols from eval_cases),
results as (
  select test_case_id, 'with_tools' as mode, len(symbols) < 3 as success, 'see ' || array_to_string(files, ' and ') as output, len(prompt) * 2 as duration_ms, files, symbols, prompt from cases
  union all select test_case_id, 'without_tools', len(symbols) < 3, prompt, len(prompt) * 3, files, symbols, prompt from cases),
found as (select *, list_concat({0}) as paths from results),
scored as (select *, len(list_filter(files, lambda f: len(list_filter(paths, lambda p: contains(lower(p), lower(f)) or contains(lower(f), lower(p)))) > 0)) + len(list_filter(symbols, lambda s: contains(output, s))) as hit, len(files) + len(symbols) as total from found),
f1 as (select *, round(case when success and total > 0 then hit / total::double else 0.0::double end, 6) as f1 from scored)"""


def _results_sql() -> str:
    from quern.functions.text import PATH_PATTERNS

    return _RESULTS.replace("{0}", ", ".join(f"regexp_extract_all(output, '{p}')" for p in PATH_PATTERNS))


_E = _results_sql()
SQL = {
    "upsert_replace": _STATE + " select * from scanned union all select * from state s where not exists (select 1 from scanned n where n.repo_root = s.repo_root and n.path = s.path)",
    "upsert_update_cols": _STATE + " select coalesce(n.repo_root, s.repo_root) as repo_root, coalesce(n.path, s.path) as path, coalesce(n.mtime, s.mtime) as mtime, coalesce(n.size, s.size) as size, coalesce(s.indexed_at, n.indexed_at) as indexed_at from state s full join scanned n on n.repo_root = s.repo_root and n.path = s.path",
    "cache_put_merge": f"""with {_CACHED}, fresh as (select distinct content_hash from chunks where content_hash is not null),
puts as (select content_hash, sum(n)::bigint as puts from (select content_hash, count(*) as n from embedding_cache group by 1 union all select content_hash, 1 from fresh) group by 1)
select p.content_hash, coalesce(c.model, 'new') as model, coalesce(c.dimensions, 8)::int as dimensions, coalesce(c.created_at, {NOW})::bigint as created_at, (coalesce(c.access_count, 0) + puts)::bigint as access_count, {NOW}::bigint as last_accessed from puts p left join cached c on c.content_hash = p.content_hash""",
    "cache_get_batch": f"with {_CACHED}, {_ASKED} select content_hash, model, dimensions from cached where embedding is not null and {_KEY} in (select key from asked)",
    "cache_has_batch": f"with {_ASKED}, known as (select distinct {_KEY} as key from embedding_cache) select key, key in (select key from known where key is not null) as known from asked",
    "cache_evict_lru": f"with {_CACHED} select content_hash, last_accessed from cached order by last_accessed desc, content_hash limit 200",
    "cache_evict_model": "select model, count(*) as kept from embedding_cache where model <> 'lark-code-48' group by 1",
    "cache_access_rollup": "select user_id, count(*) as accesses, max(ts) as last_access from events group by 1",
    "cache_stats": "select count(*) as entries, count(distinct content_hash) as hashes, round(avg(access_count), 6) as avg_access, min(access_count) as min_access, max(access_count) as max_access, sum(access_count)::bigint as total_access, min(created_at) as oldest, max(created_at) as newest from embedding_cache",
    "embed_cache_split": r"select case when coalesce(trim(regexp_replace(content, '\s+', ' ', 'g')), '') = '' then 'skipped' when content_hash in (select content_hash from embedding_cache) then 'hit' else 'embed' end as action, count(*) as chunks, count(distinct content_hash) as hashes from chunks group by 1",
    "incremental_changed_files": f"""with o as (select repo_root, path, {_KEY} as h, count(*) as n from chunk_locations where {_KEY} is not null group by 1, 2, 3), c as (select repo_root, path, {_KEY} as h, count(*) as n from chunks where {_KEY} is not null group by 1, 2, 3),
d as (select coalesce(o.repo_root, c.repo_root) as repo_root, coalesce(o.path, c.path) as path from o full join c on o.repo_root = c.repo_root and o.path = c.path and o.h = c.h where o.n is distinct from c.n)
select distinct repo_root, path from d where exists (select 1 from c where c.repo_root = d.repo_root and c.path = d.path)""",
    "orphaned_hashes": f"with {_ASKED} select distinct {_KEY} as key from embedding_cache where {_KEY} is not null and {_KEY} not in (select key from asked)",
    "vec_sync_missing": "select distinct content_hash from embedding_cache e where content_hash is not null and not exists (select 1 from chunks c where c.content_hash = e.content_hash)",
    "vec_sync_stale": "select distinct content_hash from chunks c where content_hash is not null and not exists (select 1 from embedding_cache e where c.content_hash = e.content_hash)",
    "migrate_skip_existing": "with s as (select distinct repo_root, path, start_line, end_line from chunks), t as (select distinct repo_root, path, start_line, end_line, 1 as there from chunk_locations) select s.repo_root, count(*) as total, count(there) as skipped, sum((there is null)::int)::bigint as migrated from s left join t on s.repo_root = t.repo_root and s.path = t.path and s.start_line = t.start_line and s.end_line = t.end_line group by 1",
    "migration_validate": """with n as (select *, row_number() over (partition by content_hash order by created_at, access_count, last_accessed) as n from embedding_cache where embedding is not null),
p as (select a.content_hash, a.dimensions = b.dimensions as same, list_zip(a.embedding[1:10]::double[], b.embedding[1:10]::double[]) as z from n a join n b on a.content_hash = b.content_hash and a.n = 1 and b.n = 2)
select content_hash, same and len(list_filter(z, lambda x: coalesce(x[1] = x[1] and not isnan(x[1]) and not isnan(x[2]) and abs(x[1] - x[2]) <= 1e-4, false))) = len(z) as valid from p""",
    "embeddings_by_repo": f"with {_CACHED} select l.id, l.path, l.start_line, c.content_hash, c.model from (select *, {_KEY} as key from chunk_locations where repo_root = '{REPO}') l join (select content_hash, model, {_KEY} as key from cached) c on l.key = c.key",
    "cross_repo_scan": f"select id, repo_root, path, start_line from chunk_locations where repo_root in ('{REPO}', (select min(repo_root) from chunk_locations))",
    "locations_by_hash": f"with k as (select *, {_KEY} as key from chunk_locations), t as (select key from k where key is not null group by 1 order by count(*) desc, key limit 1) select key, id, repo_root, path, start_line from k where key = (select key from t)",
    "distinct_hashes": "select distinct repo_root, content_hash from chunk_locations where content_hash <> ''",
    "list_paths": "select distinct repo_root, path from chunk_locations",
    "location_stats": "select repo_root, count(*) as locations, count(distinct content_hash) as hashes, count(distinct path) as files from chunk_locations group by 1",
    "stats_by_node_type": "select coalesce(node_type, 'unknown') as node_type, count(*) as n from chunk_locations group by 1",
    "stats_by_language": "select coalesce(nullif(lower(trim(language)), ''), 'unknown') as language, count(*) as n from chunk_locations group by 1",
    "embedding_stats": "select model, count(*) as rows, count(distinct content_hash) as hashes, max(last_accessed) as last_accessed from embedding_cache group by 1",
    "migration_eta": "select count(embedding) as vectors, greatest(1, count(embedding) // 1000)::bigint as seconds from embedding_cache",
    "merkle_dir_hash": _CHANGES + f", {_tree('new', 'seen')} select repo_root, path, hash, files from new_dirs",
    "merkle_diff": _CHANGES + ", o as (select repo_root, path, sha256(size || ':' || mtime) as hash from known), n as (select repo_root, path, sha256(size || ':' || mtime) as hash from seen) " + _diff("o", "n"),
    "merkle_diff_dirs": _CHANGES + f", {_tree('new', 'seen')}, {_tree('old', 'known')} " + _diff("old_dirs", "new_dirs"),
    "tree_rollup": _CHANGES + ", p as (select repo_root, string_split(path, '/') as s, size from seen), a as (select repo_root, array_to_string(s[1:i], '/') as dir, size from (select *, unnest(range(0, len(s))) as i from p)) select repo_root, dir, count(*) as files, sum(size)::bigint as bytes from a group by 1, 2",
    "debounce_sessions": "with f as (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval 12 hour then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from f) select user_id as project, min(ts) as session_start, max(ts) + interval 12 hour as fire_at, count(*) as events from g group by user_id, s",
    "watch_route": "select id, repo_root as project from chunk_locations",
    "watch_limit": r"with d as (select distinct repo_root, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from chunk_locations) select repo_root, dir from (select *, row_number() over (partition by repo_root order by dir) as n from d where dir <> '') where n <= 20",
    "eval_f1": f"with {_E} select test_case_id, mode, f1 as recall, f1 as precision, f1 from f1",
    "eval_compare": f"with {_E}, w as (select test_case_id, max(case when mode = 'with_tools' then f1 end) as with_tools, max(case when mode = 'without_tools' then f1 end) as without_tools from f1 group by 1) select *, round(with_tools - without_tools, 6) as gain from w",
    "eval_summary": f"with {_E} select mode, count(*) as runs, round(avg(success::int::double), 6) as success_rate, round(avg(duration_ms), 6) as avg_duration_ms, round(avg(len(output) + len(prompt)), 6) as avg_tokens, round(sum(len(prompt) / 1000.0::double), 6) as total_cost, round(coalesce(avg(case when f1 > 0 then f1 end), 0.0::double), 6) as accuracy, round(avg(f1), 6) as macro_f1 from f1 group by 1",
    "parse_log_name": r"""with n as (select '2025-03-04-05060' || (len(prompt) % 10) || '-' || id || '-' || case when difficulty is null then 'draft' else 'with_tools' end || '.log' as name from eval_cases)
select name, strptime(regexp_extract(name, '^(\d{4}-\d{2}-\d{2}-\d{6})-(.+)-(with_tools|without_tools)\.log$', 1), '%Y-%m-%d-%H%M%S') as at, regexp_extract(name, '^(\d{4}-\d{2}-\d{2}-\d{6})-(.+)-(with_tools|without_tools)\.log$', 2) as test_case_id, regexp_extract(name, '^(\d{4}-\d{2}-\d{2}-\d{6})-(.+)-(with_tools|without_tools)\.log$', 3) as mode from n where name like '%\_tools.log' escape '\'""",
}
