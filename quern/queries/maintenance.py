"""Queries on deletions, versions, ignore rules, records, settings and forms of vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import codec
from quern.functions import languages as LANG
from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.identity import canonical_hash, canonical_path
from quern.operators import search, store
from quern.operators.increments import files_to_process
from quern.operators.references import orphan_references
from quern.plans.migrate import differences, migrate
from quern.queries.integrity import _CHANGES, _HASH, _PLACE, _ROOT
from quern.runtime import read_table, scratch_folder
from quern.sources.ignore import default_ignored, ignored_by, parse_gitignore
from quern.sources.records import read_cases
from quern.sources.versioned import VersionedTable

IGNORE = "# comment\n*.md\n!README.md\n/cmd\ndocs/*.txt\nlib/\n"
WORDS = ("true", "YES", " off ", "0", "maybe", "", "Enabled", "no")


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


def delete_by_path(spark, sf_dir):
    """Symbols and locations without those of files that are gone."""
    gone = files_to_process(*(_t(spark, sf_dir, t) for t in ("files", "index_runs", "disk_scans"))).filter("change = 'deleted'")
    kept = lambda t: store.delete_matching(_t(spark, sf_dir, t), gone, ["repo_root", "path"]).select(F.lit(t).alias("store"), "id")
    return kept("symbols").unionByName(kept("chunk_locations"))


def delete_by_hash(spark, sf_dir):
    """The cache without the hashes no location uses."""
    cache = _t(spark, sf_dir, "embedding_cache").withColumn("key", canonical_hash(F.col("content_hash")))
    used = _t(spark, sf_dir, "chunk_locations").select(canonical_hash(F.col("content_hash")).alias("key")).filter("key is not null")
    unused = cache.filter("key is not null").select("key").distinct().join(used, "key", "left_anti")
    return store.delete_matching(cache, unused, ["key"]).select("content_hash", "model", "created_at", "access_count")


def table_versions(spark, sf_dir):
    """Rows by version and language of a versioned table that was written, cut by deletion vectors,
    added to and emptied."""
    table = VersionedTable(spark, scratch_folder(spark, "versions"))
    symbols = _t(spark, sf_dir, "symbols").select("id", "language", "kind")
    table.append(symbols.filter("id % 3 > 0"))
    table.delete("language = 'go'")
    table.append(symbols.filter("id % 3 = 0"))
    table.delete("kind = 'function' or language = 'python'")
    last = table.delete("true")
    seen = [table.read(v).groupBy("language").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "language", "n") for v in range(1, last + 1)]
    return reduce(DataFrame.unionByName, seen)


def ignore_rules(spark, sf_dir):
    """Which locations' paths a gitignore file and the default names exclude."""
    paths = _t(spark, sf_dir, "chunk_locations").filter("path is not null").select("path").distinct()
    return paths.select("path", ignored_by(F.col("path"), parse_gitignore(IGNORE)).alias("by_rules"), default_ignored(F.col("path")).alias("by_name"))


def watched_files(spark, sf_dir):
    """How many paths start a run, are read by the embedding run, and lie where nothing is watched."""
    path = F.col("path")
    return _t(spark, sf_dir, "chunk_locations").groupBy(LANG.is_watched_file(path).alias("watched"), LANG.is_embedded_file(path).alias("embedded")).agg(F.count(F.lit(1)).alias("n"))


def parse_switches(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % len(WORDS) + 1).cast("int"))
    return _t(spark, sf_dir, "symbols").select("id", X.to_bool(word, True).alias("on"), X.to_bool(F.nullif("scope", F.lit("")), False).alias("scope_on"))


def size_labels(spark, sf_dir):
    sizes = _t(spark, sf_dir, "files").select("size").distinct().filter("size is not null")
    return sizes.select("size", X.bytes_label(F.col("size")).alias("label"), X.bytes_label(F.col("size") * 1_048_576).alias("label_mib"))


def line_counts(spark, sf_dir):
    return _t(spark, sf_dir, "chunks").select("chunk_id", X.line_count(F.col("content")).alias("lines"), (F.col("end_line") - F.col("start_line") + 1).alias("told"))


def null_texts(spark, sf_dir):
    """Empty texts are stored as nulls."""
    symbols = _t(spark, sf_dir, "symbols")
    return symbols.groupBy("kind").agg(*[F.count(F.nullif(F.col(c), F.lit(""))).alias(c) for c in ("path", "scope", "signature")])


def parse_match_record(spark, sf_dir):
    """Records of a line search, made from the locations and read back."""
    text = lambda c: F.struct(c.alias("text"))
    data = F.struct(text(F.concat_ws("/", "repo_root", "path")).alias("path"), text(F.concat(F.coalesce("node_name", F.lit("é \"x\"")), F.lit("\r\n"))).alias("lines"), F.col("start_line").alias("line_number"))
    record = F.to_json(F.struct(F.when(F.col("id") % 5 == 0, "begin").otherwise("match").alias("type"), data.alias("data")))
    parsed = search.parse_match_record(F.when(F.col("id") % 7 == 0, F.lit("{broken")).otherwise(record), "/work/repos")
    return _t(spark, sf_dir, "chunk_locations").select("id", parsed.alias("p")).select("id", "p.path", "p.line", "p.content")


def definition_counts(spark, sf_dir):
    return search.definition_counts(_t(spark, sf_dir, "chunks"), "content")


def vector_forms(spark, sf_dir):
    """How many vectors come back from bytes as they were, and how long the bytes are."""
    rows = _t(spark, sf_dir, "embedding_cache").filter("embedding is not null").withColumn("b", codec.vector_to_bytes("embedding"))
    same = F.col("embedding").eqNullSafe(codec.vector_from_bytes("b"))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("vectors"), F.sum(same.cast("int")).alias("same"), F.sum(F.octet_length("b")).alias("bytes"))


def sql_arguments(spark, sf_dir):
    """A query with named arguments, which are values and never text of the query."""
    return spark.sql(
        "select repo_root, path, size from {files} where size >= :least and repo_root like :root and path <> :never",
        args={"least": 2000, "root": "%mono%", "never": "x' or '1' = '1"}, files=_t(spark, sf_dir, "files"),
    )


def sql_vector_functions(spark, sf_dir):
    """Distances by the functions registered for SQL."""
    V.register_sql(spark)
    pairs = _t(spark, sf_dir, "embeddings")
    return spark.sql("select a.vec_id, round(vec_dot(a.embedding, b.embedding), 6) as dot, round(vec_l2(a.embedding, b.embedding), 6) as l2, round(vec_l1(a.embedding, b.embedding), 6) as l1 from {e} a join {e} b on b.vec_id = a.vec_id + 1", e=pairs)


def cases_by_category(spark, sf_dir):
    """Cases written as JSON lines and read back, by category."""
    folder = scratch_folder(spark, "cases")
    _t(spark, sf_dir, "eval_cases").select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    return read_cases(spark, folder).groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size(F.coalesce("ground_truth.files", F.array().cast("array<string>")))).alias("files"), F.count("difficulty").alias("graded"))


def migrate_store(spark, sf_dir):
    """A store after rows of another one were copied into it, in two runs."""
    table = VersionedTable(spark, scratch_folder(spark, "migration"))
    rows = _t(spark, sf_dir, "embedding_cache").filter("content_hash is not null").groupBy("content_hash").agg(F.min_by(F.struct("model", "dimensions", "embedding"), F.struct("created_at", "access_count", "last_accessed")).alias("r")).select("content_hash", "r.*")
    table.append(rows.filter("model = 'quill-mini-32'"))
    first = migrate(rows, table, ["content_hash"])
    again = migrate(rows, table, ["content_hash"])
    wrong = differences(rows, table.read(), ["content_hash"], "embedding").count()
    counts = spark.createDataFrame([("first", first.skipped, first.migrated, wrong), ("again", again.skipped, again.migrated, wrong)], "run string, skipped bigint, migrated bigint, wrong bigint")
    return counts


def p3_masks(spark, sf_dir):
    """Orphan symbols when null parts of their reference match anything, and when they may not be null."""
    place = F.when(F.col("repo_root") != "", F.regexp_replace("repo_root", r"/+$", "")).alias("root"), canonical_path(F.col("path"), F.col("repo_root")).alias("place")
    symbols, files = _t(spark, sf_dir, "symbols").select("id", *place), _t(spark, sf_dir, "files").select(*place)
    found = [orphan_references(symbols, files, ["root", "place"], match=m).select(F.lit(m).alias("match"), F.col("id").cast("string").alias("ref_key")) for m in ("partial", "full")]
    return found[0].unionByName(found[1])


QUERIES = {
    f.__name__: f
    for f in (delete_by_path, delete_by_hash, table_versions, ignore_rules, watched_files, parse_switches, size_labels, line_counts, null_texts, parse_match_record, definition_counts, vector_forms, sql_arguments, sql_vector_functions, cases_by_category, migrate_store, p3_masks)
}

_KEY = _HASH.format("content_hash")
_IN = lambda names, value: f"{value} in (" + ", ".join(f"'{n}'" for n in names) + ")"
_EXT = r"regexp_extract(path, '\.([^./\\]*)$', 1)"
_LINES = "case when content = '' then 0 when content is not null then len(string_split(content, chr(10))) - case when content like '%' || chr(10) then 1 else 0 end end"


def _label(n: str) -> str:
    steps = " ".join(f"when {n} < 1024::double ** {p + 1} then printf('%.1f', {n} / 1024::double ** {p}) || ' {u}iB'" for p, u in ((1, "K"), (2, "M"), (3, "G"), (4, "T"), (5, "P"), (6, "E")))
    return f"case when {n} < 1024 then {n} || ' B' {steps} end"


_NAMES = (".git", ".svn", ".hg", "node_modules", "vendor", "bower_components", "dist", "build", "out", "target", "bin", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".cache", ".idea", ".vscode", ".vs", ".DS_Store", "Thumbs.db")
_SEEN = (".gitignore", ".dockerignore", ".editorconfig", ".prettierrc", ".eslintrc", ".eslintrc.json", ".eslintrc.js")
_E = "embeddings a join embeddings b on b.vec_id = a.vec_id + 1"

SQL = {
    "delete_by_path": _CHANGES + " select 'symbols' as store, id from symbols s where not exists (select 1 from changes c where c.change = 'deleted' and c.repo_root = s.repo_root and c.path = s.path) union all select 'chunk_locations', id from chunk_locations s where not exists (select 1 from changes c where c.change = 'deleted' and c.repo_root = s.repo_root and c.path = s.path)",
    "delete_by_hash": f"with used as (select distinct {_KEY} as key from chunk_locations) select content_hash, model, created_at, access_count from embedding_cache where {_KEY} is null or {_KEY} in (select key from used where key is not null)",
    "table_versions": """with v as (select unnest([1, 2, 3, 4]) as version), rows as (select version, id, language, kind from symbols, v where
  case version when 1 then id % 3 > 0 when 2 then id % 3 > 0 and coalesce(language <> 'go', true) when 3 then id % 3 = 0 or coalesce(language <> 'go', true) else (id % 3 = 0 or coalesce(language <> 'go', true)) and not coalesce(kind = 'function' or language = 'python', false) end)
select version::int as version, language, count(*) as n from rows group by 1, 2""",
    "ignore_rules": rf"""with p as (select distinct path from chunk_locations where path is not null)
select path, case when regexp_matches(path, '(^|/)lib/') then true when regexp_matches(path, '^docs/[^/]*\.txt(/|$)') then true when regexp_matches(path, '^cmd(/|$)') then true when regexp_matches(path, '(^|/)README\.md(/|$)') then false else regexp_matches(path, '(^|/)[^/]*\.md(/|$)') end as by_rules,
  len(list_filter(string_split(path, '/'), lambda s: {_IN(_NAMES, "s")} or (starts_with(s, '.') and not {_IN(_SEEN, "s")}))) > 0 as by_name from p""",
    "watched_files": f"select {_IN(LANG.WATCHED_EXTENSIONS, _EXT)} as watched, {_IN(LANG.EMBEDDED_EXTENSIONS, _EXT)} as embedded, count(*) as n from chunk_locations group by 1, 2",
    "parse_switches": f"select id, (id % 8) in (0, 1, 4, 5, 6) as on, lower(trim(coalesce(scope, ''))) in ('true', '1', 'yes', 'on', 'enabled') as scope_on from symbols",
    "size_labels": f"select distinct size, {_label('size')} as label, {_label('(size * 1048576)')} as label_mib from files where size is not null",
    "line_counts": f"select chunk_id, ({_LINES})::int as lines, end_line - start_line + 1 as told from chunks",
    "null_texts": "select kind, count(nullif(path, '')) as path, count(nullif(scope, '')) as scope, count(nullif(signature, '')) as signature from symbols group by 1",
    "parse_match_record": """with r as (select *, id % 5 <> 0 and id % 7 <> 0 as good, repo_root || '/' || path as full_path from chunk_locations)
select id, case when good then case when starts_with(full_path, '/work/repos/') then substr(full_path, 13) else full_path end end as path, case when good then start_line end as line, case when good then coalesce(node_name, 'é "x"') end as content from r""",
    "definition_counts": "with l as (select unnest(string_split(regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '\\r$', ''), chr(10))) as t from chunks) "
    + " union all ".join(f"select '{a}' as language, '{k}' as kind, count(*) filter (where regexp_extract(t, '{p}', 1) <> '') as lines from l" for a, k, p in search.DEFINITIONS),
    "vector_forms": "select model, count(*) as vectors, count(*) as same, sum(len(embedding) * 4)::bigint as bytes from embedding_cache where embedding is not null group by 1",
    "sql_arguments": "select repo_root, path, size from files where size >= 2000 and repo_root like '%mono%'",
    "sql_vector_functions": f"select a.vec_id, round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6) as dot, round(list_distance(a.embedding::double[], b.embedding::double[]), 6) as l2, round(list_sum(list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: abs(z[1] - z[2]))), 6) as l1 from {_E}",
    "cases_by_category": "select category, count(*) as cases, sum(coalesce(len(ground_truth.files), 0))::bigint as files, count(difficulty) as graded from eval_cases group by 1",
    "migrate_store": """with f as (select content_hash, arg_min(model, {'a': created_at, 'b': access_count, 'c': last_accessed}) as model from embedding_cache where content_hash is not null group by 1),
n as (select count(*) as total, count(*) filter (where model = 'quill-mini-32') as there from f)
select 'first' as run, there as skipped, total - there as migrated, 0::bigint as wrong from n union all select 'again', total, 0, 0 from n""",
    "p3_masks": f"""with s as (select id, {_ROOT} as root, {_PLACE.format("path")} as place from symbols), f as (select distinct {_ROOT} as root, {_PLACE.format("path")} as place from files),
t as (select * from f where root is not null and place is not null), r as (select distinct root from f where root is not null), p as (select distinct place from f where place is not null)
select 'partial' as match, id::varchar as ref_key from s where (root is not null and place is not null and not exists (select 1 from t where t.root = s.root and t.place = s.place))
  or (root is not null and place is null and not exists (select 1 from r where r.root = s.root)) or (root is null and place is not null and not exists (select 1 from p where p.place = s.place))
union all select 'full', id::varchar from s where (root is not null and place is not null and not exists (select 1 from t where t.root = s.root and t.place = s.place)) or ((root is null) <> (place is null))""",
}
