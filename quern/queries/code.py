"""Queries on files, lines, symbols and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import languages as LANG
from quern.functions import text as X
from quern.operators import chunking, search, store
from quern.operators.increments import files_to_process
from quern.operators.positions import positions
from quern.queries.integrity import _CHANGES
from quern.runtime import read_table

PATTERN, TOP_K = "took [0-9]+ seconds", 50


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "doc_id", "text")


def search_keyword(spark, sf_dir):
    return search.search_keyword(_documents(spark, sf_dir), PATTERN, "path", "text", TOP_K)


def get_file_slice(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.line_slice(F.col("text"), 2, 4).alias("content"))


def parse_grep_line(spark, sf_dir):
    line = F.concat_ws(":", "path", "start_line", F.coalesce("node_name", F.lit("")))
    return read_table(spark, sf_dir, "chunk_locations").select("id", search.parse_grep_line(line).alias("p")).select("id", "p.path", "p.line", "p.content")


def query_builder_page(spark, sf_dir):
    return read_table(spark, sf_dir, "symbols").filter("kind = 'function' and language = 'go'").select("id", "name", "path", "line").orderBy("name", "id").offset(50).limit(100)


def snippet_label(spark, sf_dir):
    return read_table(spark, sf_dir, "chunk_locations").select("id", X.snippet_label(F.col("path"), F.col("start_line"), F.col("end_line")).alias("label"))


def truncate_snippet(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.truncate_snippet(F.col("text"), 120).alias("snippet"))


def content_hash(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def extract_paths(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.extract_paths(F.col("text")), "|").alias("paths"))


def find_symbol(spark, sf_dir):
    return search.find_symbol(read_table(spark, sf_dir, "symbols"), "packet").select("id", "name", "kind", "path", "line", "match_rank")


def find_symbol_kind(spark, sf_dir):
    return search.find_symbol(read_table(spark, sf_dir, "symbols"), "record", "method", 30).select("id", "name", "kind", "path", "line", "match_rank")


def list_defs_in_file(spark, sf_dir):
    symbols = read_table(spark, sf_dir, "symbols")
    first = symbols.filter("path <> ''").agg(F.min("path").alias("path"))
    return symbols.join(F.broadcast(first), "path").select("path", "line", "name", "kind", "id").orderBy("line", "id")


def _definitions(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "chunks").withColumn("lang", LANG.canonical_language(F.col("language")))
    return search.extract_definitions(chunks, "lang", "content", ["chunk_id"])


def extract_definitions(spark, sf_dir):
    return _definitions(spark, sf_dir)


def extract_name(spark, sf_dir):
    return read_table(spark, sf_dir, "symbols").select("id", search.extract_name(F.col("pattern")).alias("extracted"))


def normalize_kind(spark, sf_dir):
    return read_table(spark, sf_dir, "symbols").groupBy(LANG.normalize_kind(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def detect_language(spark, sf_dir):
    return read_table(spark, sf_dir, "chunk_locations").groupBy(LANG.detect_language(F.col("path")).alias("language"), LANG.is_code_file(F.col("path")).alias("is_code")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_symbols(spark, sf_dir):
    return store.keep_last(read_table(spark, sf_dir, "symbols"), ["repo_root", "path", "line", "name"], [F.col("id")]).select("id", "repo_root", "path", "line", "name")


def symbol_stats(spark, sf_dir):
    return read_table(spark, sf_dir, "symbols").groupBy("repo_root").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("path").alias("files"))


def _changes(spark, sf_dir):
    return files_to_process(*(read_table(spark, sf_dir, t) for t in ("files", "index_runs", "disk_scans")))


def scan_changed_files(spark, sf_dir):
    return _changes(spark, sf_dir).filter((F.col("change") != "deleted") & LANG.is_code_file(F.col("path"))).select("repo_root", "path", "change")


def symbols_incremental_update(spark, sf_dir):
    """Symbols after an update: those of deleted files gone, those of modified files written anew."""
    symbols, now = read_table(spark, sf_dir, "symbols").select("id", "repo_root", "path", "name", "indexed_at"), 1_760_000_000
    changes = _changes(spark, sf_dir)
    stale = changes.filter("change <> 'added'")
    fresh = symbols.join(changes.filter("change = 'modified'").select("repo_root", "path"), ["repo_root", "path"], "left_semi").withColumn("indexed_at", F.lit(now).cast("bigint"))
    return store.delete_matching(symbols, stale, ["repo_root", "path"]).unionByName(fresh)


def chunk_lines(spark, sf_dir):
    texts = _documents(spark, sf_dir).withColumn("lines", X.lines_of(F.col("text")))
    return chunking.chunk_lines(texts, "path", "lines", 10, 5, 5).select("path", "start_line", "end_line", X.content_hash(F.col("content")).alias("content_hash"))


def chunk_fallback(spark, sf_dir):
    return chunking.chunk_fallback(_documents(spark, sf_dir), "path", "text", 8, 2)


def _chunk_files(spark, sf_dir):
    return read_table(spark, sf_dir, "chunks").filter("content <> ''").select(F.col("chunk_id").alias("path"), X.lines_of(F.col("content")).alias("lines"))


def chunk_by_symbols(spark, sf_dir):
    files, symbols = _chunk_files(spark, sf_dir), _definitions(spark, sf_dir).withColumnRenamed("chunk_id", "path")
    return chunking.chunk_by_symbols(files, symbols, "path", "lines", 10, 4, 3).select("path", "start_line", "end_line", "kind", X.content_hash(F.col("content")).alias("content_hash"))


def gap_fill(spark, sf_dir):
    files = _chunk_files(spark, sf_dir).withColumn("n", F.size("lines"))
    regions = chunking.symbol_regions(files, _definitions(spark, sf_dir).withColumnRenamed("chunk_id", "path"), "path", "n", 3)
    return chunking.uncovered_runs(files, regions, "path", "n", 3).select("path", F.col("s").alias("start_line"), F.col("e").alias("end_line"))


def batch_assign(spark, sf_dir):
    """Batches of 100 files per repository, in the order of their paths."""
    files = positions(read_table(spark, sf_dir, "files").select("repo_root", "path").distinct(), ["repo_root"], [F.col("path")])
    return files.select("repo_root", "path", F.floor(F.col("before") / 100).cast("int").alias("batch"))


QUERIES = {
    f.__name__: f
    for f in (search_keyword, get_file_slice, parse_grep_line, query_builder_page, snippet_label, truncate_snippet, content_hash, extract_paths, find_symbol, find_symbol_kind, list_defs_in_file, extract_definitions, extract_name, normalize_kind, detect_language, dedupe_symbols, symbol_stats, scan_changed_files, symbols_incremental_update, chunk_lines, chunk_fallback, chunk_by_symbols, gap_fill, batch_assign)
}

_NL = "chr(10)"
_CLEAN = "regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '\\r$', '')"
_SPLIT = f"string_split({_CLEAN}, {_NL})"
_DOCS = "select coalesce(source || '/', '') || doc_id as path, doc_id, text from documents"
_LINES = f"docs as ({_DOCS}), raw as (select path, doc_id, {_SPLIT.format('text')} as l from docs), lined as (select path, doc_id, case when l[len(l)] = '' then l[1:len(l)-1] else l end as l from raw)"
_DEFS = f"""
craw as (select chunk_id, coalesce(nullif(lower(trim(language)), ''), 'unknown') as lang, {_SPLIT.format("content")} as l from chunks where content is not null),
clines as (select chunk_id, lang, case when l[len(l)] = '' then l[1:len(l)-1] else l end as l from craw),
cline as (select chunk_id, lang, unnest(l) as t, generate_subscripts(l, 1) as line from clines),
hit as (select chunk_id, line, case {" ".join(f"when lang = '{a}' and regexp_extract(t, '{p}', 1) <> '' then '{k}'" for a, k, p in search.DEFINITIONS)} end as kind,
  case {" ".join(f"when lang = '{a}' and regexp_extract(t, '{p}', 1) <> '' then regexp_extract(t, '{p}', 1)" for a, k, p in search.DEFINITIONS)} end as name from cline),
defs as (select chunk_id, line, kind, name from hit where kind is not null)
"""
_REGIONS = f"""{_DEFS},
cfiles as (select chunk_id as path, l, len(l) as n from clines where len(l) > 0 and chunk_id in (select chunk_id from chunks where content <> '')),
spans as (select chunk_id as path, line as s, lead(line) over (partition by chunk_id order by line, kind) as nx, kind from defs where kind in ('function', 'struct', 'class', 'type', 'interface', 'method')),
regions as (select s.path, s.s, least(coalesce(nx - 1, n), n) as e, kind from spans s join cfiles f on f.path = s.path where least(coalesce(nx - 1, n), n) - s.s + 1 >= 3),
inner_runs as (select path, coalesce(max(e) over (partition by path order by s, e rows between unbounded preceding and 1 preceding), 0) + 1 as s, s - 1 as e from regions),
outer_runs as (select f.path, coalesce(r.last, 0) + 1 as s, f.n as e from cfiles f left join (select path, max(e) as last from regions group by 1) r on r.path = f.path),
runs as (select path, s, e from inner_runs union all select path, s, e from outer_runs)
"""


def _chain(column: str) -> str:
    """The prefix cuts as one subquery per prefix, so that the text stays short."""
    query = f"select id, trim({column}) as v from symbols"
    for p in search.NAME_PREFIXES:
        query = f"select id, case when starts_with(v, '{p}') then substr(v, {len(p) + 1}) else v end as v from ({query})"
    return query


def _case(mapping: dict[str, str], value: str, otherwise: str) -> str:
    return f"case {value} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + f" else {otherwise} end"


_EXT = r"regexp_extract(path, '\.([^./\\]*)$', 1)"
_CODE = "lower({0}) in (" + ", ".join(f"'{x}'" for x in LANG.CODE_EXTENSIONS) + ")"

SQL = {
    "search_keyword": f"""with {_LINES}, line as (select path, unnest(l) as snippet, generate_subscripts(l, 1) as line from lined),
hits as (select path, line, snippet, row_number() over (partition by path order by line) as n from line where regexp_matches(snippet, '{PATTERN}')),
first as (select path, line, snippet, row_number() over (order by path, line) as r from hits where n <= {2 * TOP_K})
select path, line::int as line, snippet, (101 - r)::int as score from first where r <= {TOP_K}""",
    "get_file_slice": f"with {_LINES} select doc_id, case when len(l) >= 2 then array_to_string(l[2:least(4, len(l))], {_NL}) end as content from lined",
    "parse_grep_line": r"with g as (select id, path || ':' || start_line || ':' || coalesce(node_name, '') as t from chunk_locations) select id, regexp_extract(t, '^([^:]+):(\d+):(.*)$', 1) as path, regexp_extract(t, '^([^:]+):(\d+):(.*)$', 2)::int as line, regexp_extract(t, '^([^:]+):(\d+):(.*)$', 3) as content from g",
    "query_builder_page": "select id, name, path, line from symbols where kind = 'function' and language = 'go' order by name, id limit 100 offset 50",
    "snippet_label": "select id, '[' || path || ':' || start_line || '-' || end_line || '] (' || (end_line - start_line + 1) || ' lines)' as label from chunk_locations",
    "truncate_snippet": f"""with d as (select doc_id, text, string_split(ltrim(text, {_NL}), {_NL}) as l from documents),
c as (select *, case when len(l[1]) > 119 then 0 else len(list_filter(range(1, least(len(l), 121) + 1), lambda i: len(array_to_string(l[1:i], {_NL})) <= 120)) end as n from d)
select doc_id, case when len(text) <= 120 then text when n > 0 then array_to_string(l[1:n], {_NL}) || {_NL} || '...' else substr(text, 1, 120) || '...' end as snippet from c""",
    "content_hash": "select doc_id, sha256(text) as content_hash from documents",
    "extract_paths": "with f as (select doc_id, "
    + " || ".join(f"regexp_extract_all(text, '{p}')" for p in X.PATH_PATTERNS)
    + " as p from documents) select doc_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '|') as paths from f",
    "find_symbol": "select id, name, kind, path, line, (case when lower(name) = 'packet' then 0 when lower(name) like 'packet%' then 1 else 2 end)::int as match_rank from symbols where name ilike '%packet%' order by match_rank, name, id limit 50",
    "find_symbol_kind": "select id, name, kind, path, line, (case when lower(name) = 'record' then 0 when lower(name) like 'record%' then 1 else 2 end)::int as match_rank from symbols where name ilike '%record%' and kind = 'method' order by match_rank, name, id limit 30",
    "list_defs_in_file": "select path, line, name, kind, id from symbols where path = (select min(path) from symbols where path <> '')",
    "extract_definitions": f"with {_DEFS} select chunk_id, line::int as line, kind, name from defs",
    "extract_name": rf"select id, case when regexp_extract(v, '^[({{<:=]*([^({{<:=]+)', 1) <> '' then trim(regexp_extract(v, '^[({{<:=]*([^({{<:=]+)', 1)) else 'unknown' end as extracted from ({_chain('pattern')})",
    "normalize_kind": f"select {_case(LANG.SYMBOL_KINDS, 'lower(kind)', 'kind')} as kind, count(*) as n from symbols group by 1",
    "detect_language": f"select {_case(LANG.LOCATION_LANGUAGES, _EXT, repr('unknown'))} as language, {_CODE.format(_EXT)} as is_code, count(*) as n from chunk_locations group by 1, 2",
    "dedupe_symbols": "select id, repo_root, path, line, name from (select *, row_number() over (partition by repo_root, path, line, name order by id) as n from symbols) where n = 1",
    "symbol_stats": "select repo_root, count(*) as symbols, count(distinct path) as files from symbols group by 1",
    "scan_changed_files": _CHANGES + f"select repo_root, path, change from changes where change <> 'deleted' and {_CODE.format(_EXT)}",
    "symbols_incremental_update": _CHANGES + """select id, repo_root, path, name, indexed_at from symbols s where not exists (select 1 from changes c where c.repo_root = s.repo_root and c.path = s.path and c.change <> 'added')
union all select id, repo_root, path, name, 1760000000::bigint from symbols s where exists (select 1 from changes c where c.repo_root = s.repo_root and c.path = s.path and c.change = 'modified')""",
    "chunk_lines": f"""with {_LINES}, w as (select path, l, len(l) as n, unnest(range(0, greatest(ceil((len(l) - 10) / 5.0)::int, 0) + 1)) as i from lined where len(l) > 0)
select path, (i * 5 + 1)::int as start_line, least(i * 5 + 10, n)::int as end_line, sha256(array_to_string(l[i * 5 + 1:least(i * 5 + 10, n)], {_NL})) as content_hash from w where least(i * 5 + 10, n) - i * 5 >= 5 or n < 5""",
    "chunk_fallback": f"""with d as (select coalesce(source || '/', '') || doc_id as path, text, string_split(text, {_NL}) as l from documents where len(text) > 0),
w as (select path, text, l, len(l) as n, unnest(range(0, greatest(ceil((len(l) - 8) / 6.0)::int, 0) + 1)) as i from d),
c as (select *, case when n <= 8 then text else array_to_string(l[i * 6 + 1:least(i * 6 + 8, n)], {_NL}) end as content, case when i = 0 then 0 else strlen(array_to_string(l[1:i * 6], {_NL})) + 1 end as sb from w)
select path, (i * 6 + 1)::int as start_line, least(i * 6 + 8, n)::int as end_line, (case when n <= 8 then 0 else sb end)::bigint as start_byte, (case when n <= 8 then 0 else sb + strlen(content) end)::bigint as end_byte, sha256(content) as content_hash from c""",
    "chunk_by_symbols": f"""with {_REGIONS},
inside as (
  select path, s, e, kind from regions where e - s + 1 <= 10
  union all select path, s + i * 6 as s, least(s + i * 6 + 9, e) as e, kind from (select path, s, e, kind, unnest(range(0, greatest(ceil((e - s + 1 - 10) / 6.0)::int, 0) + 1)) as i from regions where e - s + 1 > 10)
  union all select path, e - 3 as s, e, kind from regions where e - s + 1 > 10),
outside as (select path, s + i * 6 as s, least(s + i * 6 + 9, e) as e, 'fixed' as kind, e - s + 1 as r from (select path, s, e, unnest(range(0, greatest(ceil((e - s + 1 - 10) / 6.0)::int, 0) + 1)) as i from runs where e >= s)),
every as (select path, s, e, kind from inside union all select path, s, e, kind from outside where e - s + 1 >= 3 or r < 3)
select x.path, x.s::int as start_line, x.e::int as end_line, x.kind, sha256(array_to_string(f.l[x.s:x.e], {_NL})) as content_hash from every x join cfiles f on f.path = x.path""",
    "gap_fill": f"with {_REGIONS} select path, s::int as start_line, e::int as end_line from runs where e - s + 1 >= 3",
    "batch_assign": "select repo_root, path, ((row_number() over (partition by repo_root order by path) - 1) // 100)::int as batch from (select distinct repo_root, path from files)",
}
