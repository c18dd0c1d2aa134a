"""Queries on vectors: metrics, nearest neighbours, hybrid search and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.functions.identity import canonical_hash
from quern.functions.text import lines_of
from quern.operators import fusion, search, store
from quern.operators.ann import IvfIndex
from quern.operators.knn import knn, knn_many, query_vector
from quern.runtime import read_table

K, QUERY_ID, REPO = 10, 0, "/work/repos/monolith"


def _embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _query(spark, sf_dir, vec_id=QUERY_ID):
    return query_vector(_embeddings(spark, sf_dir), "vec_id", "embedding", vec_id)


def _queries(spark, sf_dir):
    """The query set of the searches: every vector whose id is divisible by 100."""
    return _embeddings(spark, sf_dir).filter("vec_id % 100 = 0")


def _knn(metric, k=K, where=None):
    def run(spark, sf_dir):
        return knn_many(_embeddings(spark, sf_dir), _queries(spark, sf_dir), "vec_id", "embedding", k, metric, where)

    return run


def knn_one(spark, sf_dir):
    """A search with a single vector."""
    rows = _embeddings(spark, sf_dir)
    return knn(rows, rows.filter(F.col("vec_id") == QUERY_ID).select(F.col("embedding").alias("q")), "vec_id", "embedding", K)


def knn_list_index(spark, sf_dir):
    """A search in all lists of an index, which must give what the exact search gives."""
    index = IvfIndex.build(_embeddings(spark, sf_dir), "vec_id", "embedding", lists=8)
    return index.search(_query(spark, sf_dir), K, probes=len(index.numbers))


def knn_cosine(spark, sf_dir):
    return _knn("cosine")(spark, sf_dir).select("query", "id", F.round(1 - F.col("distance"), 6).alias("similarity"))


knn_cosine_distance, knn_euclidean, knn_dot, knn_manhattan = (_knn(m) for m in ("cosine", "euclidean", "dot", "manhattan"))


def _pairs(spark, sf_dir):
    """Every vector with the next one."""
    a = _embeddings(spark, sf_dir).select("vec_id", F.col("embedding").alias("a"))
    b = _embeddings(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id")


def pairwise_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def vec_dot(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("dot"))


def vec_euclidean(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.euclidean(F.col("a"), F.col("b")), 6).alias("distance"))


def vec_norm(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def vec_normalize(spark, sf_dir):
    return read_table(spark, sf_dir, "embedding_cache").filter("embedding is not null").select("content_hash", "created_at", F.round(V.norm(V.normalize(F.col("embedding"))), 5).alias("norm")).filter("norm > 0 and not isnan(norm)").distinct()


def distance_to_score(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    for m in V.METRICS:
        rows = rows.withColumn(m, F.round(V.distance_to_score(V.distance(F.col("a"), F.col("b"), m), m), 6))
    return rows.select("vec_id", *V.METRICS)


def knn_repo_filter(spark, sf_dir):
    return _knn("cosine", where=F.col("label").isin(1, 2, 3))(spark, sf_dir)


def _sound(spark, sf_dir):
    """First row of every hash of one model, with a sound vector."""
    cache = store.keep_last(read_table(spark, sf_dir, "embedding_cache").filter("model = 'quill-embed-64'"), ["content_hash"], [F.col("created_at"), F.col("last_accessed"), F.col("access_count")])
    return cache.filter((F.size("embedding") == F.col("dimensions")) & ~F.exists("embedding", F.isnan) & F.exists("embedding", lambda x: x != 0)).select("content_hash", "embedding", canonical_hash(F.col("content_hash")).alias("key"))


def _held(spark, sf_dir):
    return read_table(spark, sf_dir, "chunk_locations").withColumn("key", canonical_hash(F.col("content_hash"))).filter("key is not null")


def _cache_queries(spark, sf_dir):
    """The vectors of the locations whose id is divisible by 100."""
    asked = _held(spark, sf_dir).filter("id % 100 = 0").select("key").distinct()
    return _sound(spark, sf_dir).join(asked, "key", "left_semi")


def knn_repo_join(spark, sf_dir):
    """Nearest cached vectors among those some location of a repository uses."""
    used = _held(spark, sf_dir).filter(F.col("repo_root") == REPO).select("key").distinct()
    return knn_many(_sound(spark, sf_dir).join(used, "key", "left_semi"), _cache_queries(spark, sf_dir), "content_hash", "embedding", K)


def knn_with_locations(spark, sf_dir):
    near = knn_many(_sound(spark, sf_dir), _cache_queries(spark, sf_dir), "content_hash", "embedding", K).withColumn("key", canonical_hash(F.col("id")))
    last = _held(spark, sf_dir).groupBy("key").agg(F.max_by(F.struct("repo_root", "path", "start_line"), "id").alias("p"))
    return near.join(last, "key", "left").select("query", "id", "distance", "p.repo_root", "p.path", "p.start_line")


def search_semantic(spark, sf_dir):
    return _knn("cosine", 50)(spark, sf_dir).filter("score > 0").select("query", "id", "score")


def search_semantic_cross_repo(spark, sf_dir):
    near = _knn("cosine", 50)(spark, sf_dir).filter("score > 0")
    return near.join(_embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), "id").select("query", "label", "id", "score")


def hnsw_memory_estimate(spark, sf_dir):
    n = F.count("embedding")
    return read_table(spark, sf_dir, "embedding_cache").groupBy("model", "dimensions").agg((n * F.col("dimensions") * 4 + n * 16 * 2 * 8).alias("bytes"), F.round(n / (100 / (F.lit(64) / 64 * F.col("dimensions") / 768)), 6).alias("build_seconds"))


def dimension_mismatch(spark, sf_dir):
    size = F.size("embedding")
    return read_table(spark, sf_dir, "embedding_cache").filter("embedding is not null").groupBy("model").agg(F.count(F.lit(1)).alias("vectors"), F.sum((size != F.col("dimensions")).cast("int")).alias("mismatched"))


def vector_count(spark, sf_dir):
    return read_table(spark, sf_dir, "embedding_cache").groupBy("model").agg(F.count("embedding").alias("vectors"), F.count(F.lit(1)).alias("rows"))


def vector_dim_validate(spark, sf_dir):
    bad = F.col("embedding").isNull() | (F.size("embedding") != F.col("dimensions"))
    return read_table(spark, sf_dir, "embedding_cache").filter(bad).select("content_hash", "model", "dimensions", "created_at").distinct()


def _lists(spark, sf_dir):
    """Three ranked lists of documents: keyword hits, nearest vectors, and longest texts."""
    docs = read_table(spark, sf_dir, "documents")
    hits = F.size(F.filter(lines_of(F.col("text")), lambda x: x.rlike("cold cache"))).cast("double")
    keyword = docs.select("doc_id", hits.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(40).select(F.col("doc_id").alias("id"), "score")
    semantic = knn(_embeddings(spark, sf_dir), _query(spark, sf_dir), "vec_id", "embedding", 40).select("id", "score")
    length = docs.select("doc_id", F.length("text").cast("double").alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(40).select(F.col("doc_id").alias("id"), "score")
    return store.union_all([fusion.with_rank(keyword, "keyword"), fusion.with_rank(semantic, "semantic"), fusion.with_rank(length, "length")])


def _fused(df):
    return df.select("id", "rrf_score", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"))


WEIGHTS = {"keyword": 0.3, "semantic": 0.5, "length": 0.2}


def rrf(spark, sf_dir):
    return _fused(fusion.rrf(_lists(spark, sf_dir)))


def weighted_rrf(spark, sf_dir):
    return _fused(fusion.rrf(_lists(spark, sf_dir), WEIGHTS))


def rrf_min_score(spark, sf_dir):
    return _fused(fusion.top_fused(fusion.rrf(_lists(spark, sf_dir)), min_score=0.013))


def rrf_min_sources(spark, sf_dir):
    return _fused(fusion.top_fused(fusion.rrf(_lists(spark, sf_dir)), min_sources=2))


def rerank(spark, sf_dir):
    """The fused list rescored by the cosine to another vector, for documents that have one."""
    from pyspark.sql import Window as W

    fused = fusion.rrf(_lists(spark, sf_dir), WEIGHTS)
    placed = fused.select("id", "rrf_score", F.row_number().over(W.orderBy(F.col("rrf_score").desc(), F.round("score", 6).desc(), "id")).alias("place"))
    scores = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.round(V.cosine(F.col("embedding"), F.lit(_query(spark, sf_dir, 5))), 6).alias("rerank_score"))
    return fusion.rerank(placed, scores, 30, -0.05)


def _keyword_hits(spark, sf_dir, limit=20):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return search.search_keyword(docs, "took [0-9]+ seconds", "path", "text", limit)


def _semantic_hits(spark, sf_dir, limit=20):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(lines_of(F.col("text"))).alias("end_line"))
    near = knn(_embeddings(spark, sf_dir), _query(spark, sf_dir), "vec_id", "embedding", limit)
    return near.join(docs, "id").select(F.col("id").cast("string").alias("path"), F.lit(1).alias("start_line"), "end_line", "score")


def hybrid_search(spark, sf_dir):
    keyword = _keyword_hits(spark, sf_dir).select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return fusion.hybrid_merge(keyword, _semantic_hits(spark, sf_dir, 10))


def hybrid_search_v2(spark, sf_dir):
    """Keyword, vector and symbol hits under one weighted reciprocal rank."""
    keyword = _keyword_hits(spark, sf_dir).select(F.concat_ws(":", "path", "line").alias("id"), "score")
    semantic = _semantic_hits(spark, sf_dir).select(F.concat_ws(":", "path", "start_line", "end_line").alias("id"), "score")
    from pyspark.sql import Window as W

    symbols = search.find_symbol(read_table(spark, sf_dir, "symbols"), "packet", limit=10).filter("path is not null")
    symbols = symbols.select(F.concat_ws(":", "path", "line", "name", "id").alias("id"), (11 - F.row_number().over(W.orderBy("match_rank", "name", "id"))).cast("double").alias("score"))
    lists = store.union_all([fusion.with_rank(keyword, "keyword"), fusion.with_rank(semantic, "semantic"), fusion.with_rank(symbols, "symbol")])
    return _fused(fusion.top_fused(fusion.rrf(lists, {"keyword": 0.3, "semantic": 0.5, "symbol": 0.2}), 20))


QUERIES = {"knn_cosine_distance": knn_cosine_distance, "knn_euclidean": knn_euclidean, "knn_dot": knn_dot, "knn_manhattan": knn_manhattan} | {
    f.__name__: f
    for f in (knn_one, knn_list_index, knn_cosine, pairwise_cosine, vec_dot, vec_euclidean, vec_norm, vec_normalize, distance_to_score, knn_repo_filter, knn_repo_join, knn_with_locations, search_semantic, search_semantic_cross_repo, hnsw_memory_estimate, dimension_mismatch, vector_count, vector_dim_validate, rrf, weighted_rrf, rrf_min_score, rrf_min_sources, rerank, hybrid_search, hybrid_search_v2)
}

_A, _B = "embedding::double[]", "q::double[]"
_DIST = {
    "cosine": f"1 - list_cosine_similarity({_A}, {_B})",
    "euclidean": f"list_distance({_A}, {_B})",
    "dot": f"-list_inner_product({_A}, {_B})",
    "manhattan": f"list_sum(list_transform(list_zip({_A}, {_B}), lambda z: abs(z[1] - z[2])))",
}
_SCORE = {"cosine": "1 - distance", "euclidean": "1 / (1 + distance)", "dot": "-distance", "manhattan": "1 / (1 + distance)"}
_Q = f"q as (select embedding as q from embeddings where vec_id = {QUERY_ID})"


def _near(metric: str = "cosine", k: int = K, where: str = "true", source: str = "embeddings", key: str = "vec_id") -> str:
    return f"(select {key} as id, round({_DIST[metric]}, 6) as distance from {source}, q where {where} order by 2, 1 limit {k})"


_QS = "q as (select vec_id as query, embedding as q from embeddings where vec_id % 100 = 0)"


def _nearest(metric: str = "cosine", k: int = K, where: str = "true", source: str = "embeddings", key: str = "vec_id") -> str:
    scored = f"select query, {key} as id, round({_DIST[metric]}, 6) as distance from {source}, q where {where}"
    return f"(select query, id, distance from (select *, row_number() over (partition by query order by distance, id) as n from ({scored})) where n <= {k})"


def _knn_sql(metric: str) -> str:
    return f"with {_QS} select query, id, distance, round({_SCORE[metric]}, 6) as score from {_nearest(metric)}"


_PAIR = "pairs as (select a.vec_id, a.embedding, b.embedding as q from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
_H = r"nullif(regexp_replace(regexp_replace(lower(regexp_replace(content_hash, '\s+', '', 'g')), '^([a-z][a-z0-9_-]*:|0x)', ''), '^0+([0-9a-f]+)$', '\1'), '')"
_SOUND = f"""sound as (select content_hash, embedding, {_H} as key from (select *, row_number() over (partition by content_hash order by created_at, last_accessed, access_count) as n from embedding_cache where model = 'quill-embed-64')
  where n = 1 and len(embedding) = dimensions and len(list_filter(embedding, lambda x: isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
held as (select *, {_H} as key from chunk_locations),
q as (select content_hash as query, embedding as q from sound where key in (select key from held where id % 100 = 0))"""
_L = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
_LISTS = f"""{_Q},
kw as (select doc_id as id, len(list_filter({_L}, lambda x: regexp_matches(x, 'cold cache')))::double as score from documents),
keyword as (select * from kw where score > 0 order by score desc, id limit 40),
semantic as (select id, round(1 - distance, 6) as score from {_near(k=40)}),
longest as (select doc_id as id, len(text)::double as score from documents order by 2 desc, 1 limit 40),
lists as (select id, 'keyword' as source, score, row_number() over (order by score desc, id) as rank from keyword union all select id, 'semantic', score, row_number() over (order by score desc, id) from semantic
  union all select id, 'length', score, row_number() over (order by score desc, id) from longest)"""


def _rrf_sql(weight: str = "1.0::double") -> str:
    return f"select id, round(sum({weight} / (60 + rank)), 8) as rrf_score, round(max(score), 6) as score, string_agg(source, ',' order by source) as sources, count(*) as n_sources from lists group by 1"


_W = "(case source when 'keyword' then 0.3::double when 'semantic' then 0.5::double else 0.2::double end)"
_KEYWORD = f"""rawl as (select doc_id::varchar as path, {_L} as l from documents),
lined as (select path, case when l[len(l)] = '' then l[1:len(l)-1] else l end as l from rawl),
line as (select path, unnest(l) as snippet, generate_subscripts(l, 1) as line from lined),
khit as (select path, line, row_number() over (partition by path order by line) as n from line where regexp_matches(snippet, 'took [0-9]+ seconds')),
kfirst as (select path, line, 101 - row_number() over (order by path, line) as score from khit where n <= 40 order by path, line limit 20)"""
_SEM = "shit as (select n.id::varchar as path, 1 as start_line, len(l.l) as end_line, round(1 - n.distance, 6) as score from {near} n join lined l on l.path = n.id::varchar)"

SQL = {
    "knn_cosine_distance": _knn_sql("cosine"),
    "knn_euclidean": _knn_sql("euclidean"),
    "knn_dot": _knn_sql("dot"),
    "knn_manhattan": _knn_sql("manhattan"),
    "knn_cosine": f"with {_QS} select query, id, round(1 - distance, 6) as similarity from {_nearest()}",
    "knn_one": f"with {_Q} select id, distance, round(1 - distance, 6) as score from {_near()}",
    "knn_list_index": f"with {_Q} select id, distance, round(1 - distance, 6) as score from {_near()}",
    "pairwise_cosine": f"with {_PAIR} select vec_id, round(list_cosine_similarity({_A}, {_B}), 6) as cosine from pairs",
    "vec_dot": f"with {_PAIR} select vec_id, round(list_inner_product({_A}, {_B}), 6) as dot from pairs",
    "vec_euclidean": f"with {_PAIR} select vec_id, round(list_distance({_A}, {_B}), 6) as distance from pairs",
    "vec_norm": f"select vec_id, round(sqrt(list_inner_product({_A}, {_A})), 6) as norm from embeddings",
    "vec_normalize": f"select distinct content_hash, created_at, 1.0::double as norm from embedding_cache where embedding is not null and len(list_filter(embedding, lambda x: isnan(x))) = 0 and list_inner_product({_A}, {_A}) > 0",
    "distance_to_score": f"with {_PAIR} select vec_id, " + ", ".join(f"round({_SCORE[m].replace('distance', '(' + d + ')', 1) if m != 'cosine' else '1 - (' + d + ')'}, 6) as {m}" for m, d in _DIST.items()) + " from pairs",
    "knn_repo_filter": f"with {_QS} select query, id, distance, round(1 - distance, 6) as score from {_nearest(where='label in (1, 2, 3)')}",
    "knn_repo_join": f"with {_SOUND} select query, id, distance, round(1 - distance, 6) as score from {_nearest(source='sound', key='content_hash', where=f'key in (select key from held where key is not null and repo_root = {REPO!r})').replace('embedding::', 'sound.embedding::')}",
    "knn_with_locations": f"""with {_SOUND}, near as {_nearest(source="sound", key="content_hash")},
keyed as (select near.*, sound.key from near join sound on sound.content_hash = near.id),
last as (select key, max(id) as id from held where key is not null group by 1)
select keyed.query, keyed.id, distance, h.repo_root, h.path, h.start_line from keyed left join last on last.key = keyed.key left join held h on h.id = last.id""",
    "search_semantic": f"with {_QS} select query, id, round(1 - distance, 6) as score from {_nearest(k=50)} where round(1 - distance, 6) > 0",
    "search_semantic_cross_repo": f"with {_QS} select query, label, n.id, round(1 - distance, 6) as score from {_nearest(k=50)} n join embeddings e on e.vec_id = n.id where round(1 - distance, 6) > 0",
    "hnsw_memory_estimate": "select model, dimensions, count(embedding) * dimensions * 4 + count(embedding) * 256 as bytes, round(count(embedding) / (100 / (dimensions / 768.0::double)), 6) as build_seconds from embedding_cache group by 1, 2",
    "dimension_mismatch": "select model, count(*) as vectors, sum((len(embedding) <> dimensions)::int)::bigint as mismatched from embedding_cache where embedding is not null group by 1",
    "vector_count": "select model, count(embedding) as vectors, count(*) as rows from embedding_cache group by 1",
    "vector_dim_validate": "select distinct content_hash, model, dimensions, created_at from embedding_cache where embedding is null or len(embedding) <> dimensions",
    "rrf": f"with {_LISTS} select id, rrf_score, score, sources from ({_rrf_sql()})",
    "weighted_rrf": f"with {_LISTS} select id, rrf_score, score, sources from ({_rrf_sql(_W)})",
    "rrf_min_score": f"with {_LISTS} select id, rrf_score, score, sources from ({_rrf_sql()}) where rrf_score >= 0.013",
    "rrf_min_sources": f"with {_LISTS} select id, rrf_score, score, sources from ({_rrf_sql()}) where n_sources >= 2",
    "rerank": f"""with {_LISTS}, fused as (select id, rrf_score, row_number() over (order by rrf_score desc, score desc, id) as place from ({_rrf_sql(_W)})),
q5 as (select embedding as q from embeddings where vec_id = 5),
scored as (select f.*, round(list_cosine_similarity(e.{_A}, {_B.replace("q::", "q5.q::")}), 6) as s from fused f left join embeddings e on e.vec_id = f.id, q5),
marked as (select *, case when place <= 30 and s is not null then 0 when place <= 30 then 1 else 2 end as bucket from scored)
select id, row_number() over (order by bucket, case when bucket = 0 then -s end, place, id)::int as place, case when bucket = 0 then s else rrf_score end as rrf_score, bucket = 0 as reranked from marked where bucket > 0 or s >= -0.05""",
    "hybrid_search": f"""with {_Q}, {_KEYWORD}, {_SEM.format(near=_near(k=10))},
both_ as (select path, line as start_line, line as end_line, 0.6::double as s, 'keyword' as src from kfirst union all select path, start_line, end_line, 0.4::double * score, 'semantic' from shit)
select path, start_line::int as start_line, end_line::int as end_line, round(sum(s), 6) as score, case when count(distinct src) > 1 then 'both' else min(src) end as source from both_ group by 1, 2, 3""",
    "hybrid_search_v2": f"""with {_Q}, {_KEYWORD}, {_SEM.format(near=_near(k=20))},
syms as (select coalesce(path || ':', '') || line || ':' || name || ':' || id as id, row_number() over (order by mr, name, id) as rk, path from (select *, case when lower(name) = 'packet' then 0 when lower(name) like 'packet%' then 1 else 2 end as mr from symbols where name ilike '%packet%' order by mr, name, id limit 10) where path is not null),
lists as (select path || ':' || line as id, 'keyword' as source, score::double as score, row_number() over (order by score desc, path || ':' || line) as rank from kfirst
  union all select path || ':' || start_line || ':' || end_line, 'semantic', score, row_number() over (order by score desc, path || ':' || start_line || ':' || end_line) from shit
  union all select id, 'symbol', (11 - rk)::double, rk from syms)
select id, rrf_score, score, sources from ({_rrf_sql("(case source when 'keyword' then 0.3::double when 'semantic' then 0.5::double else 0.2::double end)")}) order by rrf_score desc, score desc, n_sources desc, id limit 20""",
}
