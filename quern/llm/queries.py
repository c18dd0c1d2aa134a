"""Queries of this subpackage: problems 1, 2, 4, 6, 7, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.identity import canonical_hash
from quern.llm.handwritten import not_handwritten
from quern.llm.leakage import leaked_passages, strip_stock
from quern.llm.neighbours import nearest_pairs, nearest_vectors
from quern.llm.packing import pack_items, token_counts
from quern.llm.ranking import rank_items
from quern.llm.secrets import credentials
from quern.llm.splitting import split_oversized
from quern.llm.subjects import subjects_of
from quern.runtime import broadcast_if_small, cut_lineage, read_table


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential with its place, and the content without it."""
    return credentials(read_table(spark, sf_dir, "chunks"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_redacted(spark, sf_dir).select("chunk_id", "line_no").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "chunk_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).select("chunk_id").distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of every hash, with the number of locations that hold it and the first of them."""
    near = nearest_vectors(read_table(spark, sf_dir, "embedding_cache"))
    held = read_table(spark, sf_dir, "chunk_locations").groupBy(canonical_hash(F.col("content_hash")).alias("key")).agg(F.count(F.lit(1)).alias("locations"), F.min(F.struct("repo_root", "path", "start_line")).alias("place")).filter("key is not null")
    joined = near.withColumn("key", canonical_hash(F.col("neighbour"))).join(held, "key", "left")
    return joined.select("model", "hash", "neighbour", "similarity", F.coalesce("locations", F.lit(0)).alias("locations"), "place.repo_root", "place.path", "place.start_line")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_pairs(read_table(spark, sf_dir, "embedding_cache"))


def p7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_handwritten(read_table(spark, sf_dir, "chunk_locations"), read_table(spark, sf_dir, "chunks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_reasons(spark, sf_dir).select("repo_root", "path")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_items(read_table(spark, sf_dir, "scored_items"), read_table(spark, sf_dir, "score_signals")).select("query_id", "item_index", "place")


def p6_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by plain leximin, on the items' own percentiles."""
    return rank_items(read_table(spark, sf_dir, "scored_items"), read_table(spark, sf_dir, "score_signals"), plain=True).select("query_id", "item_index", "place")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_ranking(spark, sf_dir).filter("place <= 5").select("query_id", "item_index")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_items(sizes, read_table(spark, sf_dir, "pack_capacities"), "doc_id")


def p8_free_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pack: containers, documents, tokens laid and room left (separators are used room)."""
    packs = read_table(spark, sf_dir, "pack_capacities").select("pack_name", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator"))
    per = p8_containers(spark, sf_dir).groupBy("pack_name", "container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return per.join(broadcast_if_small(packs), "pack_name").groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("capacity_tokens") - F.col("tokens") - F.col("separator") * (F.col("pieces") - 1)).alias("free_tokens"),
    )


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, passage) of the held-out cases: prompts without stock sentences, and content passages."""
    cases = read_table(spark, sf_dir, "eval_cases").select(F.col("id").alias("item_id"), "prompt", F.col("ground_truth.content").alias("content"))
    prompts = strip_stock(cases.select("item_id", F.col("prompt").alias("passage")), "item_id", "passage")
    return prompts.unionByName(cases.select("item_id", F.explode("content").alias("passage")))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked passage with its place in the words of the document."""
    return leaked_passages(read_table(spark, sf_dir, "documents"), _passages(spark, sf_dir), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_examples")).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per subject, and their share of all documents."""
    found = cut_lineage(p10_found(spark, sf_dir))
    total = found.agg(F.countDistinct("doc_id").alias("n"))
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).crossJoin(F.broadcast(total)).select("subject", "documents", (F.col("documents") / F.col("n")).alias("share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p7_found": p7_found,
    "p7_reasons": p7_reasons,
    "p6_found": p6_found,
    "p6_ranking": p6_ranking,
    "p6_plain": p6_plain,
    "p8_containers": p8_containers,
    "p8_free_room": p8_free_room,
    "p9_found": p9_found,
    "p9_spans": p9_spans,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_RANKING = """
with told as (select signal, coalesce(higher_is_better, true) as up, greatest(coalesce(weight, 0.1), 0) as w from score_signals),
given as (select query_id as q, item_index as i, s.signal, max(case when coalesce(up, true) then score else -score end) as v, max(coalesce(w, 0.1)) as w
  from scored_items s left join told t on t.signal = s.signal where score is not null and not isnan(score) and not isinf(score) group by 1, 2, 3),
placed as (select *, (rank() over (partition by q, signal order by v) - 1 + count(*) over (partition by q, signal, v) / 2.0::double) / count(*) over (partition by q, signal) as share from given),
odds as (select q, i, signal, w, ln(share / (1 - share)) as o from placed),
item as (select q, i, sum(w) as sw, sum(w * o) as so, list(w order by signal) as ws, list(o order by signal) as os from odds group by 1, 2),
wide as (select *, max(len(ws)) over () as widest, case when sw > 0 then so / sw else 0 end as mean from item),
standing as (select q, i, list_transform(list_sort(list_concat(
  list_transform(list_zip(ws, os), lambda z: case when sw - z[1] > 1e-12 then (so - z[1] * z[2]) / (sw - z[1]) else mean end),
  list_transform(range(widest - len(ws)), lambda x: mean))), lambda x: round(x, 9)) as s from wide),
every as (select distinct query_id as q, item_index as i from scored_items where query_id is not null and item_index is not null),
ranking as (select e.q as query_id, e.i as item_index, (row_number() over (partition by e.q order by coalesce(s.s, []) desc, e.i))::int as place from every e left join standing s on s.q = e.q and s.i = e.i)
"""

_PLAIN = _RANKING.replace("case when sw > 0 then so / sw else 0 end as mean", "list_avg(os) as mean").replace("case when sw - z[1] > 1e-12 then (so - z[1] * z[2]) / (sw - z[1]) else mean end", "z[2]")

SQL: dict[str, str] = {
    "p6_plain": _PLAIN + "select query_id, item_index, place from ranking",
    "p6_ranking": _RANKING + "select query_id, item_index, place from ranking",
    "p6_found": _RANKING + "select query_id, item_index from ranking where place <= 5",
    "p2_found": """
with limits as (select lower(trim(language)) as language, max_chunk_lines as ml, max_chunk_bytes as mb from chunk_limits),
named as (select chunk_id, content, coalesce((select l.language from limits l where l.language = lower(trim(regexp_replace(c.language, '^\\s+|\\s+$', '', 'g')))), 'default') as language from chunks c)
select distinct chunk_id from named join limits using (language)
where len(content) > 0 and (len(content) - len(replace(content, chr(10), '')) + case when content like '%' || chr(10) then 0 else 1 end > ml or strlen(content) > mb)
""",
}
