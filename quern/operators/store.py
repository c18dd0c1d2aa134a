"""Maintenance of stores: upserts, the content-addressed cache, sync and migration, as DataFrame algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in ``order``. Skew of a key is cut by the map-side group limit."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key (whole rows)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``old`` with the columns ``update`` of matching rows replaced, and rows of new keys added."""
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("__o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("__n"))
    joined = o.join(n, keys, "full")
    values = []
    for c in old.columns:
        if c in keys:
            values.append(F.col(c))
        elif c in update:
            values.append(F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(f"__o.{c}")).alias(c))
        else:
            values.append(F.when(F.col("__o").isNotNull(), F.col(f"__o.{c}")).otherwise(F.col(f"__n.{c}")).alias(c))
    return joined.select(*values)


def delete_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` without the rows whose key occurs in ``keys``; missing keys are ignored."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def cache_put(cache: DataFrame, entries: DataFrame, now: int) -> DataFrame:
    """Put entries (``content_hash, embedding, model, dimensions``): the first vector of a hash stays,
    every put of a known hash only counts an access."""
    puts = entries.groupBy("content_hash").agg(F.min_by(F.struct("embedding", "model", "dimensions"), F.coalesce("model", F.lit(""))).alias("e"), F.count(F.lit(1)).alias("puts"))
    known = cache.select("content_hash", F.struct(*[c for c in cache.columns if c != "content_hash"]).alias("c"))
    joined = known.join(puts, "content_hash", "full")
    old = F.col("c").isNotNull()
    return joined.select(
        "content_hash",
        F.when(old, F.col("c.embedding")).otherwise(F.col("e.embedding")).alias("embedding"),
        F.when(old, F.col("c.model")).otherwise(F.col("e.model")).alias("model"),
        F.when(old, F.col("c.dimensions")).otherwise(F.col("e.dimensions")).alias("dimensions"),
        F.when(old, F.col("c.created_at")).otherwise(F.lit(now)).alias("created_at"),
        (F.coalesce("c.access_count", F.lit(0)) + F.coalesce("puts", F.lit(0))).alias("access_count"),
        F.when(F.col("puts").isNotNull(), F.lit(now)).otherwise(F.col("c.last_accessed")).alias("last_accessed"),
    )


def evict_lru(cache: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` entries that were used last; ties by hash. TakeOrdered, no full sort."""
    return cache.orderBy(F.col("last_accessed").desc(), "content_hash").limit(keep)


def embed_split(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``chunks`` (with ``content, content_hash``) marked ``skipped`` (blank), ``hit`` or ``embed``."""
    known = cache.select("content_hash").distinct().withColumn("__known", F.lit(True))
    blank = F.coalesce(F.trim(F.regexp_replace("content", r"\s+", " ")), F.lit("")) == ""
    return chunks.join(known, "content_hash", "left").withColumn("action", F.when(blank, "skipped").when(F.col("__known"), "hit").otherwise("embed")).drop("__known")


def sync(source: DataFrame, derived: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(keys to add to the derived store, keys to delete from it); nulls are no keys."""
    s, d = source.select(key).filter(F.col(key).isNotNull()).distinct(), derived.select(key).filter(F.col(key).isNotNull()).distinct()
    return s.join(d, key, "left_anti"), d.join(s, key, "left_anti")


def changed_files(old: DataFrame, new: DataFrame, path: list[str], content: str) -> DataFrame:
    """Paths of ``new`` whose multiset of hashes differs from that of ``old``, or that are new."""
    counted = lambda df, name: df.groupBy(*path, content).agg(F.count(F.lit(1)).alias(name))
    joined = counted(old, "o").join(counted(new, "n"), [*path, content], "full")
    differ = joined.filter(~F.col("o").eqNullSafe(F.col("n"))).select(*path).distinct()
    return differ.join(new.select(*path).distinct(), path, "left_semi")


def table_stats(df: DataFrame, **aggregates) -> DataFrame:
    """One row of named aggregates."""
    return df.agg(*[a.alias(n) for n, a in aggregates.items()])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
