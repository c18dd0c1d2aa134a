"""One ranking from several differently scaled scores (problem 6).

Method: leximin. Scores become mid-rank percentiles within their query and signal, so neither
scale nor outliers nor constant signals matter, and percentiles become log-odds, in which
differences near the ends count. Each item gets the vector of its standings without each single
signal (weighted mean of the others), sorted ascending; the vectors are compared
lexicographically. The first element is the item's standing without its best support, so no single
signal can lift an item and a weak one cannot be masked.

Positions within a group are computed on range-partitioned, pre-aggregated data with a prefix sum
over the partitions, so a query that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.positions import positions
from quern.runtime import broadcast_if_small, cut_lineage


def rank_items(scores: DataFrame, signals: DataFrame, query: str = "query_id", item: str = "item_index", default_weight: float = 0.1, plain: bool = False) -> DataFrame:
    """``query, item, standing, place``: every item of every query with its place, from 1.

    ``scores`` has one row per query, ``signal`` and item; of repeated rows the best score counts.
    Null, NaN and infinite scores are missing, rows without query or item are dropped. ``signals``
    tells ``higher_is_better`` and ``weight``; signals it lacks, and null fields, count as
    higher-is-better with ``default_weight``, negative weights as 0. An item without any score
    comes last; equal vectors are ordered by item. Queries keep all their items. Extra columns are
    ignored. With ``plain`` an item's vector is its own percentiles alone, without weights; a
    missing one is the item's mean.
    """
    told = signals.select(F.col("signal"), F.coalesce("higher_is_better", F.lit(True)).alias("up"), F.greatest(F.coalesce("weight", F.lit(default_weight)), F.lit(0.0)).alias("w")).dropDuplicates(["signal"])
    rows = scores.select(F.col(query).alias("q"), F.col(item).alias("i"), "signal", F.col("score").cast("double").alias("score")).filter("q is not null and i is not null")
    usable = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")) & F.col("signal").isNotNull()
    given = rows.filter(usable).join(broadcast_if_small(told), "signal", "left").select("q", "i", "signal", F.when(F.coalesce("up", F.lit(True)), F.col("score")).otherwise(-F.col("score")).alias("v"), F.coalesce("w", F.lit(default_weight)).alias("w"))
    given = cut_lineage(given.groupBy("q", "i", "signal").agg(F.max("v").alias("v"), F.max("w").alias("w")))
    distinct = given.groupBy("q", "signal", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = positions(distinct, ["q", "signal"], [F.col("v")], F.col("n"))
    share = (F.col("before") + F.col("n") / 2) / F.col("total")
    odds = placed.select("q", "signal", "v", F.log(share / (1 - share)).alias("odds"))
    vectors = (
        given.join(odds, ["q", "signal", "v"])
        .groupBy("q", "i")
        .agg(F.sort_array(F.collect_list(F.struct("signal", "odds", "w"))).alias("s"))
        .withColumn("sw", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"]))
        .withColumn("so", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"] * x["odds"]))
    )
    mean = F.when(F.col("sw") > 0, F.col("so") / F.col("sw")).otherwise(0.0)
    without = F.transform("s", lambda x: F.when(F.col("sw") - x["w"] > 1e-12, (F.col("so") - x["w"] * x["odds"]) / (F.col("sw") - x["w"])).otherwise(F.col("mean")))
    if plain:
        vectors = vectors.withColumn("sw", F.size("s").cast("double")).withColumn("so", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["odds"]))
        without = F.transform("s", lambda x: x["odds"])
    widest = vectors.agg(F.max(F.size("s")).alias("widest"))  # one row
    standing = vectors.withColumn("mean", mean).crossJoin(F.broadcast(widest)).select("q", "i", F.transform(F.sort_array(F.concat(without, F.array_repeat("mean", (F.col("widest") - F.size("s")).cast("int")))), lambda x: F.round(x, 9)).alias("standing"))
    every = rows.select("q", "i").distinct().join(standing, ["q", "i"], "left").withColumn("standing", F.coalesce("standing", F.array().cast("array<double>")))
    ranked = positions(every, ["q"], [F.col("standing").desc(), F.col("i").asc()])
    return ranked.select(F.col("q").alias(query), F.col("i").alias(item), "standing", (F.col("before") + 1).cast("int").alias("place"))
