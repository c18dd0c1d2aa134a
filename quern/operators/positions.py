"""Positions and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.runtime import cut_lineage, with_columns_free


def positions(df: DataFrame, group: list[str], order: list[Column], weight: Column | None = None) -> DataFrame:
    """``df`` with ``before`` (weight of the rows of its group that come before) and ``total``.

    ``order`` must be unique within a group. Rows are range-partitioned by group and order; local
    running sums are completed by the sums of the group's earlier partitions, of which there is one
    row per group and partition.
    """
    with_columns_free(df, "before", "total", "__part", "__w", "__sum")
    ranged = df.withColumn("__w", weight if weight is not None else F.lit(1)).repartitionByRange(*[F.col(g) for g in group], *order)
    ranged = cut_lineage(ranged.withColumn("__part", F.spark_partition_id()))
    running = W.partitionBy("__part", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("before", F.coalesce(F.sum("__w").over(running), F.lit(0)))
    sums = ranged.groupBy("__part", *group).agg(F.sum("__w").alias("__sum"))
    earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("__part", *group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"), F.sum("__sum").over(W.partitionBy(*group)).alias("total"))
    joined = local.join(sums, ["__part", *group])
    return joined.withColumn("before", F.col("before") + F.col("__offset")).drop("__part", "__w", "__offset")
